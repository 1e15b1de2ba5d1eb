"""Temp tables: an intermediate stored once, read by several consumers, dropped at the end (IO3).

The reports' ``SELECT .. INTO #name`` / ``DROP TABLE #name``. The rows are written
to a folder of their own below ``spark.checkpoint.dir`` (they outlive any executor), and read
back under a temp view. Nothing goes into Spark's cache: a cached plan would silently
stand in for the same subtree of every other query of the session.

    with temp_table(cohort, "enc") as enc:
        orders.join(enc.df, ..)               # as a DataFrame
        spark.sql(f"SELECT .. FROM {enc.view}")   # or by name

The scope drops view and folder on exit, also when an error leaves it, or when the write itself
fails. A report that is returned as a DataFrame keeps its temp tables until
``session.release(report)``; folders still there when the session's file system closes go with it,
as temp tables do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame

from ..session import holds, shared_dir
from . import sinks


class TempTable:
    """A stored intermediate: ``df`` reads it, ``view`` names it in SQL, ``drop`` removes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = shared_dir(self.spark, "temp", name)
        self.view = f"{name}_{uuid.uuid4().hex[:12]}"  # a session may run the same report twice at a time
        try:
            df.write.mode("errorifexists").parquet(self.path)
        except BaseException:
            sinks.remove(self.spark, self.path)
            raise
        sinks.remove_at_exit(self.spark, self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        self.df.createOrReplaceTempView(self.view)

    def drop(self) -> None:
        self.spark.catalog.dropTempView(self.view)
        sinks.remove(self.spark, self.path)


@contextmanager
def temp_table(df: DataFrame, name: str) -> Iterator[TempTable]:
    """A temp table for the length of a ``with`` block."""
    table = TempTable(df, name)
    try:
        yield table
    finally:
        table.drop()


def stored_once(df: DataFrame, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The report that ``build`` makes of the stored rows of ``df``, holding the temp table;
    if it cannot be built, the temp table is dropped."""
    table = TempTable(df, name)
    try:
        return holds(build(table.df), table)
    except BaseException:
        table.drop()
        raise
