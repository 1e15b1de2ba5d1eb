"""Tables spread over several schemas, read in one query (IO2).

A report that joins a warehouse schema with the operational one (the dispensing
extract does) takes its tables from both. ``tables_from`` resolves a report's
table names against a list of schemas (or against a schema named for each), and
``mounted`` sets schemas up over folders of Parquet tables for as long as a block runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def tables_from(spark: SparkSession, names: Iterable[str], schemas: Sequence[str] | Mapping[str, str]) -> dict[str, DataFrame]:
    """Each table from the schema given for it, or from the first of ``schemas`` that has it.

    A table that no schema has is an error, as is one that several schemas have when
    only a list is given: which one is meant then depends on nothing but the list's order.
    """
    out = {}
    for name in names:
        if isinstance(schemas, Mapping):
            out[name] = spark.table(f"{schemas[name]}.{name}")
            continue
        found = [s for s in schemas if spark.catalog.tableExists(f"{s}.{name}")]
        if len(found) != 1:
            raise ValueError(f"{name} is in {len(found)} of the schemas {', '.join(schemas)}; name one schema for it")
        out[name] = spark.table(f"{found[0]}.{name}")
    return out


@contextmanager
def mounted(spark: SparkSession, layout: Mapping[str, Mapping[str, str]]) -> Iterator[dict[str, str]]:
    """Schemas over Parquet folders: {schema: {table: path}} -> {schema: its name in the catalog}.

    The names are made unique, so that sessions sharing a metastore don't meet. On exit, also by an
    error, the schemas go with their tables; the tables are external, so the files stay, and so does what was read
    from them meanwhile.
    """
    made = {}
    try:
        for schema, tables in layout.items():
            made[schema] = f"{schema}_{uuid.uuid4().hex[:12]}"
            spark.sql(f"CREATE DATABASE {made[schema]} LOCATION '{shared_dir(spark, 'schemas', schema)}'")
            for table, path in tables.items():
                spark.catalog.createTable(f"{made[schema]}.{table}", path=path, source="parquet")
        yield made
    finally:
        for name in made.values():
            spark.sql(f"DROP DATABASE IF EXISTS {name} CASCADE")
