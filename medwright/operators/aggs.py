"""Aggregate builders.

All are plain ``pyspark.sql.functions`` aggregates so Spark plans them as
partial (map-side) + final aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def max_all(columns: Mapping[str, ColumnOrName]) -> list[Column]:
    """``MAX(expr) AS name`` for every entry (A1-A3): one value per column,
    possibly from different source rows (K10)."""
    return [F.max(_c(expr)).alias(name) for name, expr in columns.items()]


def pivot_max(type_col: ColumnOrName, value: ColumnOrName, code) -> Column:
    """``MAX(CASE WHEN type = code THEN value END)`` (A5)."""
    return F.max(F.when(_c(type_col) == F.lit(code), _c(value)))


def _non_null(arr: Column) -> Column:
    return F.filter(arr, lambda x: x.isNotNull())


def _join_or_null(arr: Column, sep: str) -> Column:
    return F.when(F.size(arr) > 0, F.array_join(arr, sep))


def string_agg(value: ColumnOrName, sep: str) -> Column:
    """``STRING_AGG(value, sep)`` (A10, A12) with a defined order: values are
    sorted, duplicates kept (K9), NULLs skipped, and an all-NULL group yields
    NULL."""
    return _join_or_null(F.array_sort(F.collect_list(_c(value).cast("string"))), sep)


def aligned_lists(order_key: ColumnOrName, fields: Mapping[str, ColumnOrName], sep: str) -> dict[str, Column]:
    """Several ``STRING_AGG`` lists over the same rows, all ordered by
    ``order_key`` so that the n-th entries belong together (A11).

    Each list skips its own NULLs (as STRING_AGG does) and is NULL when empty.
    """
    names = list(fields)
    row = F.struct(_c(order_key).alias("_k"), *[_c(v).cast("string").alias(n) for n, v in fields.items()])
    rows = F.array_sort(F.collect_list(F.when(_c(order_key).isNotNull(), row)))
    def field(name):
        return lambda r: r[name]

    return {n: _join_or_null(_non_null(F.transform(rows, field(n))), sep) for n in names}


def aligned_fields(rows: str, names, sep: str) -> dict[str, Column]:
    """Like ``aligned_lists``, from a column that already holds the group's
    sorted rows (an array of structs whose fields are text)."""
    def field(name):
        return lambda r: r[name]

    return {n: _join_or_null(_non_null(F.transform(rows, field(n))), sep) for n in names}


def int_avg(value: ColumnOrName) -> Column:
    """``AVG(int)`` as SQL Server computes it: an integer, truncated toward zero."""
    v = _c(value).cast("long")
    return F.call_function("div", F.sum(v), F.nullif(F.count(v), F.lit(0)))


def count_flag(value: ColumnOrName, more_than: int = 1) -> Column:
    """``CASE WHEN COUNT(v) > n THEN 0 ELSE 1 END``."""
    return F.when(F.count(_c(value)) > more_than, 0).otherwise(1)
