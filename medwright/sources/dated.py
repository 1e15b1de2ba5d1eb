"""Facts laid out by date (IO1, IO5, P5).

A report window then reads the directories of its dates and no others: statically where the
window is in the query, dynamically where it comes from a table (a calendar, a list of loads)
that is joined. A fact whose own column is a DATE is laid out by that column itself and every plan's filter prunes
it as written. A fact with timestamps, or one laid out by month or year, gets a period
column beside it, which ``in_window`` filters together with the timestamp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import lit_date, lit_ts

UNITS = ("day", "month", "year")


def period_column(date_col: str, unit: str) -> str:
    return f"{date_col}_{unit}"


def _period(c: Column, unit: str) -> Column:
    return F.to_date(F.date_trunc(unit, c))


def write_dated(df: DataFrame, path: str, date_col: str, unit: str = "day") -> str:
    """Write ``df`` in directories of ``unit`` of ``date_col``; rows without a date get one of their own.

    The rebalancing hint brings a period's rows together, so that files are few, and lets
    AQE split a period that holds a large share of all rows over several tasks.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    if unit == "day" and isinstance(df.schema[date_col].dataType, T.DateType):
        by, rows = date_col, df
    else:
        by = period_column(date_col, unit)
        if by in df.columns:
            raise ValueError(f"the rows have a column {by} already")
        rows = df.withColumn(by, _period(F.col(date_col), unit))
    rows.hint("rebalance", F.col(by)).write.mode("errorifexists").partitionBy(by).parquet(path)
    return path


def read_dated(spark: SparkSession, path: str, schema: T.StructType, date_col: str, unit: str = "day") -> DataFrame:
    """The table, with its period column; ``schema`` is that of the rows written (nothing is inferred from directory names)."""
    own_day = unit == "day" and isinstance(schema[date_col].dataType, T.DateType)
    full = schema if own_day else T.StructType([*schema.fields, T.StructField(period_column(date_col, unit), T.DateType())])
    return spark.read.schema(full).parquet(path)


def in_window(df: DataFrame, date_col: str, start, end, unit: str = "day", closed: str = "both") -> DataFrame:
    """Rows dated ``start`` .. ``end`` (``closed="left"``: before ``end``), read from the periods that can hold them."""
    value = lit_date if isinstance(df.schema[date_col].dataType, T.DateType) else lit_ts
    lo, hi, c = value(start), value(end), F.col(date_col)
    rows = df.filter((c >= lo) & ((c <= hi) if closed == "both" else (c < hi)))
    by = period_column(date_col, unit)
    return rows.filter(F.col(by).between(_period(lo, unit), _period(hi, unit))) if by in df.columns else rows


def of_periods(df: DataFrame, periods: DataFrame, date_col: str, unit: str = "day") -> DataFrame:
    """The rows of the periods that a table lists (one DATE column): pruned while the query runs."""
    by = period_column(date_col, unit) if period_column(date_col, unit) in df.columns else date_col
    listed = periods.select(F.col(periods.columns[0]).alias("_period")).distinct()
    return df.join(listed, F.col(by) == F.col("_period"), "left_semi")
