"""Join helpers.

No helper forces a broadcast: dimension tables of unknown size are left to
Catalyst's size estimate and AQE's runtime statistics, which broadcast a
side only when its measured size is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role(dim: DataFrame, prefix: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The same dimension under a second role (J7): columns renamed with a prefix."""
    cols = columns or dim.columns
    return dim.select(*[F.col(c).alias(f"{prefix}{c}") for c in cols])


def left_filtered(left: DataFrame, right: DataFrame, on, right_filter: Column | None = None) -> DataFrame:
    """``LEFT JOIN r ON key AND <r predicate>`` (J4): the predicate filters the
    right input first, so unmatched left rows are kept."""
    if right_filter is not None:
        right = right.filter(right_filter)
    return left.join(right, on, "left")


def exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Correlated ``EXISTS``."""
    return left.join(right, on, "left_semi")


def not_exists(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Correlated ``NOT EXISTS`` (J10, J11). Build the subquery body as a
    DataFrame first, then anti-join on the correlated key(s)."""
    return left.join(right, on, "left_anti")


def not_in_table(rows: DataFrame, column: str, excluded: DataFrame, excluded_column: str | None = None) -> DataFrame:
    """``column NOT IN (SELECT excluded_column FROM excluded)`` for a list of any length.

    An anti-join on the value, which Spark may broadcast or shuffle as it likes, with the three
    NULL cases of ``NOT IN`` around it: a NULL in the list rejects every row, a NULL
    value passes only an empty list, and an empty list passes everything. (Spark's own ``NOT IN
    (SELECT ..)`` plans a null-aware join that always broadcasts the list.)
    """
    listed = excluded.select(F.col(excluded_column or column).alias("_not_in"))
    size = listed.agg(F.count(F.lit(1))).scalar()
    nulls = listed.agg(F.count_if(F.col("_not_in").isNull())).scalar()
    kept = rows.join(listed.filter(F.col("_not_in").isNotNull()), rows[column] == F.col("_not_in"), "left_anti")
    return kept.filter((size == 0) | ((nulls == 0) & F.col(column).isNotNull()))
