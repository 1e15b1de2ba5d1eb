"""Latest-row-per-key operators.

The report SQL writes "latest" as ``ROW_NUMBER() / DENSE_RANK() OVER
(PARTITION BY key ORDER BY t DESC) = 1``. A window puts every row of a key
into one task, so a single hot key (one patient, one pharmacy) holding a
large share of the rows would serialise the whole stage. The default
strategies below are skew-safe:

* ``ties="one"`` (ROW_NUMBER): ``groupBy(key).agg(max(struct(order.., rest..)))``.
  The max is computed partially in every map task before the shuffle, so a
  hot key ships one row per task. Remaining columns ride in the struct and
  act as a deterministic tie-breaker (K37).
* ``ties="all"`` (DENSE_RANK): a partial ``max(order)`` per key, then a semi
  join back on ``(key, order)``. Rows of a hot key spread over partitions
  unless they all tie on the order value; then the join relies on AQE
  (broadcast of the small per-key side, or skew-join splitting). When only
  "does any row at the latest value pass" is needed, ``latest_any`` avoids
  the join entirely.

``method="window"`` keeps the literal window form for comparison.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _as_list(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def latest(df: DataFrame, keys: str | Sequence[str], order: str | Sequence[str],
           ties: str = "one", method: str = "aggregate") -> DataFrame:
    """Keep the latest row(s) per ``keys`` by descending ``order`` columns.

    NULL order values sort last, as ``ORDER BY .. DESC`` does in SQL Server.
    """
    keys, order = _as_list(keys), _as_list(order)
    if method == "window":
        return _latest_window(df, keys, order, ties)
    if ties == "one":
        rest = [c for c in df.columns if c not in keys and c not in order]
        packed = F.struct(*[F.col(c) for c in order + rest]).alias("_top")
        top = df.groupBy(*keys).agg(F.max(packed).alias("_top"))
        return top.select(*keys, *[F.col("_top")[c].alias(c) for c in order + rest]).select(*df.columns)
    if ties == "all":
        if len(order) != 1:
            raise ValueError("ties='all' ranks on a single order column")
        o = order[0]
        best = df.groupBy(*keys).agg(F.max(o).alias("_best"))
        cond = [df[k] == best[k] for k in keys] + [df[o].eqNullSafe(best["_best"])]
        return df.join(best, cond, "left_semi")
    raise ValueError(f"unknown ties mode {ties!r}")


def latest_any(df: DataFrame, keys: str | Sequence[str], order: str, predicate, name: str = "passes") -> DataFrame:
    """Per key: does any row at the latest ``order`` value satisfy ``predicate``?

    Equivalent to ``DENSE_RANK() OVER (PARTITION BY keys ORDER BY order DESC) = 1``
    followed by the predicate and a distinct over the keys, computed as one
    aggregation: ``max(struct(order, predicate))`` picks the latest value and,
    among rows tied on it, prefers a passing row (true > false). A NULL
    predicate counts as not passing; NULL order values sort last (W3 + W5).
    """
    keys = _as_list(keys)
    flag = F.coalesce(predicate, F.lit(False))
    top = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("o"), flag.alias("p"))).alias("_top"))
    return top.select(*keys, F.col("_top.o").alias(order), F.col("_top.p").alias(name))


def _latest_window(df: DataFrame, keys: list[str], order: list[str], ties: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    rank = F.row_number() if ties == "one" else F.dense_rank()
    return df.withColumn("_rk", rank.over(w)).filter("_rk = 1").drop("_rk")
