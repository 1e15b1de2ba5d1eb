"""Filter predicates for report parameters and code lists."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_numbers(values: Iterable) -> list[int]:
    """Identifiers written as quoted text in a report, compared with a numeric
    column (the database converts them implicitly; here it is explicit)."""
    return [int(v) for v in values]


def optional_in(col: ColumnOrName, values: Iterable | None) -> Column:
    """``col IN (p) OR NULLIF(COALESCE(p, s), s) IS NULL``.

    A report parameter left empty means "no filter": the predicate is the
    constant TRUE and Catalyst drops it from the plan entirely.
    """
    vals = [v for v in (values or []) if v is not None and v != ""]
    if not vals:
        return F.lit(True)
    return _c(col).isin(vals)


def required_in(col: ColumnOrName, values: Iterable) -> Column:
    """A mandatory ``IN`` list parameter."""
    vals = list(values)
    if not vals:
        raise ValueError("a required list parameter was empty")
    return _c(col).isin(vals)


def not_in(col: ColumnOrName, values: Iterable) -> Column:
    """``col NOT IN (..)`` (P8). As in SQL, a NULL ``col`` does not pass."""
    return ~_c(col).isin(list(values))


def not_equal(col: ColumnOrName, value) -> Column:
    """``NOT col = v`` / ``col NOT LIKE 'v'`` (P13, P14): NULL does not pass."""
    return ~(_c(col) == F.lit(value))


def active(col: ColumnOrName, value=1) -> Column:
    """Status / soft-delete flag filters."""
    return _c(col) == F.lit(value)


def any_of(*preds: Column) -> Column:
    """OR of rule groups."""
    out = F.lit(False)
    for p in preds:
        out = out | p
    return out
