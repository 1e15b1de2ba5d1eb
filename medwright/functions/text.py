"""String Column expressions: concatenation, parsing and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def concat_ws_null_empty(*parts: ColumnOrName) -> Column:
    """``CONCAT(a, b, ..)`` with SQL-Server NULL handling (S17): NULL parts are
    empty strings and numbers are rendered as text. Spark's ``concat`` would
    return NULL instead."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def split_pair(value: ColumnOrName, sep: str = "/", as_type: str = "int") -> tuple[Column, Column]:
    """Split ``'a/b'`` into two typed parts (S16). Malformed parts become NULL
    instead of failing the query (K31)."""
    v = _c(value)
    has_sep = F.instr(v, sep) > 0
    first = F.when(has_sep, F.split_part(v, F.lit(sep), F.lit(1)))
    second = F.when(has_sep, F.split_part(v, F.lit(sep), F.lit(2)))
    return first.try_cast(as_type), second.try_cast(as_type)


def percent_text(numerator: ColumnOrName, denominator: ColumnOrName, digits: int = 2) -> Column:
    """``CONCAT(ROUND(num / den * 100, 2), '%')`` rendered like SQL Server's float
    text: ``60.08%``, ``100%`` (S22, S23, A17). A zero denominator yields NULL
    instead of a division error (K35)."""
    ratio = F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double")) * 100
    text = F.regexp_replace(F.round(ratio, digits).cast("string"), r"\.0$", "")
    return F.concat(text, F.lit("%"))


def _like_literal(prefix: str) -> str:
    escaped = prefix.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("'", "\\'")
    return f"'{escaped}%'"


def starts_with_any(value: ColumnOrName, prefixes) -> Column:
    """``v LIKE 'p1%' OR v LIKE 'p2%' ..`` (P11). Catalyst turns each LIKE into a
    StartsWith predicate evaluated in generated code. For a column name the
    predicate is built as one SQL expression (one driver->JVM call instead of
    two per prefix)."""
    prefixes = list(prefixes)
    if isinstance(value, str):
        col = "`" + value.replace("`", "``") + "`"
        return F.expr(" OR ".join(f"{col} LIKE {_like_literal(p)}" for p in prefixes) or "false")
    pred = F.lit(False)
    for p in prefixes:
        pred = pred | value.startswith(p)
    return pred


def contains(value: ColumnOrName, token: str) -> Column:
    """``v LIKE '%token%'``."""
    return _c(value).contains(token)
