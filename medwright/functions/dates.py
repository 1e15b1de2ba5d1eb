"""Date/time Column expressions with SQL-Server counting rules.

SQL Server's ``DATEDIFF(unit, a, b)`` counts unit *boundaries* crossed, not
elapsed whole units; Spark's ``timestampdiff``/``datediff(YEAR, ..)`` count
whole units. The helpers here reproduce the boundary semantics with plain
built-in expressions so they stay inside whole-stage codegen.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_date(value: str | _dt.date) -> Column:
    """A DATE literal (S27); datetimes and ISO timestamps are cut to their date."""
    return F.lit(_as_date(value))


def lit_ts(value: str | _dt.datetime) -> Column:
    """A TIMESTAMP_NTZ literal: local wall time that never shifts with the session zone."""
    if isinstance(value, str):
        value = _dt.datetime.fromisoformat(value)
    elif isinstance(value, _dt.date) and not isinstance(value, _dt.datetime):
        value = _dt.datetime.combine(value, _dt.time())
    # From text, not from a Python datetime: the string -> TIMESTAMP_NTZ cast
    # involves no time zone, so neither the driver's nor the session's zone
    # can shift the wall-clock value.
    return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def trunc_div(a: Column, b: int) -> Column:
    """Integer division truncating toward zero, like ``int / int`` in T-SQL."""
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def year_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(year, start, end)``: calendar-year boundaries crossed."""
    return F.year(_c(end)) - F.year(_c(start))


def add_years(d: ColumnOrName, years: Column | int) -> Column:
    """``DATEADD(year, n, d)``; 29 Feb clamps to 28 Feb (S3)."""
    n = years if isinstance(years, Column) else F.lit(years)
    return F.add_months(_c(d), (n * 12).cast("int"))


def exact_age(birth: ColumnOrName, as_of: ColumnOrName) -> Column:
    """Age in completed years on ``as_of`` (S2): year boundaries minus one
    when the birthday has not been reached yet."""
    years = year_boundaries(birth, as_of)
    not_yet = F.when(add_years(birth, years) > _c(as_of), 1).otherwise(0)
    return years - not_yet


def add_days(ts: ColumnOrName, days: Column | int) -> Column:
    """``DATEADD(day, n, ts)`` on a timestamp."""
    return F.timestamp_add("DAY", days if isinstance(days, Column) else F.lit(days), _c(ts))


def day_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(day, start, end)`` (S5): midnights crossed."""
    return F.datediff(F.to_date(_c(end)), F.to_date(_c(start)))


def second_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(second, start, end)`` (S7): whole-second marks crossed."""
    return F.unix_timestamp(_c(end)) - F.unix_timestamp(_c(start))


def minute_boundaries(start: ColumnOrName, end: ColumnOrName) -> Column:
    """``DATEDIFF(minute, start, end)`` (S6): minute marks crossed.

    10:00:30 -> 11:00:29 is 60 here, where ``timestampdiff`` says 59.
    """
    to_min = lambda c: F.floor(F.unix_timestamp(_c(c)) / 60)
    return (to_min(end) - to_min(start)).cast("long")


def duration_text(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Step duration rendered as ``H:MM`` text.

    Hours are whole hours of the second difference (truncated); hours below 9
    get a leading ``0`` (so 9 prints ``9``); minutes are minute boundaries
    minus 60 x hours and can reach ``60``. A NULL bound renders ``''``.
    """
    hours = trunc_div(second_boundaries(start, end), 3600)
    minutes = minute_boundaries(start, end) - hours * 60
    hour_txt = F.when(hours < 9, F.concat(F.lit("0"), hours.cast("string"))).otherwise(hours.cast("string"))
    min_txt = F.when(minutes < 10, F.concat(F.lit(":0"), minutes.cast("string"))).otherwise(
        F.concat(F.lit(":"), minutes.cast("string")))
    return F.concat(F.coalesce(hour_txt, F.lit("")), F.coalesce(min_txt, F.lit("")))


def day_start(ts: ColumnOrName) -> Column:
    """``date_trunc('day', ts)`` (S10), keeping the NTZ type."""
    return F.date_trunc("DAY", _c(ts)).cast("timestamp_ntz")


def previous_day_window(ts: ColumnOrName, as_of: _dt.datetime | str) -> Column:
    """``ts`` falls in the calendar day before ``as_of`` (P5): half-open."""
    today = _dt.datetime.combine(_as_date(as_of), _dt.time())
    return (_c(ts) >= lit_ts(today - _dt.timedelta(days=1))) & (_c(ts) < lit_ts(today))


def trailing_days_window(ts: ColumnOrName, as_of: _dt.date | str, days: int) -> Column:
    """``ts`` in ``[as_of - days, as_of)`` (P5)."""
    end = _dt.datetime.combine(_as_date(as_of), _dt.time())
    return (_c(ts) >= lit_ts(end - _dt.timedelta(days=days))) & (_c(ts) < lit_ts(end))


def inclusive_date_window(ts: ColumnOrName, start: _dt.date | str, end: _dt.date | str) -> Column:
    """``cast(ts as date) >= start and < end + 1``."""
    d = F.to_date(_c(ts))
    return (d >= lit_date(start)) & (d < F.date_add(lit_date(end), 1))


def fmt_mdy(c: ColumnOrName) -> Column:
    """``MM/dd/yyyy`` text."""
    return F.date_format(_c(c), "MM/dd/yyyy")


def fmt_mdy_hm(c: ColumnOrName) -> Column:
    """``MM/dd/yyyy HH:mm`` text."""
    return F.date_format(_c(c), "MM/dd/yyyy HH:mm")


def fmt_ymd(c: ColumnOrName) -> Column:
    """``yyyyMMdd`` text."""
    return F.date_format(_c(c), "yyyyMMdd")


def fmt_iso(c: ColumnOrName) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` text, used where a timestamp goes into a list."""
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm:ss")


def null_or_sentinel(ts: ColumnOrName, sentinel: str = "1900-01-01") -> Column:
    """``ts IS NULL OR ts <= 0`` (P10): SQL Server's day 0 is 1900-01-01."""
    return _c(ts).isNull() | (_c(ts) <= lit_ts(sentinel))


def _as_date(v) -> _dt.date:
    if isinstance(v, _dt.datetime):
        return v.date()
    if isinstance(v, _dt.date):
        return v
    return _dt.date.fromisoformat(str(v)[:10])
