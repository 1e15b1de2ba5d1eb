import datetime as dt

from pyspark.sql import functions as F

from medwright import constants as K
from medwright.functions import dates, text


def _one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols.keys())) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_year_boundaries_counts_calendar_years(spark):
    # 2006-12-31 -> 2024-01-01 crosses 18 year boundaries (Spark's whole-year diff says 17)
    assert _one(spark, dates.year_boundaries("a", "b"), a=dt.date(2006, 12, 31), b=dt.date(2024, 1, 1)) == 18


def test_exact_age_birthday_rules(spark):
    age = dates.exact_age("b", "d")
    assert _one(spark, age, b=dt.date(2000, 8, 1), d=dt.date(2018, 8, 1)) == 18   # birthday today
    assert _one(spark, age, b=dt.date(2000, 8, 2), d=dt.date(2018, 8, 1)) == 17   # tomorrow
    assert _one(spark, age, b=dt.date(2000, 2, 29), d=dt.date(2018, 2, 28)) == 18  # 29 Feb clamps to 28 Feb
    assert _one(spark, age, b=dt.date(2000, 2, 29), d=dt.date(2018, 2, 27)) == 17


def test_minute_boundaries_match_sql_server(spark):
    mb = dates.minute_boundaries("a", "b")
    assert _one(spark, mb, a=ts("2024-01-01 10:00:30"), b=ts("2024-01-01 11:00:29")) == 60
    assert _one(spark, mb, a=ts("2024-01-01 10:00:59"), b=ts("2024-01-01 10:01:00")) == 1


def test_duration_text_quirks(spark):
    d = dates.duration_text("a", "b")
    # 59m59s crossing 60 minute marks -> minute part 60
    assert _one(spark, d, a=ts("2024-01-01 10:00:30"), b=ts("2024-01-01 11:00:29")) == "00:60"
    # 9 hours is not padded, 8 is
    assert _one(spark, d, a=ts("2024-01-01 00:00:00"), b=ts("2024-01-01 09:05:00")) == "9:05"
    assert _one(spark, d, a=ts("2024-01-01 00:00:00"), b=ts("2024-01-01 08:05:00")) == "08:05"
    assert _one(spark, d, a=ts("2024-01-01 00:00:00"), b=ts("2024-01-01 12:34:00")) == "12:34"


def test_duration_text_null_is_empty(spark):
    df = spark.createDataFrame([(None, ts("2024-01-01 09:05:00"))], "a timestamp_ntz, b timestamp_ntz")
    assert df.select(dates.duration_text("a", "b").alias("x")).first()["x"] == ""  # K25


def test_null_or_sentinel(spark):
    df = spark.createDataFrame([(None,), (ts("1900-01-01 00:00:00"),), (ts("2020-05-01 00:00:00"),)], "t timestamp_ntz")
    assert [r.x for r in df.select(dates.null_or_sentinel("t").alias("x")).collect()] == [True, True, False]


def test_percent_text(spark):
    pct = text.percent_text("n", "d")
    assert _one(spark, pct, n=158, d=263) == "60.08%"
    assert _one(spark, pct, n=1, d=2) == "50%"
    assert _one(spark, pct, n=263, d=263) == "100%"
    assert _one(spark, pct, n=1, d=0) is None  # K35: no division error


def test_split_pair_malformed_is_null(spark):
    df = spark.createDataFrame([("139/89",), ("14089",), (None,), ("x/90",)], "v string")
    s, d = text.split_pair("v")
    rows = [(r.s, r.d) for r in df.select(s.alias("s"), d.alias("d")).collect()]
    assert rows == [(139, 89), (None, None), (None, None), (None, 90)]


def test_cancer_prefixes(spark):
    df = spark.createDataFrame([(c,) for c in ["C50.9", "D05.1", "D08.0", "D49.9", "D50.0", "D57.1", "E11.9"]], "c string")
    got = [r.c for r in df.filter(text.starts_with_any("c", K.CANCER_ICD10_PREFIXES)).collect()]
    assert got == ["C50.9", "D05.1", "D49.9", "D57.1"]
    assert len(K.CANCER_ICD10_PREFIXES) == 51


def test_concat_null_as_empty(spark):
    df = spark.createDataFrame([(12, None)], "a long, b int")
    assert df.select(text.concat_ws_null_empty("a", F.lit("-"), "b").alias("x")).first()["x"] == "12-"


def test_date_literals_accept_dates_datetimes_and_text(spark):
    for v in (dt.date(2024, 3, 1), dt.datetime(2024, 3, 1, 15, 30), "2024-03-01", "2024-03-01 15:30:00"):
        assert spark.range(1).select(dates.lit_date(v).alias("d")).first().d == dt.date(2024, 3, 1)
    assert spark.range(1).select(dates.lit_ts("2024-03-01 15:30:00").alias("t")).first().t == ts("2024-03-01 15:30:00")
