import random

from pyspark.sql import functions as F

from medwright.operators import aggs
from medwright.operators.windows import latest, latest_any


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latest_matches_window_including_hot_key(spark):
    rnd = random.Random(7)
    # one hot key holds a third of the rows
    data = [(0 if i % 3 == 0 else rnd.randint(1, 50), rnd.randint(0, 20), rnd.randint(0, 5), i) for i in range(3000)]
    df = spark.createDataFrame(data, "k int, t int, line int, v int").repartition(8)
    one = latest(df, "k", ["t", "line", "v"])
    assert _rows(one) == _rows(latest(df, "k", ["t", "line", "v"], method="window"))
    assert one.count() == df.select("k").distinct().count()
    allties = latest(df, "k", "t", ties="all")
    assert _rows(allties) == _rows(latest(df, "k", "t", ties="all", method="window"))


def test_latest_nulls_sort_last(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 5, "b"), (2, None, "c")], "k int, t int, v string")
    assert _rows(latest(df, "k", "t")) == [(1, 5, "b"), (2, None, "c")]
    assert _rows(latest(df, "k", "t", ties="all")) == [(1, 5, "b"), (2, None, "c")]


def test_aligned_lists_line_up_and_skip_nulls(spark):
    df = spark.createDataFrame([(1, 3, "c", 30), (1, 1, "a", None), (1, 2, None, 20), (2, None, None, None)],
                               "g int, id int, name string, cls int")
    lists = aggs.aligned_lists("id", {"ids": "id", "names": "name", "classes": "cls"}, "; ")
    out = {r.g: r for r in df.groupBy("g").agg(*[c.alias(n) for n, c in lists.items()]).collect()}
    assert (out[1].ids, out[1].names, out[1].classes) == ("1; 2; 3", "a; c", "20; 30")
    assert (out[2].ids, out[2].names, out[2].classes) == (None, None, None)


def test_string_agg_sorted_with_duplicates(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None)], "g int, c string")
    out = {r.g: r.s for r in df.groupBy("g").agg(aggs.string_agg("c", "; ").alias("s")).collect()}
    assert out == {1: "a; b; b", 2: None}


def test_int_avg_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1, -7), (1, 0), (2, 7), (2, 0), (3, None)], "g int, x int")
    out = {r.g: r.a for r in df.groupBy("g").agg(aggs.int_avg("x").alias("a")).collect()}
    assert out == {1: -3, 2: 3, 3: None}


def test_count_flag(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (3, None)], "g int, m int")
    out = {r.g: r.f for r in df.groupBy("g").agg(aggs.count_flag("m").alias("f")).collect()}
    assert out == {1: 0, 2: 1, 3: 1}


def test_pivot_max(spark):
    df = spark.createDataFrame([(1, 30, "x"), (1, 45, "y"), (1, 30, "z")], "g int, t int, v string")
    r = df.groupBy("g").agg(aggs.pivot_max("t", "v", 30).alias("e"), aggs.pivot_max("t", "v", 60).alias("n")).first()
    assert (r.e, r.n) == ("z", None)


def test_latest_any_equals_dense_rank_then_filter(spark):
    rnd = random.Random(11)
    data = [(0 if i % 3 == 0 else rnd.randint(1, 40), rnd.choice([None] + list(range(6))), rnd.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(data, "k int, t int, v int")
    pred = F.col("v") >= 2
    got = sorted(r.k for r in latest_any(df, "k", "t", pred).filter("passes").collect())
    ranked = latest(df, "k", "t", ties="all", method="window").filter(pred).select("k").distinct()
    assert got == sorted(r.k for r in ranked.collect())
