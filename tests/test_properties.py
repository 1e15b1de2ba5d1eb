"""Properties from the test strategy: idempotent upsert, one row per key after
dedup, numerator within denominator, one report row per detail row."""
import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from medwright.plans import load, measures, turnaround
from medwright.testing import oracle
from medwright.testing.testmap import tables_for

from .conftest import SF_SMALL

D0 = dt.date(2024, 3, 10)
RUN = dt.datetime(2024, 3, 11, 2, 0, 0)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows_strategy = st.lists(
    st.tuples(st.integers(0, 6), st.sampled_from(["A", "B", "C"]), st.integers(-1, 3)), min_size=0, max_size=25)
target_strategy = st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["X", "Y"])), max_size=8,
                           unique_by=lambda r: r[0])


def _source(spark, rows):
    data = [(k, v, D0 + dt.timedelta(days=d)) for k, v, d in rows]
    return spark.createDataFrame(data, "patientid long, wicresult string, wicresultdate date")


def _target(spark, rows):
    created = dt.datetime(2024, 1, 1)
    schema = load.target_schema(_source(spark, []), "patientid", ["wicresult"])
    return spark.createDataFrame([(k, v, created, created) for k, v in rows], schema)


@SETTINGS
@given(rows=rows_strategy, target=target_strategy)
def test_upsert_twice_equals_once(spark, rows, target):
    src, tgt = _source(spark, rows), _target(spark, target)
    once = load.load_incremental(src, tgt, D0, RUN).target
    twice = load.load_incremental(src, once, D0, RUN).target
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    keys = [r.patientid for r in once.collect()]
    assert len(keys) == len(set(keys))


@SETTINGS
@given(rows=st.lists(st.tuples(st.none() | st.integers(0, 4), st.sampled_from(["A", "B"]), st.integers(0, 1)), max_size=15),
       target=st.lists(st.tuples(st.none() | st.integers(0, 6), st.sampled_from(["X", "Y"])), max_size=8, unique_by=lambda r: r[0]))
def test_null_keys_lose_nothing_and_keep_created_times(spark, rows, target):
    src, tgt = _source(spark, rows), _target(spark, target)
    kept = {r.patientid: r.wicresult for r in load.dedup(load.stage_slice(src, D0), "patientid", ["wicresultdate", "wicresult"]).collect()}
    out = sorted(map(tuple, load.load_incremental(src, tgt, D0, RUN).target.collect()), key=str)
    old = dt.datetime(2024, 1, 1)
    want = [(k, kept[k], old, RUN) if k is not None and k in kept else (k, v, old, old) for k, v in target]
    known = {k for k, _ in target if k is not None}
    want += [(k, v, RUN, RUN) for k, v in kept.items() if k not in known]
    assert out == sorted(want, key=str)


@SETTINGS
@given(rows=rows_strategy)
def test_dedup_one_row_per_key_and_counts(spark, rows):
    staged = load.stage_slice(_source(spark, rows), D0)
    kept = load.dedup(staged, "patientid", ["wicresultdate", "wicresult"]).collect()
    expected_keys = {k for k, _, d in rows if 0 <= d <= 1}
    assert sorted(r.patientid for r in kept) == sorted(expected_keys)
    # each kept row is the maximum (date, value) of its key
    for r in kept:
        best = max((D0 + dt.timedelta(days=d), v) for k, v, d in rows if k == r.patientid and 0 <= d <= 1)
        assert (r.wicresultdate, r.wicresult) == best
    log = load.log_row(staged, "patientid", D0, RUN).first()
    assert log.rows_staged == log.rows_merged + log.duplicate_rows_deleted


def test_numerator_within_denominator(spark):
    t = tables_for(spark, SF_SMALL).measure_tables()
    m = oracle.MEASURE
    for stage in ("pre", "post"):
        r = measures.measure_latest_value(t, m["start"], m["end"], m["as_of"], threshold_stage=stage, with_counts=True).first()
        assert 0 <= r.numerator <= r.denominator
    pre = measures.measure_latest_value(t, m["start"], m["end"], m["as_of"], threshold_stage="pre", with_counts=True).first()
    post = measures.measure_latest_value(t, m["start"], m["end"], m["as_of"], threshold_stage="post", with_counts=True).first()
    assert post.numerator <= pre.numerator   # "ever under" includes "latest under" (K1)
    r = measures.measure_bp_control(t, m["start"], m["end"], m["as_of"], with_counts=True).first()
    assert 0 <= r.numerator <= r.denominator


def test_report_has_one_row_per_detail_row(spark):
    t = tables_for(spark, SF_SMALL).tat_tables()
    tat = oracle.TAT
    for option in (None, "2", "3"):
        detail = turnaround.tat_detail(t, tat["start"], tat["end"], report_option=option)
        report = turnaround.turnaround_report(t, tat["start"], tat["end"], report_option=option, cache=False)
        assert report.count() == detail.count()
        assert report.select("order_id").distinct().count() == report.count()


def test_every_registered_query_has_an_oracle():
    """Of the reports and operators; the optional subpackage gives SQL where SQL can express a query."""
    from medwright.testing import registry
    assert set(registry.queries()) == set(registry.oracle_sql())
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
