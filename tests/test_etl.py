import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from medwright.plans import load, schema_gate
from medwright.session import shared_dir
from medwright.sources import sinks

SRC_SCHEMA = "patientid long, wicresult string, wicresultdate date"
D = dt.date(2024, 3, 10)
RUN = dt.datetime(2024, 3, 11, 2, 0, 0)


def _source(spark):
    rows = [
        (1, "A", D), (1, "B", D + dt.timedelta(days=1)), (1, "C", D),   # three rows for one patient
        (2, "N", D),                                                     # patient already in the target
        (3, "P", D + dt.timedelta(days=1)),                              # new patient, next-day row
        (4, "Q", D + dt.timedelta(days=2)),                              # outside the window
    ]
    return spark.createDataFrame(rows, SRC_SCHEMA)


def _target(spark):
    created = dt.datetime(2024, 1, 1, 0, 0, 0)
    return spark.createDataFrame([(2, "OLD", created, created), (9, "KEEP", created, created)],
                                 load.target_schema(_source(spark), "patientid", ["wicresult"]))


def _by_key(df):
    return {r.patientid: r for r in df.collect()}


def test_load_incremental_upsert_and_log(spark):
    res = load.load_incremental(_source(spark), _target(spark), D, RUN)
    t = _by_key(res.target)
    assert set(t) == {1, 2, 3, 9}
    assert t[1].wicresult == "B" and t[1].createddatetime == RUN           # latest by date, inserted
    assert t[2].wicresult == "N" and t[2].createddatetime.year == 2024 and t[2].createddatetime.month == 1
    assert t[2].lastupdateddatetime == RUN                                 # matched: created kept, updated refreshed
    assert t[9].wicresult == "KEEP" and t[9].lastupdateddatetime.month == 1
    log = res.log.first()
    assert (log.rows_staged, log.duplicate_rows_deleted, log.rows_merged, log.status) == (5, 2, 3, "Success")


def test_load_is_idempotent(spark):
    once = load.load_incremental(_source(spark), _target(spark), D, RUN).target
    twice = load.load_incremental(_source(spark), once, D, RUN).target
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_null_keys_match_nothing_and_lose_nothing(spark):
    created = dt.datetime(2024, 1, 1)
    target = spark.createDataFrame([(None, "OLD", created, created), (2, "T", created, created)],
                                   load.target_schema(_source(spark), "patientid", ["wicresult"]))
    source = spark.createDataFrame([(None, "NEW", D), (2, "U", D)], SRC_SCHEMA)
    out = sorted(map(tuple, load.load_incremental(source, target, D, RUN).target.collect()), key=str)
    assert sorted(out, key=lambda r: r[1]) == [(None, "NEW", RUN, RUN), (None, "OLD", created, created), (2, "U", created, RUN)]


def test_run_load_with_another_key_and_retention(spark):
    root, log_path = shared_dir(spark, "target"), shared_dir(spark, "log")
    src = spark.createDataFrame([("m1", 5, D), ("m1", 7, D), ("m2", 1, D)], "mrn string, level int, taken date")
    kw = dict(key="mrn", order=("taken", "level"), value_cols=("level",), date_col="taken")
    for day in range(3):
        load.run_load(spark, src, root, log_path, D, RUN + dt.timedelta(days=day), keep_snapshots=2, **kw)
    assert sorted((r.mrn, r.level) for r in sinks.read_table(spark, root).collect()) == [("m1", 7), ("m2", 1)]
    assert len([d for d in os.listdir(root.removeprefix("file:").removeprefix("//")) if d.startswith("snap-")]) == 2


def test_failed_load_reports_the_counts_it_reached(spark):
    root, log_path = shared_dir(spark, "target"), shared_dir(spark, "log")

    def gate(_):
        raise RuntimeError("injected")

    with pytest.raises(RuntimeError):
        load.run_load(spark, _source(spark), root, log_path, D, RUN, gate=gate)
    row = spark.read.parquet(log_path).first()
    assert (row.rows_staged, row.rows_merged, row.status) == (5, 0, "Failed")


def test_failed_log_append_leaves_the_old_target(spark, monkeypatch):
    root, log_path = shared_dir(spark, "target"), shared_dir(spark, "log")
    load.run_load(spark, _source(spark), root, log_path, D, RUN)
    before = sinks.current_snapshot(spark, root)
    real = load._append_log

    def failing(*a):
        if a[-2] == "Success":
            raise OSError("log unavailable")
        real(*a)

    monkeypatch.setattr(load, "_append_log", failing)
    with pytest.raises(OSError):
        load.run_load(spark, _source(spark), root, log_path, D, RUN)
    assert sinks.current_snapshot(spark, root) == before
    assert sorted(r.status for r in spark.read.parquet(log_path).collect()) == ["Failed", "Success"]


def test_declared_lengths_come_from_the_catalog(spark):
    spark.sql(f"CREATE TABLE vendor_lengths (PatientID INT, WICResult VARCHAR(20), WICResultDate DATE) USING parquet LOCATION '{shared_dir(spark, 'vendor')}'")
    try:
        table = spark.table("vendor_lengths")
        assert schema_gate.declared_lengths(table) == {"WICResult": 20}
        act = schema_gate.actual_columns(table, "dbo", "PatientWIC_Source", schema_gate.declared_lengths(table))
        detail = schema_gate.validate_schema(schema_gate.expected_schema(spark), act, length_rule="declared").collect()
        assert [r.column_name for r in detail if r.is_wrong_length] == ["WICResult"]
    finally:
        spark.sql("DROP TABLE vendor_lengths")


def test_dedup_keeps_one_row_per_key(spark):
    staged = load.stage_slice(_source(spark), D)
    kept = load.dedup(staged, "patientid", ["wicresultdate", "wicresult"])
    assert kept.count() == kept.select("patientid").distinct().count() == 3


def test_closed_left_window(spark):
    assert load.stage_slice(_source(spark), D, closed="left").count() == 3


def test_run_load_publishes_and_logs(spark):
    root, log_path = shared_dir(spark, "target"), shared_dir(spark, "log")
    out = load.run_load(spark, _source(spark), root, log_path, D, RUN)
    assert out == {"rows_staged": 5, "duplicate_rows_deleted": 2, "rows_merged": 3, "status": "Success"}
    first = sinks.current_snapshot(spark, root)
    assert sinks.read_table(spark, root).count() == 3
    # second day: one matched patient
    src2 = spark.createDataFrame([(3, "P2", D + dt.timedelta(days=5))], SRC_SCHEMA)
    load.run_load(spark, src2, root, log_path, D + dt.timedelta(days=5), RUN + dt.timedelta(days=5))
    assert sinks.current_snapshot(spark, root) != first
    t = _by_key(sinks.read_table(spark, root))
    assert t[3].wicresult == "P2" and t[3].createddatetime == RUN
    assert spark.read.parquet(log_path).filter(F.col("status") == "Success").count() == 2


def test_failed_load_leaves_target_and_logs_failure(spark):
    root, log_path = shared_dir(spark, "target"), shared_dir(spark, "log")
    load.run_load(spark, _source(spark), root, log_path, D, RUN)
    before = sinks.current_snapshot(spark, root)

    def failing_gate(_):
        raise RuntimeError("injected")

    with pytest.raises(RuntimeError):
        load.run_load(spark, _source(spark), root, log_path, D + dt.timedelta(days=1), RUN, gate=failing_gate)
    assert sinks.current_snapshot(spark, root) == before
    failed = spark.read.parquet(log_path).filter(F.col("status") == "Failed").collect()
    assert len(failed) == 1 and failed[0].load_date == D + dt.timedelta(days=1)  # real load date (K29)


def _gate_detail(spark, df, length_rule="observed"):
    exp = schema_gate.expected_schema(spark)
    act = schema_gate.actual_columns(df, "dbo", "PatientWIC_Source")
    return {r.column_name: r for r in schema_gate.validate_schema(exp, act, length_rule=length_rule).collect()}


def test_schema_gate_exact_match_passes(spark):
    df = spark.createDataFrame([(1, "x" * 50, D)], "PatientID int, WICResult string, WICResultDate date")
    assert not any(r.is_mismatch for r in _gate_detail(spark, df).values())
    schema_gate.assert_schema(schema_gate.expected_schema(spark),
                              schema_gate.actual_columns(df, "dbo", "PatientWIC_Source"))


def test_schema_gate_failures(spark):
    missing = spark.createDataFrame([(1, D)], "PatientID int, WICResultDate date")
    assert _gate_detail(spark, missing)["WICResult"].is_missing
    wrong_type = spark.createDataFrame([("1", "x", D)], "PatientID string, WICResult string, WICResultDate date")
    assert _gate_detail(spark, wrong_type)["PatientID"].is_wrong_type
    too_long = spark.createDataFrame([(1, "x" * 51, D)], "PatientID int, WICResult string, WICResultDate date")
    assert _gate_detail(spark, too_long)["WICResult"].is_wrong_length
    with pytest.raises(schema_gate.SchemaMismatch):
        schema_gate.assert_schema(schema_gate.expected_schema(spark),
                                  schema_gate.actual_columns(too_long, "dbo", "PatientWIC_Source"))


def test_schema_gate_declared_lengths_and_extras(spark):
    df = spark.createDataFrame([(1, "x", D, "extra")], "PatientID int, WICResult string, WICResultDate date, Extra string")
    exp = schema_gate.expected_schema(spark)
    act = schema_gate.actual_columns(df, "dbo", "PatientWIC_Source", declared_lengths={"WICResult": 40})
    detail = {r.column_name: r for r in schema_gate.validate_schema(exp, act, length_rule="declared").collect()}
    assert detail["WICResult"].is_wrong_length
    assert [r.column_name for r in schema_gate.extra_columns(exp, act).collect()] == ["Extra"]


def test_csv_extract_roundtrip(spark):
    path = shared_dir(spark, "extract")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "order_id int, region string")
    sinks.write_extract(df, path, single_file=True)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["order_id", "region"] and back.count() == 2


def test_failed_snapshot_write_keeps_previous_snapshot(spark):
    root = shared_dir(spark, "target")
    first = sinks.publish_snapshot(spark.createDataFrame([(1, "a")], "k int, v string"), root)
    bad = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").withColumn(
        "v", F.when(F.col("k") == 2, F.raise_error(F.lit("injected write failure"))).otherwise(F.col("v")))
    with pytest.raises(Exception):
        sinks.publish_snapshot(bad, root)
    assert sinks.current_snapshot(spark, root) == first
    assert [tuple(r) for r in sinks.read_table(spark, root).collect()] == [(1, "a")]
