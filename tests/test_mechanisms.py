"""How loads and reports run: buckets, temp tables, the SQL procedure, SQL text, rule tables, the gate in a write, schemas, dates."""
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from medwright import constants as K
from medwright.operators import joins
from medwright.plans import load, outreach, parameterised, schema_gate, turnaround
from medwright.plans.procedure import LoadProcedure, load_script
from medwright.session import release, shared_dir
from medwright.sources import buckets, dated, sinks
from medwright.sources.namespaces import mounted, tables_from
from medwright.sources.temptables import TempTable, stored_once, temp_table
from medwright.testing import compare, mechanisms, oracle, registry
from medwright.testing.testmap import tables_for

from .conftest import SF_SMALL
from .test_etl import D, RUN, SRC_SCHEMA, _source, _target


def local(path):
    return path.removeprefix("file:").removeprefix("//")


def files(spark, path):
    fs, p = sinks._fs(spark, path)
    return fs.exists(p)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def executed(df):
    """The final plan of a query that has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan()


# ------------------------------------------------------------------ buckets


@pytest.fixture()
def bucketed_target(spark):
    root = shared_dir(spark, "target")
    buckets.publish(spark, root, buckets.write_bucketed(_target(spark).repartition(8, "patientid"), root, "patientid", 8))
    return root


def test_daily_load_does_not_shuffle_a_bucketed_target(spark):
    root = mechanisms.bucketed_load(spark, SF_SMALL)
    target = buckets.read_bucketed(spark, root)
    src = tables_for(spark, SF_SMALL).patientwic_source
    merged = load.load_incremental(src, target, oracle.LOAD["load_date"], oracle.LOAD["run_ts"]).target
    plan = executed(merged).toString()
    final = plan.split("== Initial Plan ==")[0]
    join = final.index("SortMergeJoin")
    sides = final[join:].split("FileScan parquet")
    target_side = next(s for s in sides if "createddatetime" in s or "_tc" in s)
    assert "Bucketed: true" in final and "SelectedBucketsCount: 16 out of 16" in final
    assert "Exchange" not in target_side, target_side
    assert final.count("Exchange hashpartitioning") == 2  # the slice: its aggregation, and once into the target's buckets
    snapshot = sinks.current_snapshot(spark, root)
    fs, p = sinks._fs(spark, snapshot)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    in_bucket = [n for n in names if re.search(r"_\d{5}\.c", n)]
    assert len(in_bucket) <= 16, "a bucket is one file: no task wrote into another's"


def test_bucketed_load_equals_the_plain_one_with_null_keys_and_reruns(spark, bucketed_target):
    plain, logs = shared_dir(spark, "plain"), shared_dir(spark, "log")
    created = dt.datetime(2024, 1, 1)
    extra = spark.createDataFrame([(None, "OLD", created, created)], load.target_schema(_source(spark), "patientid", ["wicresult"]))
    first = _target(spark).unionByName(extra)
    buckets.publish(spark, bucketed_target, buckets.write_bucketed(first.repartition(8, "patientid"), bucketed_target, "patientid", 8))
    sinks.publish_snapshot(first, plain)
    source = _source(spark).unionByName(spark.createDataFrame([(None, "NEW", D)], SRC_SCHEMA))
    for day in range(2):
        when = RUN + dt.timedelta(days=day)
        a = load.run_load(spark, source, plain, logs, D, when)
        b = load.run_load(spark, source, bucketed_target, logs, D, when, buckets=8, keep_snapshots=2)
        assert a == b
        assert rows(sinks.read_table(spark, plain)) == rows(buckets.read_bucketed(spark, bucketed_target))
    assert sum(r[0] is None for r in rows(buckets.read_bucketed(spark, bucketed_target))) == 3  # the stored one and one of each run


def test_io8_returns_the_whole_target_after_the_rerun(spark):
    sf = "/root/testdata/sf0.01"  # the day has a NULL key here
    got = mechanisms.io8(spark, sf)
    whole, once = rows(got), rows(mechanisms.io7(spark, sf))
    null_key = [r for r in once if r[0] is None and r[2] == r[3] == mechanisms.RUN_TS]
    assert len(null_key) == 1 and whole == sorted(once + null_key, key=str)
    stamps = {(r[2] == mechanisms.RUN_TS, r[3] == mechanisms.RUN_TS) for r in whole}
    assert stamps == {(False, False), (False, True), (True, True)}  # kept, refreshed and new rows
    con = compare.duckdb_connection(sf)
    assert compare.compare(got, con, registry.oracle_sql()["IO8"])["match"]


def test_a_failed_load_leaves_the_bucketed_target(spark, bucketed_target):
    before = sinks.pointer(spark, bucketed_target)

    def gate(_):
        raise RuntimeError("injected")

    logs = shared_dir(spark, "log")
    with pytest.raises(RuntimeError):
        load.run_load(spark, _source(spark), bucketed_target, logs, D, RUN, gate=gate, buckets=8)
    assert sinks.pointer(spark, bucketed_target) == before
    assert spark.read.parquet(logs).first().status == "Failed"


def test_a_plain_target_moves_into_buckets_and_their_number_can_change(spark):
    root, logs = shared_dir(spark, "target"), shared_dir(spark, "log")
    sinks.publish_snapshot(_target(spark), root)
    for n in (4, 8, None):
        load.run_load(spark, _source(spark), root, logs, D, RUN, buckets=n)
        assert {r[0] for r in rows(load.live_target(spark, root, None, "patientid", n))} == {1, 2, 3, 9}
        assert sinks.pointer(spark, root).get("buckets") == n


def test_first_load_into_buckets_starts_from_nothing(spark):
    root, logs = shared_dir(spark, "target"), shared_dir(spark, "log")
    assert buckets.read_bucketed(spark, root) is None
    load.run_load(spark, _source(spark), root, logs, D, RUN, buckets=4)
    assert [r[0] for r in rows(buckets.read_bucketed(spark, root))] == [1, 2, 3]
    with pytest.raises(ValueError):
        load.run_load(spark, _source(spark), root, logs, D, RUN, buckets=4, partition_by=["wicresult"])


def test_bucketed_snapshots_leave_nothing_in_the_catalog(spark, bucketed_target):
    buckets.read_bucketed(spark, bucketed_target).count()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bucketed_")]


# -------------------------------------------------------------- temp tables


def cached(spark):
    return not spark._jsparkSession.sharedState().cacheManager().isEmpty()


REPORTS = [k for k in entry.queries() if re.match(r"Q\d", k)]


def test_no_report_leaves_anything_cached(spark):
    for name in REPORTS:
        entry.queries()[name](spark, SF_SMALL).write.format("noop").mode("overwrite").save()
        assert not cached(spark), name


def test_reports_built_first_do_not_change_the_plans_of_later_ones(spark):
    t = tables_for(spark, SF_SMALL).tat_tables()
    plan = lambda: turnaround.tat_detail(t, oracle.TAT["start"], oracle.TAT["end"])._jdf.queryExecution().optimizedPlan().toString()
    entry.queries()["Q8"](spark, SF_SMALL).count()
    assert "InMemoryRelation" not in plan()


def test_scope_drops_view_and_folder_also_on_error(spark):
    with temp_table(spark.range(5), "ids") as ids:
        assert spark.table(ids.view).count() == ids.df.count() == 5 and files(spark, ids.path)
    assert not spark.catalog.tableExists(ids.view) and not files(spark, ids.path)
    with pytest.raises(RuntimeError):
        with temp_table(spark.range(5), "ids") as ids:
            raise RuntimeError("in the scope")
    assert not spark.catalog.tableExists(ids.view) and not files(spark, ids.path)


def test_a_write_that_fails_leaves_no_folder(spark, monkeypatch):
    made = []
    monkeypatch.setattr("medwright.sources.temptables.shared_dir", lambda *a: made.append(shared_dir(*a)) or made[-1])
    with pytest.raises(Exception, match="injected"):
        TempTable(spark.range(5).select(F.raise_error(F.lit("injected")).cast("int").alias("x")), "bad")
    assert not files(spark, made[0])


def test_a_report_that_cannot_be_built_drops_its_table(spark, monkeypatch):
    made = []
    monkeypatch.setattr("medwright.sources.temptables.shared_dir", lambda *a: made.append(shared_dir(*a)) or made[-1])
    with pytest.raises(KeyError):
        stored_once(spark.range(3), "x", lambda df: {}["missing"])
    assert not files(spark, made[0])


def test_release_drops_what_the_report_stored(spark):
    report = entry.queries()["Q8"](spark, SF_SMALL)
    (table,) = report.temp_tables
    n = report.count()
    assert n > 0 and files(spark, table.path)
    release(report)
    assert not files(spark, table.path) and report.temp_tables == []


def test_the_event_log_is_cut_by_the_links_of_the_window_alone(spark):
    """What the log meets is two inputs, not the detail's joins a second time."""
    t = tables_for(spark, SF_SMALL).tat_tables()
    lines = turnaround.tat_detail(t, oracle.TAT["start"], oracle.TAT["end"])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    agg = next(i for i, x in enumerate(lines) if "Aggregate [action_id" in x and "user_id" in x)
    below = []
    for x in lines[agg + 1:]:
        if depth(x) <= depth(lines[agg]):
            break
        below.append(x)
    assert sum("Join" in x for x in below) == 2 and all("LeftSemi" in x for x in below if "Join" in x)


# ------------------------------------------------------------- SQL procedure


@pytest.fixture()
def procedure(spark):
    with mounted(spark, {"etl": {}}) as schema:
        db = schema["etl"]
        _source(spark).createOrReplaceTempView("wic_source_for_procedure")
        p = LoadProcedure(spark, "wic_source_for_procedure", f"{db}.target", f"{db}.log")
        p.create(_target(spark))
        yield p
    spark.catalog.dropTempView("wic_source_for_procedure")


def test_procedure_equals_the_dataframe_load(spark, procedure):
    procedure.call(D, RUN)
    want = load.load_incremental(_source(spark), _target(spark), D, RUN)
    assert rows(spark.table(procedure.target)) == rows(want.target)
    assert rows(spark.table(procedure.log)) == rows(want.log)
    once = rows(spark.table(procedure.target))
    procedure.call(D, RUN)
    assert rows(spark.table(procedure.target)) == once  # a rerun changes nothing but the log
    assert spark.table(procedure.log).count() == 2


def test_procedure_logs_raises_and_keeps_the_target(spark, procedure):
    before = rows(spark.table(procedure.target))
    with pytest.raises(Exception, match="audit log"):
        procedure.call(D, RUN, max_length=0)
    assert rows(spark.table(procedure.target)) == before
    (log,) = spark.table(procedure.log).collect()
    assert (log.rows_staged, log.duplicate_rows_deleted, log.rows_merged, log.status, log.load_date, log.run_datetime) == (5, 0, 0, "Failed", D, RUN)
    left = [t.name for t in spark.catalog.listTables(procedure.target.split(".")[0])]
    assert not [n for n in left if "stage" in n or "kept" in n] and sum("snap" in n for n in left) == 1
    procedure.call(D, RUN, max_length=9)
    assert [r.status for r in spark.table(procedure.log).orderBy("status").collect()] == ["Failed", "Success"]


def test_procedure_fails_late_without_publishing(spark, procedure):
    """The source disappears after the target was set up: the handler still logs and raises."""
    before = rows(spark.table(procedure.target))
    broken = LoadProcedure(spark, "no_such_source", procedure.target, procedure.log)
    with pytest.raises(Exception, match="audit log"):
        broken.call(D, RUN)
    assert rows(spark.table(procedure.target)) == before
    assert [tuple(r)[2:6] for r in spark.table(procedure.log).collect()] == [(0, 0, 0, "Failed")]


def test_names_are_identifiers_values_are_not_text(spark):
    with pytest.raises(ValueError):
        LoadProcedure(spark, "s; DROP TABLE x", "t", "l")
    with pytest.raises(ValueError):
        load_script("patient id", ["v"], ["v"], "d")


# ------------------------------------------------------- parameterised text


@pytest.mark.parametrize("option,flags,pharmacies", [(None, None, None), ("1", [], []), ("2", None, None), ("3", None, None), ("3", mechanisms.SOME_FLAGS, None),
                                                     (None, mechanisms.SOME_FLAGS, [0, 3, 20]), (None, None, [3, None, ""]), ("4", None, None)])
def test_sql_text_equals_the_dataframe_report(spark, option, flags, pharmacies):
    t = tables_for(spark, SF_SMALL).tat_tables()
    args = (oracle.TAT["start"], oracle.TAT["end"], pharmacies, flags, option)
    want = turnaround.tat_detail(t, *args)
    got = parameterised.turnaround_detail(spark, t, *args)
    assert rows(got.select(want.columns)) == rows(want)
    if option == "4":
        assert got.count() == 0


def test_a_quote_in_a_value_is_a_character(spark):
    t = tables_for(spark, SF_SMALL).tat_tables()
    hostile = ["90024' OR '1'='1", "x') OR 1=1 --", ":flags", "{flag_info}"]
    assert parameterised.turnaround_detail(spark, t, oracle.TAT["start"], oracle.TAT["end"], None, hostile).count() == 0
    assert parameterised.turnaround_detail(spark, t, oracle.TAT["start"], oracle.TAT["end"], None, None, "1' OR '1'='1").count() == 0


def test_an_empty_list_leaves_no_predicate(spark):
    t = tables_for(spark, SF_SMALL).tat_tables()
    plan = parameterised.turnaround_detail(spark, t, oracle.TAT["start"], oracle.TAT["end"])._jdf.queryExecution().optimizedPlan().toString()
    assert "record_id" not in plan and "rx_resolv_flag_id" not in plan  # the flag tables are not read at all


# ----------------------------------------------- rule and exclusion tables


def rules_by_loop(pairs, groups):
    def passes(pos, payer):
        for g in groups:
            if pos in g["pos_ids"]:
                out = g["excluded_payors"]
                if not out or (payer is not None and None not in out and payer not in out):
                    return True
        return False
    return sorted(((p, q) for p, q in pairs if p is not None and passes(p, q)), key=str)


@pytest.mark.parametrize("groups", [
    [{"pos_ids": [1, 1], "excluded_payors": ["A", "A", "B"]}, {"pos_ids": [1, 2], "excluded_payors": ["B", "C"]}],
    [{"pos_ids": [1], "excluded_payors": ["A", None]}, {"pos_ids": [2], "excluded_payors": []}, {"pos_ids": [3], "excluded_payors": [None]}],
    [{"pos_ids": list(range(1, 4)), "excluded_payors": [f"P{i}" for i in range(3000)] + ["A"]}],
    [],
])
def test_rule_table(spark, groups):
    pairs = [(p, q) for p in (1, 2, 3, None) for q in ("A", "B", "C", "D", None)] * 2
    df = spark.createDataFrame(pairs, "pos_id long, payor_name string")
    rules = outreach.RuleTable.of(spark, groups)
    got = outreach.allowed_payers(df, rules, "pos_id", "payor_name")
    assert got.columns == ["pos_id", "payor_name"] and rows(got) == rules_by_loop(pairs, groups)


def test_rule_table_equals_the_report_rules(spark):
    pairs = [(12345, p) for p in {p for g in K.OUTREACH_REGION_RULES for p in g["excluded_payors"]} | {"OTHER"}] + [(1, "OTHER"), (12345, None)]
    df = spark.createDataFrame(pairs, "pos_id long, payor_name string")
    want = df.filter(outreach.region_payer_rule(K.OUTREACH_REGION_RULES, F.col("pos_id"), F.col("payor_name")))
    got = outreach.allowed_payers(df, outreach.RuleTable.of(spark, K.OUTREACH_REGION_RULES), "pos_id", "payor_name")
    assert rows(got) == rows(want)
    common = set(K.OUTREACH_REGION_RULES[0]["excluded_payors"]) & set(K.OUTREACH_REGION_RULES[1]["excluded_payors"])
    assert {p for _, p in pairs if p} - {r.payor_name for r in got.collect()} == common  # K12: only what both exclude


def test_rules_as_a_table_do_not_multiply_rows(spark):
    many = [{"pos_ids": [1], "excluded_payors": [f"X{i}"]} for i in range(50)]
    df = spark.createDataFrame([(1, "A"), (1, "X3")], "pos_id long, payor_name string")
    assert rows(outreach.allowed_payers(df, outreach.RuleTable.of(spark, many), "pos_id", "payor_name")) == [(1, "A"), (1, "X3")]


@pytest.mark.parametrize("listed,want", [([1, 2], [3]), ([1, 1, None], []), ([], [1, 2, 3, None]), ([None], []), ([9], [1, 2, 3])])
def test_not_in_table(spark, listed, want):
    df = spark.createDataFrame([(1,), (2,), (3,), (None,)], "x int")
    out = joins.not_in_table(df, "x", spark.createDataFrame([(v,) for v in listed], "y int"), "y")
    assert rows(out) == sorted(((v,) for v in want), key=str)
    df.createOrReplaceTempView("nit_rows")
    spark.createDataFrame([(v,) for v in listed], "y int").createOrReplaceTempView("nit_list")
    assert rows(out) == rows(spark.sql("SELECT x FROM nit_rows WHERE x NOT IN (SELECT y FROM nit_list)"))


def test_not_in_table_is_an_anti_join_on_the_value(spark):
    plan = entry.queries()["P8_table"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    join = next(x for x in plan.splitlines() if "LeftAnti" in x)
    assert "isnull" not in join and "OR" not in join  # a plain equi-join: it may be shuffled, whatever the list's size


# --------------------------------------------------------- gate in the write


def test_gate_counts_in_the_write_and_the_pointer_stays(spark):
    root, logs = shared_dir(spark, "target"), shared_dir(spark, "log")
    live = sinks.publish_snapshot(_target(spark), root)
    source = _source(spark).unionByName(spark.createDataFrame([(7, "TOO LONG", D), (8, "TOO LONG TOO", D)], SRC_SCHEMA)).repartition(5)
    with pytest.raises(schema_gate.SchemaMismatch) as failed:
        load.run_load(spark, source, root, logs, D, RUN, gate=schema_gate.InPlanGate(mechanisms.NARROW))
    assert failed.value.details == [{"column_name": "wicresult", "bad_rows": 2}]
    assert sinks.current_snapshot(spark, root) == live
    assert [(r.rows_staged, r.status) for r in spark.read.parquet(logs).collect()] == [(7, "Failed")]


def test_first_bad_value_fails_the_write(spark):
    root, logs = shared_dir(spark, "target"), shared_dir(spark, "log")
    live = sinks.publish_snapshot(_target(spark), root)
    source = _source(spark).unionByName(spark.createDataFrame([(7, "TOO LONG", D)], SRC_SCHEMA)).repartition(5)
    with pytest.raises(Exception, match="8 characters, at most 4 expected"):
        load.run_load(spark, source, root, logs, D, RUN, gate=schema_gate.InPlanGate(mechanisms.NARROW, fail="first"))
    assert sinks.current_snapshot(spark, root) == live
    assert [(r.rows_staged, r.status) for r in spark.read.parquet(logs).collect()] == [(0, "Failed")]


@pytest.mark.parametrize("fail", ["count", "first"])
def test_gate_in_the_write_lets_good_rows_through(spark, fail):
    root, logs = shared_dir(spark, "target"), shared_dir(spark, "log")
    gate = schema_gate.InPlanGate(mechanisms.NARROW, fail=fail)
    rows_with_null = _source(spark).unionByName(spark.createDataFrame([(5, None, D)], SRC_SCHEMA))
    load.run_load(spark, rows_with_null, root, logs, D, RUN, gate=gate)
    assert {r[0] for r in rows(sinks.read_table(spark, root))} == {1, 2, 3, 5}
    assert gate.counts() == ({"wicresult": 0} if fail == "count" else {})


def test_gate_sees_missing_columns_and_wrong_types_before_any_row(spark):
    gate = schema_gate.InPlanGate(K.VENDOR_EXPECTED_SCHEMA)
    untouched = spark.range(3).select(F.raise_error(F.lit("read")).cast("long").alias("PatientID"))
    with pytest.raises(schema_gate.SchemaMismatch) as failed:
        gate.over(untouched)
    assert [(d["column_name"], d["is_missing"], d["actual_data_type"]) for d in failed.value.details] == [
        ("PatientID", False, "bigint"), ("WICResult", True, None), ("WICResultDate", True, None)]
    with pytest.raises(ValueError):
        schema_gate.InPlanGate(fail="never")


# ------------------------------------------------------------------- schemas


def test_two_schemas_in_one_query_are_dropped_and_the_rows_stay(spark):
    paths = {n: shared_dir(spark, "t", n) for n in ("fact", "dim")}
    spark.createDataFrame([(1, 10), (2, 20)], "k int, v int").write.parquet(paths["fact"])
    spark.createDataFrame([(1, "a")], "k int, name string").write.parquet(paths["dim"])
    with mounted(spark, {"wh": {"fact": paths["fact"]}, "op": {"dim": paths["dim"]}}) as s:
        t = tables_from(spark, ["fact", "dim"], list(s.values()))
        out = t["fact"].join(t["dim"], "k")
        assert rows(spark.sql(f"SELECT v, name FROM {s['wh']}.fact JOIN {s['op']}.dim USING (k)")) == [(10, "a")]
        with pytest.raises(ValueError, match="0 of the schemas"):
            tables_from(spark, ["other"], list(s.values()))
        with pytest.raises(ValueError, match="2 of the schemas"):
            tables_from(spark, ["dim"], [s["op"], s["op"]])
        assert rows(tables_from(spark, ["dim"], {"dim": s["op"]})["dim"]) == [(1, "a")]
    assert not [d.name for d in spark.catalog.listDatabases() if d.name in s.values()]
    assert rows(out) == [(1, 10, "a")]
    with pytest.raises(RuntimeError):
        with mounted(spark, {"wh": {"fact": paths["fact"]}}) as s:
            raise RuntimeError("in the block")
    assert not [d.name for d in spark.catalog.listDatabases() if d.name in s.values()]


def test_catalog_objects_of_the_queries_are_dropped(spark):
    before = {d.name for d in spark.catalog.listDatabases()}, {t.name for t in spark.catalog.listTables() if not t.isTemporary}
    for key in ("IO2", "U1", "IO7", "Q5_declared"):
        entry.queries()[key](spark, SF_SMALL).count()
    assert before == ({d.name for d in spark.catalog.listDatabases()}, {t.name for t in spark.catalog.listTables() if not t.isTemporary})


# --------------------------------------------------------------------- dates


def scan_metrics(df):
    """Of each file scan of a query that has run: its text and metrics."""
    out = []

    def walk(node):
        while (kind := node.getClass().getSimpleName()) == "AdaptiveSparkPlanExec" or kind.endswith("QueryStageExec"):
            node = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            found = node.metrics()
            out.append((node.simpleString(1000), {k: found.apply(k).value() for k in ("numFiles", "numPartitions") if found.contains(k)}))
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(executed(df))
    return out


@pytest.fixture(scope="module")
def by_day(spark):
    start = dt.datetime(2024, 3, 1)
    days = [(i, start + dt.timedelta(hours=8 * i)) for i in range(90)] + [(1000 + i, start) for i in range(300)] + [(-1, None)]
    df = spark.createDataFrame(days, "k int, at timestamp_ntz").repartition(4)
    path = dated.write_dated(df, shared_dir(spark, "dated"), "at")
    return df, dated.read_dated(spark, path, df.schema, "at")


def test_window_reads_the_partitions_of_its_dates_only(spark, by_day):
    df, table = by_day
    got = dated.in_window(table, "at", "2024-03-05 08:00:00", "2024-03-07 00:00:00", closed="left")
    want = df.filter("at >= timestamp_ntz'2024-03-05 08:00:00' AND at < timestamp_ntz'2024-03-07 00:00:00'")
    assert rows(got.select("k", "at")) == rows(want) and want.count() == 5
    ((scan, metrics),) = scan_metrics(got)
    assert re.search(r"PartitionFilters: \[[^\]]*at_day", scan)
    assert metrics["numPartitions"] == 3 and metrics["numFiles"] <= 3 * 4
    assert rows(table.select("k", "at")) == rows(df)  # the row without a date is kept


def test_days_from_a_table_prune_while_the_query_runs(spark, by_day):
    df, table = by_day
    spark.createDataFrame([(dt.date(2024, 3, 4), "x"), (dt.date(2024, 3, 9), "x"), (dt.date(2024, 3, 20), "y")], "day date, run string").write.mode("overwrite").parquet(p := shared_dir(spark, "runs"))
    runs = spark.read.parquet(p).filter("run = 'x'")
    got = dated.of_periods(table, runs.select("day"), "at")
    assert rows(got.select("k")) == rows(df.filter("to_date(at) IN (date'2024-03-04', date'2024-03-09')").select("k"))
    scans = [(s, m) for s, m in scan_metrics(got) if "at_day" in s]
    assert "dynamicpruning" in scans[0][0]
    assert scans[0][1]["numPartitions"] == 2


def test_a_date_column_lays_the_rows_out_itself(spark):
    path = dated.write_dated(_source(spark), shared_dir(spark, "wic"), "wicresultdate")
    table = dated.read_dated(spark, path, _source(spark).schema, "wicresultdate")
    assert set(table.columns) == set(_source(spark).columns)
    slice_ = load.stage_slice(table, D)
    assert rows(slice_.select(_source(spark).columns)) == rows(load.stage_slice(_source(spark), D))
    ((scan, metrics),) = scan_metrics(slice_)
    assert re.search(r"PartitionFilters: \[[^\]]*wicresultdate", scan) and metrics["numPartitions"] == 2
    assert rows(dated.of_periods(table, spark.createDataFrame([(D,)], "d date"), "wicresultdate").select("patientid")) == [(1,), (1,), (2,)]


def test_dated_layout_refuses_what_it_cannot_do(spark):
    with pytest.raises(ValueError):
        dated.write_dated(_source(spark), shared_dir(spark, "x"), "wicresultdate", "week")
    with pytest.raises(ValueError):
        dated.write_dated(_source(spark).withColumn("wicresultdate_month", F.lit(1)), shared_dir(spark, "x"), "wicresultdate", "month")
