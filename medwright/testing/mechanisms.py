"""Checks of how the loads and reports run, keyed by SURVEY §2 IDs (see ``ops`` for the operators).

Bucketed upsert, temp tables, the SQL procedure, parameterised SQL text, rule and exclusion
tables, the gate inside a write, several schemas, facts laid out by date. What an entry
stores lies below ``spark.checkpoint.dir``; catalog objects are dropped before the entry returns.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dates
from ..operators import joins
from ..plans import dispense, load, outreach, parameterised, safety, schema_gate
from ..plans.procedure import LoadProcedure
from ..session import shared_dir
from ..sources import buckets, dated, sinks
from ..sources.namespaces import mounted, tables_from
from ..sources.temptables import TempTable, temp_table
from . import oracle as O
from .ops import _KEPT, _RUN_LOG, op
from .testmap import tables_for

L = O.LOAD
RUN_TS = dt.datetime.fromisoformat(L["run_ts"])
BUCKETS = 16

# ------------------------------------------------------------ bucketed upsert


def bucketed_load(spark, sf, runs: int = 1) -> str:
    """Publish the initial target in buckets, run the day's load on it ``runs`` times; the target's root."""
    src = tables_for(spark, sf).patientwic_source
    root, log_path = shared_dir(spark, "tables", "patientwic_buckets"), shared_dir(spark, "tables", "etl_log")
    first = load.initial_target(src, L["load_date"], L["initial_ts"])
    buckets.publish(spark, root, buckets.write_bucketed(first.repartition(BUCKETS, "patientid"), root, "patientid", BUCKETS))
    for _ in range(runs):
        load.run_load(spark, src, root, log_path, L["load_date"], RUN_TS, buckets=BUCKETS)
    return root


@op("IO7", O.q4())
def io7(spark, sf):
    """The upsert into a bucketed target: bucket by bucket, the target is not shuffled."""
    return buckets.read_bucketed(spark, bucketed_load(spark, sf))


@op("IO8", f"""
    WITH loaded AS ({O.q4()})
    SELECT * FROM loaded
    UNION ALL SELECT * FROM loaded WHERE patientid IS NULL AND lastupdateddatetime = TIMESTAMP '{L["run_ts"]}'""")
def io8(spark, sf):
    """The whole target after a rerun of the day: matched rows keep their creation time under the refreshed update
    time, the others are as they were, and a NULL key, which matches nothing, is inserted by each run."""
    return buckets.read_bucketed(spark, bucketed_load(spark, sf, runs=2))


# ---------------------------------------------------------------- temp tables


@op("IO3", f"""
    WITH enc AS ({O.q1_cohort()}),
    per_patient AS (SELECT pat_id, count(*) AS stays, max(discharge_date) AS last_stay FROM enc GROUP BY pat_id)
    SELECT e.department_id, count(*) AS discharges, count(*) FILTER (WHERE p.stays > 1) AS of_returning_patients, max(p.last_stay) AS last_stay
    FROM enc e JOIN per_patient p ON p.pat_id = e.pat_id GROUP BY e.department_id""")
def io3(spark, sf):
    """The discharge cohort stored once, read twice by name in SQL, dropped; the answer is stored in turn."""
    cohort = safety.discharge_cohort(tables_for(spark, sf).rx_tables(), O.RX["start"], O.RX["end"], O.RX["service_areas"])
    with temp_table(cohort, "enc") as enc:
        return TempTable(spark.sql(f"""
            WITH per_patient AS (SELECT pat_id, count(*) AS stays, max(discharge_date) AS last_stay FROM {enc.view} GROUP BY pat_id)
            SELECT e.department_id, count(*) AS discharges, count_if(p.stays > 1) AS of_returning_patients, max(p.last_stay) AS last_stay
            FROM {enc.view} e JOIN per_patient p ON p.pat_id = e.pat_id GROUP BY e.department_id"""), "discharges").df


# -------------------------------------------------------------- SQL procedure


def called(spark, sf, max_length: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Create target and log, call the load procedure; what target and log hold then."""
    src = tables_for(spark, sf).patientwic_source
    with temp_table(src, "patientwic_source") as source, mounted(spark, {"etl": {}}) as schema:
        db = schema["etl"]
        procedure = LoadProcedure(spark, source.view, f"{db}.patientwic_target", f"{db}.etl_log")
        procedure.create(load.initial_target(src, L["load_date"], L["initial_ts"]))
        before = spark.table(procedure.target).agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
        try:
            procedure.call(L["load_date"], RUN_TS, max_length)
        except Exception:
            after = spark.table(procedure.target).agg(F.sum(F.xxhash64("*").cast("decimal(38,0)"))).first()[0]
            if max_length is None or before != after:
                raise
        return TempTable(spark.table(procedure.target), "target").df, TempTable(spark.table(procedure.log), "log").df


@op("U1", O.q4())
def u1(spark, sf):
    return called(spark, sf)[0]


@op("U1_log", O.with_views(["patientwic_source"], _RUN_LOG.format(deleted=f"count(*) - {_KEPT}", merged=_KEPT, status="Success")))
def u1_log(spark, sf):
    return called(spark, sf)[1]


@op("U4_script", O.with_views(["patientwic_source"], _RUN_LOG.format(deleted="CAST(0 AS BIGINT)", merged="CAST(0 AS BIGINT)", status="Failed")))
def u4_script(spark, sf):
    """Results longer than the procedure allows: its handler logs a Failed row, raises, and the target is as before."""
    return called(spark, sf, max_length=4)[1]


# --------------------------------------------------------- parameterised text


def _detail_text(option=None, flags=None):
    def run(spark, sf):
        return parameterised.turnaround_detail(spark, tables_for(spark, sf).tat_tables(), O.TAT["start"], O.TAT["end"], [], flags, option)
    return run


SOME_FLAGS = ["90024", "90025", "90026", "90027", "90031"]
op("IO15", O.q8a())(_detail_text())
op("IO15_clean", O.q8a("2"))(_detail_text("2"))
op("IO15_lists", O.q8a("3", SOME_FLAGS))(_detail_text("3", SOME_FLAGS))


# -------------------------------------------------- rule and exclusion tables

#: The report's 17 and 30 payers, with payers that the test data has, and a third rule over regions of the others.
RULES = tuple({"pos_ids": g["pos_ids"], "excluded_payors": g["excluded_payors"] + w["excluded_payors"]}
              for g, w in zip(O.OUTREACH["rules"], K.OUTREACH_REGION_RULES)) + ({"pos_ids": (1, 2), "excluded_payors": ("BUILDING", "HOUSEHOLD")},)
_ALLOWED = " OR ".join(f"({{region}} IN ({O.sql_list(g['pos_ids'])}) AND {{payer}} NOT IN ({O.sql_list(g['excluded_payors'])}))" for g in RULES)


@op("P18_table", O.with_views(["order_proc_2", "clarity_dep_4", "lab_enc", "coverage", "clarity_epm"], f"""
    SELECT region_id, payer, count(*) AS orders FROM (
      SELECT d4.region_id, CASE WHEN epm.payor_id % 7 <> 0 THEN epm.payor_name END AS payer
      FROM order_proc_2 op2 JOIN clarity_dep_4 d4 ON d4.department_id = op2.login_dep_id
      JOIN lab_enc pe ON pe.pat_enc_csn_id = op2.order_proc_id
      JOIN coverage cvg ON cvg.coverage_id = pe.coverage_id JOIN clarity_epm epm ON epm.payor_id = cvg.payor_id)
    WHERE {_ALLOWED.format(region='region_id', payer='payer')}
    GROUP BY region_id, payer"""))
def p18_table(spark, sf):
    """Rules as tables; every seventh payer is NULL and never allowed."""
    t = tables_for(spark, sf).outreach_tables()
    rows = (t["order_proc_2"].join(t["clarity_dep_4"], F.col("login_dep_id") == F.col("department_id"))
            .join(t["pat_enc"], F.col("order_proc_id") == F.col("pat_enc_csn_id")).join(t["coverage"], "coverage_id").join(t["clarity_epm"], "payor_id")
            .select("region_id", F.when(F.col("payor_id") % 7 != 0, F.col("payor_name")).alias("payer")))
    allowed = outreach.allowed_payers(rows, outreach.RuleTable.of(spark, RULES), "region_id", "payer")
    return allowed.groupBy("region_id", "payer").agg(F.count(F.lit(1)).alias("orders"))


@op("Q6_rule_table", O.q6(dict(O.OUTREACH, rules=RULES)))
def q6_rule_table(spark, sf):
    t = tables_for(spark, sf).outreach_tables()
    return outreach.future_lab_outreach(t, O.OUTREACH["as_of"], outreach.RuleTable.of(spark, RULES))


@op("P8_table", """
    SELECT o_orderkey FROM orders WHERE CASE WHEN o_custkey % 11 <> 0 THEN o_custkey END NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000)""")
def p8_table(spark, sf):
    """A list that grows with the data; every eleventh order has no value and drops."""
    t = tables_for(spark, sf)
    rows = t.base("orders").select("o_orderkey", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("patient"))
    return joins.not_in_table(rows, "patient", t.base("customer").filter("c_acctbal < 1000"), "c_custkey").select("o_orderkey")


# --------------------------------------------------------- gate inside a write

NARROW = (("WIC Vendor", "dbo", "PatientWIC_Source", "PatientID", "bigint", None, True),
          ("WIC Vendor", "dbo", "PatientWIC_Source", "WICResult", "varchar", 4, True),
          ("WIC Vendor", "dbo", "PatientWIC_Source", "WICResultDate", "date", None, True))


@op("U5_in_plan", O.with_views(["patientwic_source"], """
    SELECT 'wicresult' AS column_name, count(*) FILTER (WHERE length(wicresult) > 4) AS bad_rows, count(*) AS rows_staged, 'Failed' AS status
    FROM stage""", O._load_ctes()))
def u5_in_plan(spark, sf):
    """The staging write counts the values that are too long; the load fails and its pointer stays."""
    src = tables_for(spark, sf).patientwic_source
    root, log_path = shared_dir(spark, "tables", "patientwic_target"), shared_dir(spark, "tables", "etl_log")
    live = sinks.publish_snapshot(load.initial_target(src, L["load_date"], L["initial_ts"]), root)
    try:
        load.run_load(spark, src, root, log_path, L["load_date"], RUN_TS, gate=schema_gate.InPlanGate(NARROW))
    except schema_gate.SchemaMismatch as failed:
        if sinks.current_snapshot(spark, root) != live:
            raise AssertionError("a failed load must not publish a snapshot")
        found = spark.createDataFrame([(d["column_name"], d["bad_rows"]) for d in failed.details], "column_name string, bad_rows long")
        return found.crossJoin(spark.read.parquet(log_path).select("rows_staged", "status"))  # a row a column, one log row
    raise AssertionError("the gate must raise")


# ------------------------------------------------------------ several schemas


@op("IO2", O.q7())
def io2(spark, sf):
    """The dispensing extract over a warehouse schema and an operational one; both are dropped before it is read."""
    tables = tables_for(spark, sf).dispense_tables()
    layout: dict[str, dict[str, str]] = {"warehouse": {}, "operational": {}}
    for name, df in tables.items():
        schema = "operational" if name.startswith("clarity_") else "warehouse"
        layout[schema][name] = shared_dir(spark, "tables", name)
        df.write.parquet(layout[schema][name])
    with mounted(spark, layout) as schemas:
        found = tables_from(spark, tables, list(schemas.values()))
        return dispense.dispense_payer_detail(found, O.DISPENSE["as_of"], O.DISPENSE["npis"], O.DISPENSE["days"])


# ------------------------------------------------------- facts laid out by date


def by_month(spark, df: DataFrame, name: str, date_col: str) -> DataFrame:
    path = dated.write_dated(df, shared_dir(spark, "dated", name), date_col, "month")
    return dated.read_dated(spark, path, df.schema, date_col, "month")


def dated_orders(spark, sf) -> DataFrame:
    return by_month(spark, tables_for(spark, sf).base("orders"), "orders", "o_orderdate")


@op("IO1_dated", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1997-03-10' AND o_orderdate <= DATE '1997-06-05'")
def io1_dated(spark, sf):
    return dated.in_window(dated_orders(spark, sf), "o_orderdate", "1997-03-10", "1997-06-05", "month").select("o_orderkey", "o_custkey")


@op("IO1_periods", """
    SELECT o_orderkey FROM orders
    WHERE date_trunc('month', o_orderdate) IN (SELECT date_trunc('month', o_orderdate) FROM orders WHERE o_orderkey % 997 = 0)""")
def io1_periods(spark, sf):
    """The months come from a table and are known only while the query runs."""
    orders = dated_orders(spark, sf)
    months = tables_for(spark, sf).base("orders").filter("o_orderkey % 997 = 0").select(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"))
    return dated.of_periods(orders, months, "o_orderdate", "month").select("o_orderkey")


@op("IO5_dated", O.with_views(["patientwic_source"], f"""
    SELECT * FROM patientwic_source WHERE wicresultdate >= DATE '{L['load_date']}' AND wicresultdate <= DATE '{L['load_date']}' + 1"""))
def io5_dated(spark, sf):
    src = tables_for(spark, sf).patientwic_source
    start = dt.date.fromisoformat(L["load_date"])
    return dated.in_window(by_month(spark, src, "patientwic", "wicresultdate"), "wicresultdate", start, start + dt.timedelta(days=1), "month").select(*src.columns)


@op("P5_dated", O.with_views(["medicationdispensefact"], f"""
    SELECT rxnumber, fillnumber FROM medicationdispensefact
    WHERE dispensesentinstant >= DATE '{O.DISPENSE['as_of']}' - INTERVAL 30 DAY AND dispensesentinstant < DATE '{O.DISPENSE['as_of']}'"""))
def p5_dated(spark, sf):
    fact = by_month(spark, tables_for(spark, sf).medicationdispensefact, "dispense", "dispensesentinstant")
    until = dates._as_date(O.DISPENSE["as_of"])
    return dated.in_window(fact, "dispensesentinstant", until - dt.timedelta(days=30), until, "month", closed="left").select("rxnumber", "fillnumber")
