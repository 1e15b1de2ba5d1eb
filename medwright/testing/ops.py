"""Operator-level checks keyed by SURVEY §2 IDs.

Each entry runs one library operator over whole mapped tables and pairs it
with an independent DuckDB formulation. The pipelines (Q1-Q8) exercise the
same operators in context; these isolate them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import dates, predicates, text
from ..operators import aggs, joins
from ..operators.windows import latest, latest_any
from ..plans import load, outreach, schema_gate
from . import oracle as O
from .testmap import tables_for

Entry = tuple[Callable[[SparkSession, str], DataFrame], str]
ENTRIES: dict[str, Entry] = {}


def op(key: str, sql: str):
    def deco(fn):
        ENTRIES[key] = (fn, sql)
        return fn
    return deco


AS_OF = O.MEASURE["as_of"]

# ----------------------------------------------------------------- scalars


@op("S1", O.with_views(["pat_enc", "patient"], """
    SELECT pe.pat_enc_csn_id, CAST(year(pe.contact_date) - year(p.birth_date) AS INTEGER) AS age_years
    FROM pat_enc pe JOIN patient p ON p.pat_id = pe.pat_id"""))
def s1(spark, sf):
    t = tables_for(spark, sf)
    return t.pat_enc.join(t.patient, "pat_id").select(
        "pat_enc_csn_id", dates.year_boundaries("birth_date", "contact_date").alias("age_years"))


@op("S2", O.with_views(["patient"], f"SELECT pat_id, {O._age('birth_date', AS_OF)} AS age FROM patient"))
def s2(spark, sf):
    return tables_for(spark, sf).patient.select("pat_id", dates.exact_age("birth_date", dates.lit_date(AS_OF)).alias("age"))


@op("S3", O.with_views(["patient"], "SELECT pat_id, CAST(birth_date + INTERVAL 18 YEAR AS DATE) AS adult_on FROM patient"))
def s3(spark, sf):
    return tables_for(spark, sf).patient.select("pat_id", dates.add_years("birth_date", 18).alias("adult_on"))


@op("S5", O.with_views(["pat_enc_hsp"], """
    SELECT pat_enc_csn_id,
           CAST(date_diff('day', CAST(hosp_disch_time AS DATE), CAST(hosp_admsn_time AS DATE)) AS INTEGER) AS stay_as_written,
           CAST(date_diff('day', CAST(hosp_admsn_time AS DATE), CAST(hosp_disch_time AS DATE)) AS INTEGER) AS stay_days
    FROM pat_enc_hsp"""))
def s5(spark, sf):
    h = tables_for(spark, sf).pat_enc_hsp
    return h.select("pat_enc_csn_id", dates.day_boundaries("hosp_disch_time", "hosp_admsn_time").alias("stay_as_written"),
                    dates.day_boundaries("hosp_admsn_time", "hosp_disch_time").alias("stay_days"))


def _order_span(spark, sf):
    e = tables_for(spark, sf)._events_keyed
    return e.groupBy("order_key").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


_SPAN = "SELECT order_key, min(ts) AS a, max(ts) AS b FROM events_keyed GROUP BY order_key"


@op("S6", O.with_views(["events_keyed"], "SELECT order_key, date_diff('minute', a, b) AS minutes FROM span",
                       {"span": _SPAN}))
def s6(spark, sf):
    return _order_span(spark, sf).select("order_key", dates.minute_boundaries("first_ts", "last_ts").alias("minutes"))


@op("S7", O.with_views(["events_keyed"], "SELECT order_key, date_diff('second', a, b) AS seconds FROM span",
                       {"span": _SPAN}))
def s7(spark, sf):
    return _order_span(spark, sf).select("order_key", dates.second_boundaries("first_ts", "last_ts").alias("seconds"))


@op("S8", O.with_views(["events_keyed"], f"SELECT order_key, {O._dur('a', 'b')} AS span_text FROM span",
                       {"span": _SPAN}))
def s8(spark, sf):
    return _order_span(spark, sf).select("order_key", dates.duration_text("first_ts", "last_ts").alias("span_text"))


@op("S10", "SELECT event_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day_start FROM events")
def s10(spark, sf):
    return tables_for(spark, sf).base("events").select("event_id", dates.day_start("ts").alias("day_start"))


@op("S11", O.with_views(["pat_enc_hsp"], "SELECT pat_enc_csn_id, CAST(hosp_disch_time AS DATE) AS discharge_date FROM pat_enc_hsp"))
def s11(spark, sf):
    return tables_for(spark, sf).pat_enc_hsp.select("pat_enc_csn_id", F.to_date("hosp_disch_time").alias("discharge_date"))


@op("S12", O.with_views(["patient"], "SELECT pat_id, strftime(birth_date, '%m/%d/%Y') AS dob FROM patient"))
def s12(spark, sf):
    return tables_for(spark, sf).patient.select("pat_id", dates.fmt_mdy("birth_date").alias("dob"))


@op("S13", "SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M') AS order_instant FROM events")
def s13(spark, sf):
    return tables_for(spark, sf).base("events").select("event_id", dates.fmt_mdy_hm("ts").alias("order_instant"))


@op("S14", "SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y%m%d') AS dispensed_date FROM lineitem")
def s14(spark, sf):
    return tables_for(spark, sf).base("lineitem").select("l_orderkey", "l_linenumber",
                                                         dates.fmt_ymd("l_shipdate").alias("dispensed_date"))


@op("S16", O.with_views(["ip_flwsht_meas"], """
    SELECT fsd_id, recorded_time,
           CASE WHEN strpos(meas_value, '/') > 0 THEN TRY_CAST(split_part(meas_value, '/', 1) AS INTEGER) END AS systolic,
           CASE WHEN strpos(meas_value, '/') > 0 THEN TRY_CAST(split_part(meas_value, '/', 2) AS INTEGER) END AS diastolic
    FROM ip_flwsht_meas"""))
def s16(spark, sf):
    m = tables_for(spark, sf).ip_flwsht_meas
    s, d = text.split_pair("meas_value")
    return m.select("fsd_id", "recorded_time", s.alias("systolic"), d.alias("diastolic"))


@op("S17", O.with_views(["pat_enc"], "SELECT pat_enc_csn_id, concat(pat_enc_csn_id, '-', appt_cancel_date) AS enc_key FROM pat_enc"))
def s17(spark, sf):
    pe = tables_for(spark, sf).pat_enc
    return pe.select("pat_enc_csn_id", text.concat_ws_null_empty("pat_enc_csn_id", F.lit("-"), "appt_cancel_date").alias("enc_key"))


@op("S23", f"""
    SELECT c_mktsegment, {O._pct('n', 'd')} AS positive_balance_pct
    FROM (SELECT c_mktsegment, count(*) FILTER (WHERE c_acctbal >= 0) AS n, count(*) AS d FROM customer GROUP BY c_mktsegment)""")
def s23(spark, sf):
    c = tables_for(spark, sf).base("customer")
    g = c.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") >= 0).alias("n"), F.count(F.lit(1)).alias("d"))
    return g.select("c_mktsegment", text.percent_text("n", "d").alias("positive_balance_pct"))


# -------------------------------------------------------------- predicates


@op("P10", O.with_views(["order_med"], """
    SELECT order_med_id FROM order_med WHERE discon_time IS NULL OR discon_time <= TIMESTAMP '1900-01-01 00:00:00'"""))
def p10(spark, sf):
    return tables_for(spark, sf).order_med.filter(dates.null_or_sentinel("discon_time")).select("order_med_id")


@op("P11", O.with_views(["edg_current_icd10"], f"""
    SELECT dx_id, code FROM edg_current_icd10 WHERE line = 1 AND {O.like_any('code', K.CANCER_ICD10_PREFIXES)}"""))
def p11(spark, sf):
    icd = tables_for(spark, sf).edg_current_icd10
    return icd.filter((F.col("line") == 1) & text.starts_with_any("code", K.CANCER_ICD10_PREFIXES)).select("dx_id", "code")


@op("P12", O.with_views(["problem_list", "measure_edg"], """
    SELECT pl.pat_id FROM problem_list pl JOIN measure_edg e ON e.dx_id = pl.dx_id WHERE e.current_icd10_list LIKE '%I10%'"""))
def p12(spark, sf):
    t = tables_for(spark, sf)
    return t.problem_list.join(t.measure_edg.filter(text.contains("current_icd10_list", "I10")), "dx_id").select("pat_id")


_PHARMACIES = [1, 2, 3]


@op("P15", O.with_views(["order_disp_info", "rx_phr"], f"""
    SELECT odi.order_med_id, rp.pharmacy_name FROM order_disp_info odi JOIN rx_phr rp ON rp.pharmacy_id = odi.fill_phr_id
    WHERE rp.pharmacy_id IN ({O.sql_list(_PHARMACIES)})"""))
def p15(spark, sf):
    t = tables_for(spark, sf)
    phr = t.rx_phr.filter(predicates.optional_in("pharmacy_id", _PHARMACIES))
    return t.order_disp_info.join(phr, F.col("fill_phr_id") == F.col("pharmacy_id")).select("order_med_id", "pharmacy_name")


@op("P15_empty", O.with_views(["order_disp_info", "rx_phr"], """
    SELECT odi.order_med_id, rp.pharmacy_name FROM order_disp_info odi JOIN rx_phr rp ON rp.pharmacy_id = odi.fill_phr_id"""))
def p15_empty(spark, sf):
    t = tables_for(spark, sf)
    phr = t.rx_phr.filter(predicates.optional_in("pharmacy_id", None))
    return t.order_disp_info.join(phr, F.col("fill_phr_id") == F.col("pharmacy_id")).select("order_med_id", "pharmacy_name")


_RULES = O.OUTREACH["rules"]


@op("P18", O.with_views(["order_proc_2", "clarity_dep_4", "lab_enc", "coverage", "clarity_epm"], f"""
    SELECT d4.region_id AS pos_id, count(*) AS orders
    FROM order_proc_2 op2 JOIN clarity_dep_4 d4 ON d4.department_id = op2.login_dep_id
    JOIN lab_enc pe ON pe.pat_enc_csn_id = op2.order_proc_id
    JOIN coverage cvg ON cvg.coverage_id = pe.coverage_id JOIN clarity_epm epm ON epm.payor_id = cvg.payor_id
    WHERE {' OR '.join(f"(d4.region_id IN ({O.sql_list(g['pos_ids'])}) AND epm.payor_name NOT IN ({O.sql_list(g['excluded_payors'])}))" for g in _RULES)}
    GROUP BY d4.region_id"""))
def p18(spark, sf):
    t = tables_for(spark, sf).outreach_tables()
    rows = (t["order_proc_2"].join(t["clarity_dep_4"], F.col("login_dep_id") == F.col("department_id"))
            .join(t["pat_enc"], F.col("order_proc_id") == F.col("pat_enc_csn_id"))
            .join(t["coverage"], "coverage_id").join(t["clarity_epm"], "payor_id")
            .filter(outreach.region_payer_rule(_RULES, F.col("region_id"), F.col("payor_name"))))
    return rows.groupBy(F.col("region_id").alias("pos_id")).agg(F.count(F.lit(1)).alias("orders"))


# ------------------------------------------------------------------ windows

_A1C_ROWS = """
    SELECT pe.pat_id, r.result_date, r.line, r.ord_num_value
    FROM pat_enc pe JOIN lab_order_proc op ON op.pat_enc_csn_id = pe.pat_enc_csn_id
    JOIN order_results r ON r.order_proc_id = op.order_proc_id"""


@op("W1", O.with_views(["pat_enc", "lab_order_proc", "order_results"], """
    SELECT pat_id, result_date, line, ord_num_value FROM (
      SELECT *, row_number() OVER (PARTITION BY pat_id ORDER BY result_date DESC, line DESC, ord_num_value DESC) AS rn
      FROM a1c) WHERE rn = 1""", {"a1c": _A1C_ROWS}))
def w1(spark, sf):
    t = tables_for(spark, sf)
    rows = (t.pat_enc.select("pat_id", "pat_enc_csn_id").join(t.lab_order_proc.select("order_proc_id", "pat_enc_csn_id"),
                                                              "pat_enc_csn_id")
            .join(t.order_results, "order_proc_id").select("pat_id", "result_date", "line", "ord_num_value"))
    return latest(rows, "pat_id", ["result_date", "line", "ord_num_value"])


@op("W2", O.with_views(["patientwic_source"], """
    SELECT patientid, wicresult, wicresultdate FROM (
      SELECT *, row_number() OVER (PARTITION BY patientid ORDER BY wicresultdate DESC, wicresult DESC) AS rn
      FROM patientwic_source) WHERE rn = 1"""))
def w2(spark, sf):
    return load.dedup(tables_for(spark, sf).patientwic_source, "patientid", ["wicresultdate", "wicresult"])


@op("W3", O.with_views(["pat_enc", "ip_flwsht_rec", "ip_flwsht_meas"], """
    SELECT pat_id, any_value(recorded_time) AS recorded_time, bool_or(coalesce(meas_value < '12', FALSE)) AS passes FROM (
      SELECT pe.pat_id, m.recorded_time, m.meas_value,
             dense_rank() OVER (PARTITION BY pe.pat_id ORDER BY m.recorded_time DESC) AS rk
      FROM pat_enc pe JOIN ip_flwsht_rec r ON r.inpatient_data_id = pe.inpatient_data_id
      JOIN ip_flwsht_meas m ON m.fsd_id = r.fsd_id) WHERE rk = 1 GROUP BY pat_id"""))
def w3(spark, sf):
    """Ties at the latest instant are kept, through the aggregate that Q3 uses."""
    t = tables_for(spark, sf)
    rows = (t.pat_enc.select("pat_id", "inpatient_data_id").join(t.ip_flwsht_rec, "inpatient_data_id")
            .join(t.ip_flwsht_meas, "fsd_id").select("pat_id", "recorded_time", "meas_value"))
    return latest_any(rows, "pat_id", "recorded_time", F.col("meas_value") < "12")


# --------------------------------------------------------------- aggregates


@op("A5", O.with_views(["ord_act_ot"], """
    SELECT action_id, max(CASE WHEN action_type_c = 30 THEN action_dttm_local END) AS entered_dttm,
           max(CASE WHEN action_type_c = 45 THEN action_dttm_local END) AS filled_dttm,
           max(CASE WHEN action_type_c = 60 THEN action_dttm_local END) AS verified_dttm
    FROM ord_act_ot GROUP BY action_id"""))
def a5(spark, sf):
    o = tables_for(spark, sf).ord_act_ot
    t, ts = "action_type_c", "action_dttm_local"
    return o.groupBy("action_id").agg(aggs.pivot_max(t, ts, 30).alias("entered_dttm"),
                                      aggs.pivot_max(t, ts, 45).alias("filled_dttm"),
                                      aggs.pivot_max(t, ts, 60).alias("verified_dttm"))


@op("A8", "SELECT c.c_nationkey, count(DISTINCT o.o_custkey) AS patients FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey")
def a8(spark, sf):
    t = tables_for(spark, sf)
    o, c = t.base("orders"), t.base("customer")
    return (o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey")
            .agg(F.count_distinct("o_custkey").alias("patients")))


@op("A9", O.with_views(["events_keyed"], """
    SELECT user_id % 25 AS pharmacy_id,
           CAST(sum(date_diff('minute', a, b)) // count(date_diff('minute', a, b)) AS BIGINT) AS avg_minutes
    FROM (SELECT user_id, order_key, min(ts) AS a, max(ts) AS b FROM events_keyed GROUP BY user_id, order_key)
    GROUP BY user_id % 25"""))
def a9(spark, sf):
    e = tables_for(spark, sf)._events_keyed
    spans = e.groupBy("user_id", "order_key").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return spans.groupBy((F.col("user_id") % 25).alias("pharmacy_id")).agg(
        aggs.int_avg(dates.minute_boundaries("a", "b")).alias("avg_minutes"))


@op("A10", """
    SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, '; ' ORDER BY l_returnflag || l_linestatus) AS statuses
    FROM lineitem GROUP BY l_orderkey""")
def a10(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.groupBy("l_orderkey").agg(aggs.string_agg(F.concat("l_returnflag", "l_linestatus"), "; ").alias("statuses"))


@op("A11", """
    SELECT l_orderkey,
           string_agg(CAST(l_partkey AS VARCHAR), '; ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS parts,
           string_agg(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), '; ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS quantities
    FROM lineitem GROUP BY l_orderkey""")
def a11(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    lists = aggs.aligned_lists("l_linenumber", {"parts": "l_partkey", "quantities": F.col("l_quantity").cast("int")}, "; ")
    return li.groupBy("l_orderkey").agg(*[c.alias(n) for n, c in lists.items()])


@op("A14", """
    SELECT l_orderkey, CASE WHEN count(l_partkey) > 1 THEN 0 ELSE 1 END AS single_line_flag FROM lineitem GROUP BY l_orderkey""")
def a14(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.groupBy("l_orderkey").agg(aggs.count_flag("l_partkey").alias("single_line_flag"))


# -------------------------------------------------------------------- joins


@op("J7", """
    SELECT sn.n_name AS supplier_nation, cn.n_name AS patient_nation, count(*) AS fills
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
    JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation sn ON sn.n_nationkey = s.s_nationkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey
    GROUP BY sn.n_name, cn.n_name""")
def j7(spark, sf):
    t = tables_for(spark, sf)
    li, o, s, c, n = (t.base(x) for x in ("lineitem", "orders", "supplier", "customer", "nation"))
    sn, cn = joins.role(n, "s_"), joins.role(n, "c_")
    rows = (li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
            .join(c, o.o_custkey == c.c_custkey)
            .join(sn, s.s_nationkey == sn.s_n_nationkey).join(cn, c.c_nationkey == cn.c_n_nationkey))
    return rows.groupBy(F.col("s_n_name").alias("supplier_nation"), F.col("c_n_name").alias("patient_nation")).agg(
        F.count(F.lit(1)).alias("fills"))


@op("J10", """SELECT c_custkey FROM customer c WHERE NOT EXISTS (
    SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')""")
def j10(spark, sf):
    t = tables_for(spark, sf)
    c, o = t.base("customer"), t.base("orders").filter(F.col("o_orderstatus") == "P")
    return joins.not_exists(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@op("J12", "SELECT p_partkey FROM part p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def j12(spark, sf):
    t = tables_for(spark, sf)
    li = t.base("lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_partkey").alias("p_partkey"))
    return joins.exists(t.base("part").select("p_partkey"), li, "p_partkey")


# ---------------------------------------------------------------- ETL pieces


@op("IO5", O.with_views(["patientwic_source"], f"""
    SELECT * FROM patientwic_source
    WHERE wicresultdate >= DATE '{O.LOAD['load_date']}' AND wicresultdate <= DATE '{O.LOAD['load_date']}' + 1"""))
def io5(spark, sf):
    return load.stage_slice(tables_for(spark, sf).patientwic_source, O.LOAD["load_date"])


@op("IO13", O.with_views(["patientwic_source"], "SELECT * FROM actual", {"actual": O.GATE_ACTUAL}))
def io13(spark, sf):
    return schema_gate.actual_columns(tables_for(spark, sf).patientwic_source, "dbo", "PatientWIC_Source")


# --------------------------------------------------------------- more filters


@op("S4", "SELECT event_id, ts + INTERVAL 7 DAY AS expected_completion FROM events")
def s4(spark, sf):
    return tables_for(spark, sf).base("events").select("event_id", dates.add_days("ts", 7).alias("expected_completion"))


@op("P4", O.with_views(["patient"], f"SELECT pat_id FROM patient WHERE {O._age('birth_date', AS_OF)} BETWEEN 18 AND 75"))
def p4(spark, sf):
    p = tables_for(spark, sf).patient
    return p.filter(dates.exact_age("birth_date", dates.lit_date(AS_OF)).between(18, 75)).select("pat_id")


@op("P5", O.with_views(["medicationdispensefact"], f"""
    SELECT rxnumber, fillnumber FROM medicationdispensefact
    WHERE dispensesentinstant >= DATE '{O.DISPENSE['as_of']}' - INTERVAL 30 DAY AND dispensesentinstant < DATE '{O.DISPENSE['as_of']}'"""))
def p5(spark, sf):
    f = tables_for(spark, sf).medicationdispensefact
    return f.filter(dates.trailing_days_window("dispensesentinstant", O.DISPENSE["as_of"], 30)).select("rxnumber", "fillnumber")


@op("P6", O.with_views(["pat_enc_hsp"], f"""
    SELECT pat_enc_csn_id FROM pat_enc_hsp
    WHERE CAST(hosp_disch_time AS DATE) >= DATE '{O.RX['start']}' AND CAST(hosp_disch_time AS DATE) < DATE '{O.RX['end']}' + 1"""))
def p6(spark, sf):
    h = tables_for(spark, sf).pat_enc_hsp
    return h.filter(dates.inclusive_date_window("hosp_disch_time", O.RX["start"], O.RX["end"])).select("pat_enc_csn_id")


@op("P8", O.with_views(["lab_order"], f"""
    SELECT order_proc_id FROM lab_order WHERE proc_id NOT IN ({O.sql_list(predicates.as_numbers(K.OUTREACH_EXCLUDED_PROC_IDS))})"""))
def p8(spark, sf):
    o = tables_for(spark, sf).outreach_tables()["order_proc"]
    return o.filter(predicates.not_in("proc_id", predicates.as_numbers(K.OUTREACH_EXCLUDED_PROC_IDS))).select("order_proc_id")


@op("P13", O.with_views(["clarity_epm"], "SELECT payor_id FROM clarity_epm WHERE financial_class NOT LIKE 'Hospice'"))
def p13(spark, sf):
    e = tables_for(spark, sf).clarity_epm
    return e.filter(predicates.not_equal("financial_class", K.HOSPICE_FINANCIAL_CLASS)).select("payor_id")


# ------------------------------------------------------------- more joins/aggs


@op("J4", O.with_views(["pat_enc_dx", "rx_edg", "edg_current_icd10"], """
    SELECT dx.pat_enc_csn_id, dx.dx_id, icd.code
    FROM pat_enc_dx dx LEFT JOIN (SELECT dx_id, code FROM edg_current_icd10 SEMI JOIN rx_edg USING (dx_id) WHERE line = 1) icd USING (dx_id)"""))
def j4(spark, sf):
    """The codes per encounter that the medication report lists: no EDG row, no code."""
    from ..plans.safety import encounter_codes
    return encounter_codes(tables_for(spark, sf).rx_tables())


@op("J13", """
    SELECT n.patients, d.encounters FROM (SELECT count(DISTINCT o_custkey) AS patients FROM orders) n
    CROSS JOIN (SELECT count(*) AS encounters FROM orders) d""")
def j13(spark, sf):
    o = tables_for(spark, sf).base("orders")
    return o.agg(F.count_distinct("o_custkey").alias("patients")).crossJoin(o.agg(F.count(F.lit(1)).alias("encounters")))


@op("A1", """
    SELECT l_orderkey, max(l_shipdate) AS last_ship, max(l_returnflag) AS max_flag, max(l_extendedprice * (1 - l_discount)) AS max_net
    FROM lineitem GROUP BY l_orderkey""")
def a1(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.groupBy("l_orderkey").agg(*aggs.max_all({
        "last_ship": "l_shipdate", "max_flag": "l_returnflag",
        "max_net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}))


@op("A13", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def a13(spark, sf):
    return tables_for(spark, sf).base("customer").select("c_nationkey", "c_mktsegment").distinct()


@op("A17", f"""
    SELECT n_regionkey, {O._pct('n', 'd')} AS finished_pct FROM (
      SELECT n.n_regionkey, count(*) FILTER (WHERE o.o_orderstatus = 'F') AS n, count(*) AS d
      FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
      GROUP BY n.n_regionkey)""")
def a17(spark, sf):
    t = tables_for(spark, sf)
    o, c, n = t.base("orders"), t.base("customer"), t.base("nation")
    g = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey")
         .agg(F.count_if(F.col("o_orderstatus") == "F").alias("n"), F.count(F.lit(1)).alias("d")))
    return g.select("n_regionkey", text.percent_text("n", "d").alias("finished_pct"))


_W45 = """
    SELECT pat_id, result_date, line, ord_num_value FROM (
      SELECT *, row_number() OVER (PARTITION BY pat_id ORDER BY result_date DESC, line DESC, ord_num_value DESC) AS rn
      FROM a1c {pre}) WHERE rn = 1 {post}"""


def _a1c_rows(spark, sf):
    t = tables_for(spark, sf)
    return (t.pat_enc.select("pat_id", "pat_enc_csn_id")
            .join(t.lab_order_proc.select("order_proc_id", "pat_enc_csn_id"), "pat_enc_csn_id")
            .join(t.order_results, "order_proc_id").select("pat_id", "result_date", "line", "ord_num_value"))


@op("W4", O.with_views(["pat_enc", "lab_order_proc", "order_results"],
                       _W45.format(pre="WHERE ord_num_value < 7.5", post=""), {"a1c": _A1C_ROWS}))
def w4(spark, sf):
    rows = _a1c_rows(spark, sf)
    return latest(rows.filter(F.col("ord_num_value") < K.A1C_THRESHOLD), "pat_id", ["result_date", "line", "ord_num_value"])


@op("W5", O.with_views(["pat_enc", "lab_order_proc", "order_results"],
                       _W45.format(pre="", post="AND ord_num_value < 7.5"), {"a1c": _A1C_ROWS}))
def w5(spark, sf):
    rows = _a1c_rows(spark, sf)
    return latest(rows, "pat_id", ["result_date", "line", "ord_num_value"]).filter(F.col("ord_num_value") < K.A1C_THRESHOLD)


ENTRIES["T1"] = ENTRIES["W1"]


@op("IO14", O.q6())
def io14(spark, sf):
    """Write the outreach extract as a headed CSV on shared storage, read it back."""
    from ..plans import outreach as outreach_plan
    from ..session import shared_dir
    from ..sources.sinks import write_extract
    from .registry import OUT
    df = outreach_plan.future_lab_outreach(tables_for(spark, sf).outreach_tables(), OUT["as_of"], OUT["rules"])
    path = write_extract(df, shared_dir(spark, "extracts", "future_labs"))
    return spark.read.option("header", True).schema(df.schema).csv(path)


# ------------------------------------------------------- third batch: filters


@op("P3", O.with_views(["pat_enc"], """
    SELECT pat_enc_csn_id FROM pat_enc
    WHERE enc_type_c = 101 AND contact_date >= DATE '1998-01-01' AND contact_date <= DATE '2000-12-31'"""))
def p3(spark, sf):
    pe = tables_for(spark, sf).pat_enc
    return pe.filter((F.col("enc_type_c") == K.OFFICE_VISIT_ENC_TYPE) & (F.col("contact_date") >= dates.lit_date("1998-01-01"))
                     & (F.col("contact_date") <= dates.lit_date("2000-12-31"))).select("pat_enc_csn_id")


@op("P7", O.with_views(["medicationdispensefact"], """
    SELECT rxnumber, fillnumber, fillstatus FROM medicationdispensefact WHERE fillstatus IN ('Shipped', 'Dispensed')"""))
def p7(spark, sf):
    f = tables_for(spark, sf).medicationdispensefact
    return f.filter(F.col("fillstatus").isin(*K.DISPENSE_FILL_STATUSES)).select("rxnumber", "fillnumber", "fillstatus")


@op("P9", O.with_views(["pat_enc"], "SELECT pat_enc_csn_id FROM pat_enc WHERE appt_cancel_date IS NULL"))
def p9(spark, sf):
    return tables_for(spark, sf).pat_enc.filter(F.col("appt_cancel_date").isNull()).select("pat_enc_csn_id")


@op("P14", O.with_views(["order_disp_info"], "SELECT order_med_id FROM order_disp_info WHERE NOT fill_status_c = '100'"))
def p14(spark, sf):
    odi = tables_for(spark, sf).order_disp_info
    return odi.filter(predicates.not_equal("fill_status_c", K.EXCLUDED_FILL_STATUS)).select("order_med_id")


@op("P16", O.with_views(["pat_enc_hsp", "clarity_dep"], """
    SELECT h.pat_enc_csn_id FROM pat_enc_hsp h JOIN clarity_dep d ON d.department_id = h.department_id
    WHERE d.serv_area_id IN (9503)"""))
def p16(spark, sf):
    t = tables_for(spark, sf)
    dep = t.clarity_dep.filter(predicates.required_in("serv_area_id", O.RX["service_areas"])).select("department_id")
    return t.pat_enc_hsp.join(dep, "department_id").select("pat_enc_csn_id")


@op("P19", O.with_views(["medicationdispensefact"], """
    SELECT fillstatus, count(*) AS fills FROM medicationdispensefact WHERE _isdeleted = 0 GROUP BY fillstatus"""))
def p19(spark, sf):
    f = tables_for(spark, sf).medicationdispensefact
    return f.filter(predicates.active("_isdeleted", 0)).groupBy("fillstatus").agg(F.count(F.lit(1)).alias("fills"))


@op("P20", O.with_views(["problem_list"], "SELECT pat_id, dx_id FROM problem_list WHERE problem_status_c = 1"))
def p20(spark, sf):
    pl = tables_for(spark, sf).problem_list
    return pl.filter(predicates.active("problem_status_c", K.PROBLEM_ACTIVE)).select("pat_id", "dx_id")


@op("P22", O.with_views(["pat_enc", "patient"], """
    SELECT pe.pat_enc_csn_id FROM pat_enc pe JOIN patient p ON p.pat_id = pe.pat_id
    WHERE year(pe.contact_date) - year(p.birth_date) >= 18"""))
def p22(spark, sf):
    t = tables_for(spark, sf)
    return (t.pat_enc.join(t.patient, "pat_id")
            .filter(dates.year_boundaries("birth_date", "contact_date") >= K.ADULT_AGE).select("pat_enc_csn_id"))


@op("P23", O.with_views(["pat_enc_hsp"], """
    SELECT pat_enc_csn_id FROM pat_enc_hsp
    WHERE date_diff('day', CAST(hosp_admsn_time AS DATE), CAST(hosp_disch_time AS DATE)) <= 3"""))
def p23(spark, sf):
    h = tables_for(spark, sf).pat_enc_hsp
    return h.filter(dates.day_boundaries("hosp_admsn_time", "hosp_disch_time") <= 3).select("pat_enc_csn_id")


# --------------------------------------------------------- third batch: joins


@op("J1", """
    SELECT l.l_orderkey, l.l_linenumber, n.n_name FROM lineitem l
    JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey""")
def j1(spark, sf):
    t = tables_for(spark, sf)
    li, o, c, n = (t.base(x) for x in ("lineitem", "orders", "customer", "nation"))
    return (li.select("l_orderkey", "l_linenumber").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
            .join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
            .join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("l_orderkey", "l_linenumber", "n_name"))


@op("J2", O.with_views(["patient", "identity_id"], """
    SELECT p.pat_id, i.identity_id FROM patient p
    LEFT JOIN identity_id i ON i.pat_id = p.pat_id AND i.identity_type_id = 9502"""))
def j2(spark, sf):
    t = tables_for(spark, sf)
    ident = t.outreach_tables()["identity_id"]
    return joins.left_filtered(t.patient.select("pat_id"), ident, "pat_id",
                               F.col("identity_type_id") == K.OUTREACH_IDENTITY_TYPE).select("pat_id", "identity_id")


@op("J3", O.with_views(["pat_enc", "pat_enc_hsp"], f"""
    SELECT pe.pat_enc_csn_id, pe.pat_id FROM pat_enc pe JOIN pat_enc_hsp h ON h.pat_enc_csn_id = pe.pat_enc_csn_id
      AND CAST(h.hosp_disch_time AS DATE) >= DATE '{O.RX['start']}' AND CAST(h.hosp_disch_time AS DATE) < DATE '{O.RX['end']}' + 1"""))
def j3(spark, sf):
    t = tables_for(spark, sf)
    h = t.pat_enc_hsp.filter(dates.inclusive_date_window("hosp_disch_time", O.RX["start"], O.RX["end"])).select("pat_enc_csn_id")
    return t.pat_enc.join(h, "pat_enc_csn_id").select("pat_enc_csn_id", "pat_id")


@op("J6", O.with_views(["order_disp_info", "ord_act_ord_info"], """
    SELECT odi.order_med_id, oaoi.action_id FROM order_disp_info odi
    JOIN ord_act_ord_info oaoi ON oaoi.order_id = odi.order_med_id AND oaoi.order_date = odi.contact_date_real"""))
def j6(spark, sf):
    t = tables_for(spark, sf)
    link = t.ord_act_ord_info.select("action_id", F.col("order_id").alias("order_med_id"),
                                     F.col("order_date").alias("contact_date_real"))
    return t.order_disp_info.join(link, ["order_med_id", "contact_date_real"]).select("order_med_id", "action_id")


@op("J9", O.with_views(["order_disp_info", "ord_act_ot"], """
    SELECT odi.order_med_id, v.verified_dttm FROM order_disp_info odi
    JOIN (SELECT action_id, max(CASE WHEN action_type_c = 60 THEN action_dttm_local END) AS verified_dttm
          FROM ord_act_ot GROUP BY action_id) v ON v.action_id = odi.order_med_id"""))
def j9(spark, sf):
    t = tables_for(spark, sf)
    derived = t.ord_act_ot.groupBy("action_id").agg(
        aggs.pivot_max("action_type_c", "action_dttm_local", K.ACTION_VERIFIED).alias("verified_dttm"))
    return t.order_disp_info.join(derived, F.col("order_med_id") == F.col("action_id")).select("order_med_id", "verified_dttm")


@op("J11", O.with_views(["pat_enc", "pat_enc_dx", "rx_edg", "edg_current_icd10"], f"""
    SELECT pe.pat_enc_csn_id FROM pat_enc pe WHERE NOT EXISTS (
      SELECT 1 FROM pat_enc_dx dx JOIN rx_edg e ON e.dx_id = dx.dx_id
      JOIN edg_current_icd10 icd ON icd.dx_id = e.dx_id AND icd.line = 1 AND {O.like_any('icd.code', K.CANCER_ICD10_PREFIXES)}
      WHERE dx.pat_enc_csn_id = pe.pat_enc_csn_id)"""))
def j11(spark, sf):
    from ..plans import safety
    t = tables_for(spark, sf)
    return joins.not_exists(t.pat_enc.select("pat_enc_csn_id"), safety.cancer_encounters(t.rx_tables()), "pat_enc_csn_id")


@op("J14", O.with_views(["lab_order", "order_proc_2", "clarity_dep_4", "code_assc_map"], """
    SELECT op.order_proc_id, cam.code_assc_value AS split_reg FROM lab_order op
    JOIN order_proc_2 op2 ON op2.order_proc_id = op.order_proc_id
    JOIN clarity_dep_4 d4 ON d4.department_id = op2.login_dep_id
    JOIN code_assc_map cam ON cam.code_name = 'pos.pos_id' AND cam.code_value = CAST(d4.region_id AS VARCHAR)
         AND cam.active_flag = 'Y' AND cam.usage = 'salesforce_lab_orders' AND cam.code_assc_name = 'region_abbr'"""))
def j14(spark, sf):
    t = tables_for(spark, sf).outreach_tables()
    cm = K.OUTREACH_CODE_MAP
    cam = t["code_assc_map"].filter(
        (F.col("code_name") == cm["code_name"]) & (F.col("active_flag") == cm["active_flag"])
        & (F.col("usage") == cm["usage"]) & (F.col("code_assc_name") == cm["code_assc_name"]))
    rows = (t["order_proc"].select("order_proc_id").join(t["order_proc_2"], "order_proc_id")
            .join(t["clarity_dep_4"], F.col("login_dep_id") == F.col("department_id"))
            .join(cam, F.col("code_value") == F.col("region_id").cast("string")))
    return rows.select("order_proc_id", F.col("code_assc_value").alias("split_reg"))


def _tat_detail(spark, sf):
    from ..plans import turnaround
    T = O.TAT
    return turnaround.tat_detail(tables_for(spark, sf).tat_tables(), T["start"], T["end"])


@op("J15", O.with_views(O.TAT_VIEWS, """
    SELECT d.order_med_id, t.turnaround_time FROM details d LEFT JOIN turnarnd_cte t ON d.order_med_id = t.order_med_id""",
    {"details": O._tat_details(), "turnarnd_cte": O.TURNARND_CTE}))
def j15(spark, sf):
    from ..plans import turnaround
    d = _tat_detail(spark, sf)
    steps = turnaround.tat_step_durations(d).select("order_med_id", "turnaround_time")
    return d.select("order_med_id").join(steps, "order_med_id", "left")


@op("J16", O.with_views(O.TAT_VIEWS, """
    SELECT d.order_med_id, a.average_turn_around_time_min FROM details d LEFT JOIN avg_cte a ON d.pharmacy_id = a.pharmacy_id""",
    {"details": O._tat_details(), "avg_cte": O.AVG_CTE}))
def j16(spark, sf):
    from ..plans import turnaround
    d = _tat_detail(spark, sf)
    avgs = turnaround.tat_pharmacy_averages(d).select("pharmacy_id", "average_turn_around_time_min")
    return d.select("order_med_id", "pharmacy_id").join(avgs, "pharmacy_id", "left").drop("pharmacy_id")


@op("J17", O.with_views(["patient", "other_communctn"], """
    SELECT p.pat_id, max(coalesce(c.other_communic_num, p.home_phone)) AS phone_number
    FROM patient p LEFT JOIN other_communctn c ON c.pat_id = p.pat_id AND c.other_communic_c IN (1, 6)
    GROUP BY p.pat_id"""))
def j17(spark, sf):
    t = tables_for(spark, sf)
    comm = t.outreach_tables()["other_communctn"]
    rows = joins.left_filtered(t.patient.select("pat_id", "home_phone"), comm, "pat_id",
                               F.col("other_communic_c").isin(*K.OUTREACH_MOBILE_COMM_TYPES))
    return rows.groupBy("pat_id").agg(F.max(F.coalesce("other_communic_num", "home_phone")).alias("phone_number"))


# ---------------------------------------------------- third batch: aggregates


@op("A2", O.with_views(["events_keyed"], """
    SELECT order_key, max(strftime(ts, '%m/%d/%Y %H:%M')) AS max_instant_text FROM events_keyed GROUP BY order_key"""))
def a2(spark, sf):
    e = tables_for(spark, sf)._events_keyed
    return e.groupBy("order_key").agg(F.max(dates.fmt_mdy_hm("ts")).alias("max_instant_text"))


@op("A4", "SELECT l_orderkey, max('Y') AS first_order FROM lineitem GROUP BY l_orderkey")
def a4(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.groupBy("l_orderkey").agg(F.max(F.lit("Y")).alias("first_order"))


@op("A6", """
    SELECT c.c_custkey, count(o.o_orderkey) AS encounters FROM customer c
    LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""")
def a6(spark, sf):
    t = tables_for(spark, sf)
    c, o = t.base("customer").select("c_custkey"), t.base("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("encounters"))


@op("A12", """
    SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS lines
    FROM lineitem GROUP BY l_orderkey""")
def a12(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.groupBy("l_orderkey").agg(aggs.string_agg(F.col("l_linenumber").cast("string"), ",").alias("lines"))


@op("A15", """
    SELECT c.c_nationkey, max(n) AS max_encounters FROM (
      SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) per
    JOIN customer c ON c.c_custkey = per.o_custkey GROUP BY c.c_nationkey""")
def a15(spark, sf):
    t = tables_for(spark, sf)
    per = t.base("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    c = t.base("customer").select("c_custkey", "c_nationkey")
    return (per.join(c, per.o_custkey == c.c_custkey).groupBy("c_nationkey")
            .agg(F.max("n").alias("max_encounters")))


@op("A16", """
    SELECT max(concat(l_orderkey, '-', l_linenumber)) AS rx_key, max(l_quantity) AS quantity
    FROM lineitem GROUP BY l_orderkey, l_linenumber""")
def a16(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return (li.groupBy(F.col("l_orderkey").alias("_o"), F.col("l_linenumber").alias("_l"))
            .agg(F.max(text.concat_ws_null_empty("l_orderkey", F.lit("-"), "l_linenumber")).alias("rx_key"),
                 F.max("l_quantity").alias("quantity")).drop("_o", "_l"))


# ------------------------------------------------------- third batch: scalars


@op("S9", f"""SELECT event_id FROM events
    WHERE ts >= TIMESTAMP '{O.OUTREACH['as_of']} 00:00:00' - INTERVAL 1 DAY AND ts < TIMESTAMP '{O.OUTREACH['as_of']} 00:00:00'""")
def s9(spark, sf):
    e = tables_for(spark, sf).base("events")
    return e.filter(dates.previous_day_window("ts", O.OUTREACH["as_of"])).select("event_id")


@op("S15", "SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS qty, CAST(l_partkey AS VARCHAR) AS part_code FROM lineitem")
def s15(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.select("l_orderkey", F.col("l_quantity").cast("int").alias("qty"), F.col("l_partkey").cast("string").alias("part_code"))


@op("S18", "SELECT l_orderkey, l_returnflag || l_linestatus || '-' || CAST(l_linenumber AS VARCHAR) AS status_line FROM lineitem")
def s18(spark, sf):
    li = tables_for(spark, sf).base("lineitem")
    return li.select("l_orderkey", F.concat("l_returnflag", "l_linestatus", F.lit("-"),
                                            F.col("l_linenumber").cast("string")).alias("status_line"))


@op("S19", O.with_views(["patient"], "SELECT pat_id, coalesce(email_address, home_phone) AS contact FROM patient"))
def s19(spark, sf):
    return tables_for(spark, sf).patient.select("pat_id", F.coalesce("email_address", "home_phone").alias("contact"))


@op("S20", O.with_views(["order_disp_info"], "SELECT order_med_id, nullif(fill_status_c, '50') AS status FROM order_disp_info"))
def s20(spark, sf):
    odi = tables_for(spark, sf).order_disp_info
    return odi.select("order_med_id", F.nullif(F.col("fill_status_c"), F.lit("50")).alias("status"))


@op("S21", """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 1000 THEN 'low' ELSE 'high' END AS balance_band
    FROM customer""")
def s21(spark, sf):
    c = tables_for(spark, sf).base("customer")
    band = F.when(F.col("c_acctbal") < 0, "negative").when(F.col("c_acctbal") < 1000, "low").otherwise("high")
    return c.select("c_custkey", band.alias("balance_band"))


@op("S22", O.with_views(["medicationdispensefact"], """
    SELECT rxnumber, fillnumber, round(firstpayorpaidamount * 0.15, 2) AS copay FROM medicationdispensefact"""))
def s22(spark, sf):
    import decimal
    f = tables_for(spark, sf).medicationdispensefact
    return f.select("rxnumber", "fillnumber",
                    F.round(F.col("firstpayorpaidamount") * F.lit(decimal.Decimal("0.15")), 2)
                    .cast("decimal(18,2)").alias("copay"))


@op("S24", O.with_views(["events_keyed"], "SELECT order_key, date_diff('second', a, b) // 3600 AS hours FROM span",
                        {"span": _SPAN}))
def s24(spark, sf):
    return _order_span(spark, sf).select(
        "order_key", dates.trunc_div(dates.second_boundaries("first_ts", "last_ts"), 3600).alias("hours"))


@op("S25", O.with_views(["medicationdispensefact"], """
    SELECT rxnumber, fillnumber, patientpaidamount + firstpayorpaidamount + secondpayorpaidamount AS paid
    FROM medicationdispensefact"""))
def s25(spark, sf):
    f = tables_for(spark, sf).medicationdispensefact
    return f.select("rxnumber", "fillnumber",
                    (F.col("patientpaidamount") + F.col("firstpayorpaidamount") + F.col("secondpayorpaidamount")).alias("paid"))


@op("S26", O.with_views(["pat_enc"], "SELECT pat_enc_csn_id, contact_date + 1 AS next_day FROM pat_enc"))
def s26(spark, sf):
    return tables_for(spark, sf).pat_enc.select("pat_enc_csn_id", F.date_add("contact_date", 1).alias("next_day"))


@op("S27", O.with_views(["pat_enc"], "SELECT pat_enc_csn_id FROM pat_enc WHERE contact_date = DATE '2000-06-01'"))
def s27(spark, sf):
    pe = tables_for(spark, sf).pat_enc
    return pe.filter(F.col("contact_date") == dates.lit_date("2000-06-01")).select("pat_enc_csn_id")


# ------------------------------------------------------- third batch: sources


@op("IO1", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def io1(spark, sf):
    o = tables_for(spark, sf).base("orders")
    return o.filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey")


@op("IO4", ENTRIES["IO5"][1])
def io4(spark, sf):
    """Stage the day's slice into a new directory (never overwriting in place) and read it back."""
    from ..session import shared_dir
    staged = load.stage_slice(tables_for(spark, sf).patientwic_source, O.LOAD["load_date"])
    path = shared_dir(spark, "staging", "patientwic")
    staged.write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


@op("U3", O.q4())
def u3(spark, sf):
    """Publish an initial snapshot, run the day's load (new snapshot, pointer
    switched last) and read the published target back."""
    import datetime as dt

    from ..session import shared_dir
    from ..sources import sinks
    L = O.LOAD
    src = tables_for(spark, sf).patientwic_source
    root, log_path = shared_dir(spark, "tables", "patientwic_target"), shared_dir(spark, "tables", "etl_log")
    sinks.publish_snapshot(load.initial_target(src, L["load_date"], L["initial_ts"]), root)
    load.run_load(spark, src, root, log_path, L["load_date"], dt.datetime.fromisoformat(L["run_ts"]))
    return sinks.read_table(spark, root)


_RUN_LOG = f"""
    SELECT '{K.LOAD_PROCEDURE_NAME}' AS procedure_name, DATE '{O.LOAD['load_date']}' AS load_date, count(*) AS rows_staged,
           {{deleted}} AS duplicate_rows_deleted, {{merged}} AS rows_merged, '{{status}}' AS status, TIMESTAMP '{O.LOAD['run_ts']}' AS run_datetime
    FROM patientwic_source
    WHERE wicresultdate BETWEEN DATE '{O.LOAD['load_date']}' AND DATE '{O.LOAD['load_date']}' + 1"""
_KEPT = "(count(DISTINCT patientid) + CAST(count(*) > count(patientid) AS INTEGER))"


def _run(spark, sf, gate=None):
    """Publish an initial target, run the day's load and return (log path, target root)."""
    import datetime as dt

    from ..session import shared_dir
    from ..sources import sinks
    L = O.LOAD
    src = tables_for(spark, sf).patientwic_source
    root, log_path = shared_dir(spark, "tables", "patientwic_target"), shared_dir(spark, "tables", "etl_log")
    sinks.publish_snapshot(load.initial_target(src, L["load_date"], L["initial_ts"]), root)
    before = sinks.current_snapshot(spark, root)
    try:
        load.run_load(spark, src, root, log_path, L["load_date"], dt.datetime.fromisoformat(L["run_ts"]), gate=gate)
    except schema_gate.SchemaMismatch:
        if sinks.current_snapshot(spark, root) != before:
            raise AssertionError("a failed load must not publish a snapshot")
    return log_path, root


def _vendor_gate(spark):
    def gate(df):
        schema_gate.assert_schema(schema_gate.expected_schema(spark), schema_gate.actual_columns(df, "dbo", "PatientWIC_Source"))
    return gate


def _success_log(spark, sf):
    """The log row that ``run_load`` appends: its counts come from Observations in the load's own writes."""
    return spark.read.parquet(_run(spark, sf)[0])


for _id in ("IO9", "IO10", "U2"):
    op(_id, O.with_views(["patientwic_source"], _RUN_LOG.format(deleted=f"count(*) - {_KEPT}", merged=_KEPT, status="Success")))(_success_log)


@op("U4", O.with_views(["patientwic_source"], _RUN_LOG.format(deleted="CAST(0 AS BIGINT)", merged="CAST(0 AS BIGINT)", status="Failed")))
def u4(spark, sf):
    """Run the load behind the vendor schema gate. The mapped source carries
    ``patientid`` as bigint where the expected schema says int, so the gate
    raises after the slice was staged: the target keeps its old snapshot and
    one Failed row is logged with the rows staged."""
    return spark.read.parquet(_run(spark, sf, _vendor_gate(spark))[0])


@op("U5", O.with_views(["patientwic_source"], "SELECT * FROM detail WHERE is_mismatch",
                       {"expected": O._expected_values(), "actual": O.GATE_ACTUAL, "detail": O.GATE_DETAIL}))
def u5(spark, sf):
    """The failing columns that the raised error carries."""
    gate = _vendor_gate(spark)
    schema = schema_gate.validate_schema(schema_gate.expected_schema(spark),
                                         schema_gate.actual_columns(tables_for(spark, sf).patientwic_source, "dbo", "PatientWIC_Source")).schema
    try:
        gate(tables_for(spark, sf).patientwic_source)
    except schema_gate.SchemaMismatch as ex:
        return spark.createDataFrame([tuple(d[f] for f in schema.names) for d in ex.details], schema)
    raise AssertionError("the gate must raise")


@op("Q5_declared", O.q5_declared())
def q5_declared(spark, sf):
    """The gate on a catalog table whose vendor narrowed wicresult to varchar(20)."""
    import uuid

    from ..session import shared_dir
    src = tables_for(spark, sf).patientwic_source
    name = f"vendor_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (patientid BIGINT, wicresult VARCHAR(20), wicresultdate DATE) USING parquet LOCATION '{shared_dir(spark, 'vendor')}'")
    try:
        src.select("patientid", "wicresult", "wicresultdate").write.insertInto(name)
        table = spark.table(name)
        actual = schema_gate.actual_columns(table, "dbo", "PatientWIC_Source", schema_gate.declared_lengths(table))
    finally:
        spark.sql(f"DROP TABLE {name}")  # external: the files stay
    detail = schema_gate.validate_schema(schema_gate.expected_schema(spark), actual, length_rule="declared")
    longest = src.agg(F.max(F.length("wicresult")).alias("longest"))
    return detail.select("column_name", "actual_data_type", "expected_max_length", "actual_max_length", "is_wrong_length").crossJoin(longest)


@op("Q3_rejected", O.q3_rejected())
def q3_rejected(spark, sf):
    from ..plans import measures
    M = O.MEASURE
    return measures.rejected_readings(tables_for(spark, sf).measure_tables(), M["start"], M["end"], M["as_of"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: fn for k, (fn, _) in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in ENTRIES.items()}
