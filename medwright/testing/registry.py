"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by SURVEY §2 ID."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans import dispense, load, measures, outreach, safety, schema_gate, turnaround
from . import mechanisms, oracle, ops  # noqa: F401  mechanisms registers its entries with ops
from .testmap import tables_for as TestTables

M = oracle.MEASURE
FLAGSHIP = "Q8"
T = oracle.TAT


def _q2(stage, counts=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = TestTables(spark, sf_dir).measure_tables()
        return measures.measure_latest_value(t, M["start"], M["end"], M["as_of"], threshold_stage=stage,
                                             with_counts=counts)
    return run


def _q3(counts=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = TestTables(spark, sf_dir).measure_tables()
        return measures.measure_bp_control(t, M["start"], M["end"], M["as_of"], with_counts=counts)
    return run


def _tat(kind, option=None, flags=None, pharmacies=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = TestTables(spark, sf_dir).tat_tables()
        if kind == "report":
            return turnaround.turnaround_report(t, T["start"], T["end"], pharmacies=pharmacies, flags=flags,
                                                report_option=option)
        detail = turnaround.tat_detail(t, T["start"], T["end"], flags=flags, report_option=option)
        if kind == "detail":
            return detail
        if kind == "flags":
            return turnaround.tat_flags(t, detail, flags)
        if kind == "steps":
            return turnaround.tat_step_durations(detail)
        return turnaround.tat_pharmacy_averages(detail)
    return run


RX = oracle.RX


def _rx(kind="report", los_fixed=False, rev_locs=None):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = TestTables(spark, sf_dir).rx_tables()
        if kind == "cohort":
            return safety.discharge_cohort(t, RX["start"], RX["end"], RX["service_areas"])
        return safety.concurrent_rx(t, RX["start"], RX["end"], RX["service_areas"], rev_locs=rev_locs,
                                    los_fixed=los_fixed)
    return run


D = oracle.DISPENSE


def _q7(null_as_zero=False, days=None, display_names=False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = TestTables(spark, sf_dir).dispense_tables()
        return dispense.dispense_payer_detail(t, D["as_of"], D["npis"], days or D["days"], null_as_zero=null_as_zero,
                                              display_names=display_names)
    return run


OUT = oracle.OUTREACH


def _q6(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = TestTables(spark, sf_dir).outreach_tables()
    return outreach.future_lab_outreach(t, OUT["as_of"], OUT["rules"])


L = oracle.LOAD


def _load(kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = TestTables(spark, sf_dir).patientwic_source
        target0 = load.initial_target(src, L["load_date"], L["initial_ts"])
        res = load.load_incremental(src, target0, L["load_date"], L["run_ts"])
        return res.target if kind == "target" else res.log
    return run


def _gate(kind):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        src = TestTables(spark, sf_dir).patientwic_source
        detail = schema_gate.validate_schema(schema_gate.expected_schema(spark),
                                             schema_gate.actual_columns(src, "dbo", "PatientWIC_Source"))
        return detail if kind == "detail" else schema_gate.mismatch_count(detail)
    return run


INTERVENTION_SAMPLE = ["90024", "90025", "90026", "90027", "90031"]


# Inventory IDs whose operator is a step of a pipeline: the key runs the
# pipeline query that exercises it (same Spark plan, same oracle SQL).
ALIASES = {
    "P1": "Q7_display_names", "P2": "S25", "P17": "Q8a_clean", "P21": "Q7",
    "J5": "Q6", "J8": "Q8",
    "A3": "A1", "A7": "Q5_count",
    "IO6": "W2", "IO11": "Q5", "IO12": "Q5", "U6": "Q5",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {**_reports(), **ops.queries()}
    return {**q, **{k: q[v] for k, v in ALIASES.items()}}


def oracle_sql() -> dict[str, str]:
    o = {**_report_sql(), **ops.oracle_sql()}
    return {**o, **{k: o[v] for k, v in ALIASES.items()}}


def _reports() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "Q2": _q2("pre"),
        "Q2_post": _q2("post"),
        "Q2_counts": _q2("pre", True),
        "Q2_post_counts": _q2("post", True),
        "Q3": _q3(),
        "Q3_counts": _q3(True),
        "Q1": _rx(),
        "Q1_cohort": _rx("cohort"),
        "Q1_los_fixed": _rx(los_fixed=True),
        "Q1_rev_locs": _rx(rev_locs=[0, 2]),
        "Q4": _load("target"),
        "Q4_log": _load("log"),
        "Q5": _gate("detail"),
        "Q5_count": _gate("count"),
        "Q6": _q6,
        "Q7": _q7(),
        "Q7_null_as_zero": _q7(True),
        "Q7_year": _q7(days=365),
        "Q7_display_names": _q7(display_names=True),
        "Q8a": _tat("detail"),
        "Q8a_clean": _tat("detail", "2"),
        "Q8a_intervention": _tat("detail", "3"),
        "Q8a_flags": _tat("detail", None, INTERVENTION_SAMPLE),
        "Q8b": _tat("flags"),
        "Q8c": _tat("steps"),
        "Q8d": _tat("avgs"),
        "Q8": _tat("report"),
        "Q8_clean": _tat("report", "2"),
        "Q8_intervention": _tat("report", "3"),
        "Q8_intervention_flags": _tat("report", "3", INTERVENTION_SAMPLE),
        "Q8_pharmacies": _tat("report", None, None, [0, 3, 20]),
    }


def _report_sql() -> dict[str, str]:
    return {
        "Q2": oracle.q2("pre"),
        "Q2_post": oracle.q2("post"),
        "Q2_counts": oracle.q2("pre", True),
        "Q2_post_counts": oracle.q2("post", True),
        "Q3": oracle.q3(),
        "Q3_counts": oracle.q3(True),
        "Q1": oracle.q1(),
        "Q1_cohort": oracle.q1_cohort(),
        "Q1_los_fixed": oracle.q1(los_fixed=True),
        "Q1_rev_locs": oracle.q1(rev_locs=[0, 2]),
        "Q4": oracle.q4(),
        "Q4_log": oracle.q4_log(),
        "Q5": oracle.q5(),
        "Q5_count": oracle.q5_count(),
        "Q6": oracle.q6(),
        "Q7": oracle.q7(),
        "Q7_null_as_zero": oracle.q7(null_as_zero=True),
        "Q7_year": oracle.q7(dict(D, days=365)),
        "Q7_display_names": oracle.q7_display_names(),
        "Q8a": oracle.q8a(),
        "Q8a_clean": oracle.q8a("2"),
        "Q8a_intervention": oracle.q8a("3"),
        "Q8a_flags": oracle.q8a(None, INTERVENTION_SAMPLE),
        "Q8b": oracle.q8b(),
        "Q8c": oracle.q8c(),
        "Q8d": oracle.q8d(),
        "Q8": oracle.q8(),
        "Q8_clean": oracle.q8("2"),
        "Q8_intervention": oracle.q8("3"),
        "Q8_intervention_flags": oracle.q8("3", INTERVENTION_SAMPLE),
        "Q8_pharmacies": oracle.q8(pharmacies=[0, 3, 20]),
    }
