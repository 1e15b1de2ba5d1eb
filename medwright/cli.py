"""Command line: run one report, the vendor gate or a daily load over a set of tables and write a CSV extract.

    python -m medwright <report> --tables <dir-or-database> --out <path> [--param key=value ...]

``--tables`` is either a directory holding one Parquet folder per table
(``<dir>/pat_enc``, ``<dir>/patient`` …) or, with ``--catalog``, a database
name (or several, comma separated) whose tables are read with ``spark.table``. Parameters are the report
function's keyword arguments; lists are comma separated, ``rules`` is JSON.
Only the tables a report needs are read, and only the columns it uses.
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from . import constants as K
from .plans import dispense, load, measures, outreach, safety, schema_gate, turnaround
from .sources.namespaces import tables_from

REPORTS = {
    "concurrent-rx": (safety.concurrent_rx, [
        "pat_enc", "pat_enc_hsp", "clarity_dep", "patient", "ept_csn", "coverage", "clarity_epm", "clarity_sa",
        "pat_enc_dx", "clarity_edg", "edg_current_icd10", "order_med", "order_med_3", "order_med_5",
        "clarity_medication"]),
    "diabetes-measure": (measures.measure_latest_value, [
        "pat_enc", "patient", "problem_list", "clarity_edg", "order_proc", "order_results"]),
    "bp-measure": (measures.measure_bp_control, [
        "pat_enc", "patient", "problem_list", "clarity_edg", "ip_flwsht_rec", "ip_flwsht_meas"]),
    "turnaround": (turnaround.turnaround_report, [
        "order_disp_info", "order_med", "clarity_dep", "rx_phr", "ord_act_ord_info", "ord_act_ot",
        "ord_act_flags", "flag_info", "flg_map", "clarity_emp"]),
    "dispense-payer": (dispense.dispense_payer_detail, [
        "medicationdispensefact", "patientdim", "medicationdim", "pharmacydim", "coveragedim", "clarity_epp",
        "clarity_epp_2"]),
    "future-labs": (outreach.future_lab_outreach, [
        "order_proc", "pat_enc", "coverage", "clarity_epm", "patient", "ept_csn", "order_status", "clarity_llb",
        "ord_map", "clarity_ser", "order_proc_2", "clarity_dep", "clarity_dep_4", "clarity_pos", "clarity_loc",
        "code_assc_map", "other_communctn", "identity_id", "zc_order_class", "zc_order_priority",
        "zc_specimen_type", "order_last_edit"]),
}

INT_LISTS = {"service_areas", "rev_locs", "pharmacies", "resulting_labs", "age_range"}
STR_LISTS = {"flags", "npis", "dx_prefixes", "intervention_flags", "excluded_procs"}
BOOLS = {"los_fixed", "null_as_zero", "display_names", "with_counts", "cache"}
INTS = {"days", "keep_snapshots", "buckets", "service_area", "proc_id", "sys_max", "dia_max"}
FLOATS = {"threshold"}


def parse_params(pairs: list[str]) -> dict:
    out: dict = {}
    for pair in pairs:
        key, _, value = pair.partition("=")
        if key in INT_LISTS:
            out[key] = [int(v) for v in value.split(",") if v]
        elif key in STR_LISTS:
            out[key] = [v for v in value.split(",") if v]
        elif key in BOOLS:
            out[key] = value.lower() in ("1", "true", "yes")
        elif key in INTS:
            out[key] = int(value)
        elif key in FLOATS:
            out[key] = float(value)
        elif key == "rules":
            out[key] = json.loads(value)
        else:
            out[key] = value
    return out


def load_tables(spark: SparkSession, names: list[str], source: str, catalog: bool) -> dict[str, DataFrame]:
    if catalog:
        return tables_from(spark, names, source.split(","))
    return {n: spark.read.parquet(f"{source.rstrip('/')}/{n}") for n in names}


def vendor_gate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per expected column of the vendor's table (Q5)."""
    source = tables["patientwic_source"]
    declared = schema_gate.declared_lengths(source)
    actual = schema_gate.actual_columns(source, "dbo", "PatientWIC_Source", declared or None)
    return schema_gate.validate_schema(schema_gate.expected_schema(source.sparkSession), actual, length_rule="declared" if declared else "observed")


def daily_load(tables: Mapping[str, DataFrame], target_root: str, log_path: str, load_date: str, **kw) -> DataFrame:
    """Run one load (Q4); its audit values as a row."""
    source = tables["patientwic_source"]
    audit = load.run_load(source.sparkSession, source, target_root, log_path, load_date, **kw)
    return source.sparkSession.createDataFrame([audit])


REPORTS["vendor-gate"] = (vendor_gate, ["patientwic_source"])
REPORTS["daily-load"] = (daily_load, ["patientwic_source"])


def run(spark: SparkSession, report: str, source: str, params: dict, catalog: bool = False) -> DataFrame:
    fn, names = REPORTS[report]
    return fn(load_tables(spark, names, source, catalog), **params)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    parser = argparse.ArgumentParser(prog="medwright", description=__doc__.splitlines()[0])
    parser.add_argument("report", choices=sorted(REPORTS))
    parser.add_argument("--tables", required=True, help="directory of Parquet tables, or a database with --catalog")
    parser.add_argument("--catalog", action="store_true")
    parser.add_argument("--out", required=True, help="output directory for the headed CSV extract")
    parser.add_argument("--single-file", action="store_true", help="write one CSV file (bounded outputs only)")
    parser.add_argument("--param", action="append", default=[], metavar="KEY=VALUE")
    args = parser.parse_args(argv)
    if spark is None:
        from .session import get_session
        spark = get_session(app_name=f"medwright-{args.report}")
    from .sources.sinks import write_extract
    df = run(spark, args.report, args.tables, parse_params(args.param), args.catalog)
    out = write_extract(df, args.out, single_file=args.single_file)
    if args.report == "vendor-gate" and df.filter("is_mismatch").count():
        raise SystemExit(f"{K.SCHEMA_GATE_MESSAGE} (details in {out})")
    return out
