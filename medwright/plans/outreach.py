"""Future lab blood-draw outreach extract (Q6).

Yesterday's active, future, blood-specimen lab orders at one service area
and resulting lab, with patient contact details, excluding orders cancelled
by their last edit and payers excluded for the order's region.

Plan shape: the order table is filtered first (a one-day window on
``order_inst`` plus the order-level codes, all pushed into the scan), the
anti-join on cancelling edits runs next, and only then the 18 joins to
encounter, patient and code tables, so every later join sees the small
side of the data. Region/payer rules come in as data (``rules``), not as
edited SQL text (P18, K12): as rule groups in code, or as a rule table (``RuleTable``)
that is joined, whatever its size. The grain is the external order id; every
column is a MAX (K10, K11).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import fmt_mdy, fmt_mdy_hm, lit_ts, previous_day_window, _as_date
from ..functions.predicates import any_of, as_numbers, not_in

COLUMNS = ["region", "region_id", "pat_id", "order_id", "order_instant", "expected_completion_date",
           "standing_expiration_date", "order_name", "auth_provider", "order_priority", "order_class",
           "department_ordering", "patient_id", "csn", "order_specimen_type", "referring_facility", "patient_dob",
           "patient_name", "phone_number", "email", "org_mrn", "lab_name", "encounter_insurance", "split_loc",
           "split_reg"]


def region_payer_rule(rules: Sequence[Mapping], pos_id: Column, payor: Column) -> Column:
    """OR over rule groups of ``pos_id IN (group) AND payor NOT IN (excluded)``.
    As with SQL ``NOT IN``, a NULL payer never passes."""
    return any_of(*[pos_id.isin(list(g["pos_ids"])) & not_in(payor, g["excluded_payors"]) for g in rules])


@dataclass
class RuleTable:
    """Region/payer rules as two tables: the regions a rule covers and the payers it excludes.

    ``regions``: rule, pos_id. ``exclusions``: rule, payor. Rows may repeat.
    """
    regions: DataFrame
    exclusions: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, rules: Sequence[Mapping]) -> "RuleTable":
        """Rule groups as written in code, as tables."""
        regions = [(i, int(p)) for i, g in enumerate(rules) for p in g["pos_ids"]]
        exclusions = [(i, p) for i, g in enumerate(rules) for p in g["excluded_payors"]]
        return cls(spark.createDataFrame(regions, "rule int, pos_id long"), spark.createDataFrame(exclusions, "rule int, payor string"))


def allowed_payers(rows: DataFrame, rules: RuleTable, pos_id: str, payor: str) -> DataFrame:
    """The rows that some rule allows: it covers the row's region and doesn't exclude its payer.

    No row is multiplied by the rules of its region: a row passes when fewer rules exclude its
    payer there than cover its region, and both numbers are aggregated over the rule tables before the join. As with
    ``NOT IN``, a rule with a NULL among its payers allows nothing, and a NULL payer
    passes only a rule that excludes nobody.
    """
    exclusions = rules.exclusions.select("rule", F.col("payor").alias("_payor")).distinct()
    kinds = exclusions.groupBy("rule").agg(F.max(F.col("_payor").isNull()).alias("_closed"))
    covers = (rules.regions.filter(F.col("pos_id").isNotNull()).select("rule", F.col("pos_id").alias("_pos")).distinct()
              .join(kinds, "rule", "left").filter(~F.coalesce("_closed", F.lit(False))))
    offered = covers.groupBy("_pos").agg(F.count(F.lit(1)).alias("_offered"), F.count_if(F.col("_closed").isNull()).alias("_free"))
    barred = covers.join(exclusions, "rule").groupBy(F.col("_pos").alias("_at"), "_payor").agg(F.count(F.lit(1)).alias("_barred"))
    known = rows.columns
    return (rows.join(offered, F.col(pos_id) == F.col("_pos"))
            .join(barred, (F.col(pos_id) == F.col("_at")) & (F.col(payor) == F.col("_payor")), "left")
            .filter((F.col("_free") > 0) | (F.col(payor).isNotNull() & (F.coalesce("_barred", F.lit(0)) < F.col("_offered"))))
            .select(*known))


def _by_rules(rows: DataFrame, rules: Sequence[Mapping] | RuleTable) -> DataFrame:
    if isinstance(rules, RuleTable):
        return allowed_payers(rows, rules, "pos_id", "payor_name")
    return rows.filter(region_payer_rule(rules, F.col("pos_id"), F.col("payor_name")))


def future_lab_outreach(tables: Mapping[str, DataFrame], as_of, rules: Sequence[Mapping] | RuleTable = K.OUTREACH_REGION_RULES,
                        service_area=K.OUTREACH_SERVICE_AREA, resulting_labs: Iterable = K.OUTREACH_RESULTING_LABS,
                        excluded_procs: Iterable = K.OUTREACH_EXCLUDED_PROC_IDS) -> DataFrame:
    today = _as_date(as_of)
    op = (tables["order_proc"]
          .filter(previous_day_window("order_inst", today)
                  & (F.col("future_or_stand") == "F") & (F.col("specimen_type_c") == K.OUTREACH_SPECIMEN_BLOOD)
                  & (F.col("standing_exp_date") >= lit_ts(today))
                  & not_in("proc_id", as_numbers(excluded_procs))
                  & not_in("order_class_c", K.OUTREACH_EXCLUDED_ORDER_CLASSES))
          .select("order_proc_id", "pat_enc_csn_id", "order_inst", "fut_expect_comp_dt", "standing_exp_date",
                  "display_name", "authrzing_prov_id", "order_class_c", "order_priority_c", "specimen_type_c"))
    cancelled = (tables["order_last_edit"].filter(F.col("ord_lst_ed_action_c").isin(*K.OUTREACH_CANCEL_EDIT_ACTIONS))
                 .select(F.col("order_id").alias("order_proc_id")))
    op = op.join(cancelled, "order_proc_id", "left_anti")

    pe = tables["pat_enc"].select("pat_enc_csn_id", "pat_id", "coverage_id")
    cvg = tables["coverage"].select("coverage_id", "payor_id")
    epm = tables["clarity_epm"].select("payor_id", "payor_name")
    pat = tables["patient"].select("pat_id", "pat_mrn_id", "pat_name", "birth_date", "home_phone", "email_address")
    ec = tables["ept_csn"].select(F.col("uci").alias("pat_enc_csn_id"), "csn")
    # A left join whose column is then required by WHERE is an inner join.
    os_ = (tables["order_status"].filter(F.col("resulting_lab_id").isin(list(resulting_labs)))
           .select(F.col("order_id").alias("order_proc_id"), "resulting_lab_id"))
    lab = tables["clarity_llb"].select("resulting_lab_id", "llb_name")
    om = tables["ord_map"].select(F.col("cid").alias("order_proc_id"), "internal_id")
    ser = tables["clarity_ser"].select(F.col("prov_id").alias("authrzing_prov_id"), "prov_name")
    op2 = (tables["order_proc_2"].filter(F.col("act_order_c") == K.OUTREACH_ACTIVE_ORDER)
           .select("order_proc_id", F.col("login_dep_id").alias("department_id"), "refg_facility_id"))
    dep = (tables["clarity_dep"].filter(F.col("serv_area_id") == service_area)
           .select("department_id", "department_name"))
    dep4 = tables["clarity_dep_4"].select("department_id", F.col("region_id").alias("pos_id"))
    pos = tables["clarity_pos"].select("pos_id", "pos_name")
    loc = tables["clarity_loc"].select(F.col("loc_id").alias("refg_facility_id"), "loc_name")
    cm = K.OUTREACH_CODE_MAP
    cam = (tables["code_assc_map"]
           .filter((F.col("code_name") == cm["code_name"]) & (F.col("active_flag") == cm["active_flag"])
                   & (F.col("usage") == cm["usage"]) & (F.col("code_assc_name") == cm["code_assc_name"]))
           .select("code_value", "code_assc_value"))
    comm = (tables["other_communctn"].filter(F.col("other_communic_c").isin(*K.OUTREACH_MOBILE_COMM_TYPES))
            .select("pat_id", "other_communic_num"))
    ident = (tables["identity_id"].filter(F.col("identity_type_id") == K.OUTREACH_IDENTITY_TYPE)
             .select("pat_id", "identity_id"))
    zoc = tables["zc_order_class"].select("order_class_c", F.col("name").alias("order_class_name"))
    zop = tables["zc_order_priority"].select("order_priority_c", F.col("name").alias("order_priority_name"))
    zst = tables["zc_specimen_type"].select("specimen_type_c", F.col("name").alias("specimen_type_name"))

    covered = (op.join(os_, "order_proc_id").join(op2, "order_proc_id").join(dep, "department_id")
               .join(dep4, "department_id").join(pos, "pos_id")
               .join(pe, "pat_enc_csn_id").join(cvg, "coverage_id").join(epm, "payor_id"))
    rows = (_by_rules(covered, rules)
            .join(lab, "resulting_lab_id").join(om, "order_proc_id").join(loc, "refg_facility_id")
            .join(cam, F.col("code_value") == F.col("pos_id").cast("string"))  # text key vs number (J14)
            .join(pat, "pat_id").join(ec, "pat_enc_csn_id")
            .join(zoc, "order_class_c").join(zst, "specimen_type_c")
            .join(ser, "authrzing_prov_id", "left").join(zop, "order_priority_c", "left")
            .join(comm, "pat_id", "left").join(ident, "pat_id", "left"))

    return rows.groupBy(F.col("internal_id").alias("order_id")).agg(
        F.max("pos_name").alias("region"),
        F.max("pos_id").alias("region_id"),
        F.max("pat_id").alias("pat_id"),
        F.max(fmt_mdy_hm("order_inst")).alias("order_instant"),
        F.max(fmt_mdy_hm("fut_expect_comp_dt")).alias("expected_completion_date"),
        F.max(fmt_mdy_hm("standing_exp_date")).alias("standing_expiration_date"),
        F.max("display_name").alias("order_name"),
        F.max("prov_name").alias("auth_provider"),
        F.max("order_priority_name").alias("order_priority"),
        F.max("order_class_name").alias("order_class"),
        F.max("department_name").alias("department_ordering"),
        F.max("pat_mrn_id").alias("patient_id"),
        F.max("csn").alias("csn"),
        F.max("specimen_type_name").alias("order_specimen_type"),
        F.max("loc_name").alias("referring_facility"),
        F.max(fmt_mdy("birth_date")).alias("patient_dob"),
        F.max("pat_name").alias("patient_name"),
        F.max(F.coalesce("other_communic_num", "home_phone")).alias("phone_number"),
        F.max("email_address").alias("email"),
        F.max("identity_id").alias("org_mrn"),
        F.max("llb_name").alias("lab_name"),
        F.max("payor_name").alias("encounter_insurance"),
        F.max("code_value").alias("split_loc"),
        F.max("code_assc_value").alias("split_reg"),
    ).select(*COLUMNS)
