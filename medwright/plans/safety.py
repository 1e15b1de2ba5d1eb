"""Concurrent e-prescribed Schedule II opioid / benzodiazepine report (Q1).

Two aggregation levels, as in the report definition:

1. ``discharge_cohort``: adult discharges in the report window at the given
   service areas, non-hospice payer, no cancer diagnosis (anti-join), one
   row per encounter with its sorted diagnosis-code list;
2. ``concurrent_rx``: the cohort left-joined to qualifying medication
   orders, one row per external CSN with aligned medication lists, the
   order count and the "no concurrent prescription" flag.

The qualifying-orders subquery joins the cohort only to restrict orders to
cohort encounters. Here orders (and diagnosis codes) are restricted by a
semi-join to the encounters discharged in the window — one filtered scan,
a superset of the cohort — and aggregated per encounter before the left
join, which matches the cohort 1:1 and drops the rest. The cohort is consumed once, never
self-joined, and no hot encounter is fanned out through a join.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import day_boundaries, fmt_iso, inclusive_date_window, null_or_sentinel, year_boundaries
from ..functions.predicates import not_equal, optional_in, required_in
from ..functions.text import starts_with_any
from ..operators.aggs import aligned_fields

CSN = "pat_enc_csn_id"


def cancer_encounters(tables: Mapping[str, DataFrame], prefixes=K.CANCER_ICD10_PREFIXES) -> DataFrame:
    """Encounters with a primary-line (LINE = 1) ICD-10 code in the cancer list."""
    icd = tables["edg_current_icd10"].filter((F.col("line") == 1) & starts_with_any("code", prefixes)).select("dx_id")
    edg = tables["clarity_edg"].select("dx_id")
    return tables["pat_enc_dx"].select(CSN, "dx_id").join(edg, "dx_id").join(icd, "dx_id").select(CSN)


def encounter_codes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(encounter, primary code) through two left joins; the LINE = 1 test sits
    in the join condition so encounters without a code keep a NULL (J4)."""
    icd = tables["edg_current_icd10"].filter(F.col("line") == 1).select(F.col("dx_id").alias("edg_dx_id"), "code")
    edg = tables["clarity_edg"].select("dx_id", F.col("dx_id").alias("edg_dx_id"))
    # The code hangs on the EDG row, so a dx without one has no code.
    return tables["pat_enc_dx"].select(CSN, "dx_id").join(edg, "dx_id", "left").join(icd, "edg_dx_id", "left").select(CSN, "dx_id", "code")


def discharge_cohort(tables: Mapping[str, DataFrame], start, end, service_areas: Iterable,
                     rev_locs: Iterable | None = None, los_fixed: bool = False,
                     cancer_prefixes=K.CANCER_ICD10_PREFIXES) -> DataFrame:
    """One row per encounter (the report's ``#enc`` temp table)."""
    enc = tables["pat_enc"].select(CSN, "pat_id", "contact_date", "hsp_account_id", "coverage_id")
    hsp = (tables["pat_enc_hsp"].filter(inclusive_date_window("hosp_disch_time", start, end))
           .select(CSN, "adt_pat_class_c", "hosp_disch_time", "hosp_admsn_time", "department_id"))
    dep = tables["clarity_dep"].filter(optional_in("rev_loc_id", rev_locs)).select("department_id", "serv_area_id")
    pat = tables["patient"].select("pat_id", "birth_date")
    csn = tables["ept_csn"].select(F.col("uci").alias(CSN), "csn")
    cvg = tables["coverage"].select("coverage_id", "payor_id")
    epm = tables["clarity_epm"].filter(not_equal("financial_class", K.HOSPICE_FINANCIAL_CLASS)).select("payor_id")
    sa = tables["clarity_sa"].filter(required_in("serv_area_id", service_areas)).select("serv_area_id")

    age = year_boundaries("birth_date", "contact_date")  # calendar-year age (K5)
    # As written the stay test has its arguments reversed and always passes (K4).
    stay = (day_boundaries("hosp_admsn_time", "hosp_disch_time") if los_fixed
            else day_boundaries("hosp_disch_time", "hosp_admsn_time"))
    rows = (enc.join(hsp, CSN).join(dep, "department_id").join(pat, "pat_id").join(csn, CSN)
            .join(cvg, "coverage_id").join(epm, "payor_id").join(sa, "serv_area_id")
            .filter((age >= K.ADULT_AGE) & (stay <= K.MAX_STAY_DAYS))
            # only encounters discharged in the window can be excluded, so the
            # anti-join body is cut to them before it is shuffled
            .join(cancer_encounters(tables, cancer_prefixes)
                  .join(window_encounters(tables, start, end), CSN, "left_semi"), CSN, "left_anti")
            .withColumn("age_at_encounter", age))
    cohort = rows.groupBy(CSN).agg(
        F.max("pat_id").alias("pat_id"),
        F.max("age_at_encounter").alias("age_at_encounter"),
        F.max("csn").alias("csn"),
        F.max("hsp_account_id").alias("hsp_account_id"),
        F.max("adt_pat_class_c").alias("adt_pat_class_c"),
        F.max(F.to_date("hosp_disch_time")).alias("discharge_date"),
        F.max("department_id").alias("department_id"),
        F.count(F.lit(1)).alias("_rows"))
    # The code list is aggregated per encounter before it meets the cohort
    # (map-side partial lists), so an encounter with a huge number of codes is
    # never shipped row by row through a join. Codes are first limited to
    # encounters discharged in the window: a cheap superset of the cohort.
    codes = (encounter_codes(tables).join(window_encounters(tables, start, end), CSN, "left_semi")
             .groupBy(CSN).agg(F.array_sort(F.collect_list("code")).alias("_codes")))
    # An encounter of several CSNs repeats its codes once per joined row (K9).
    repeated = F.flatten(F.transform("_codes", lambda c: F.array_repeat(c, F.col("_rows").cast("int"))))
    return cohort.join(codes, CSN, "left").select(
        CSN, "pat_id", "age_at_encounter", "csn", "hsp_account_id", "adt_pat_class_c", "discharge_date",
        F.when(F.size("_codes") > 0, F.array_join(repeated, "; ")).alias("diagnosis"), "department_id")


def window_encounters(tables: Mapping[str, DataFrame], start, end) -> DataFrame:
    """Encounters discharged in the report window (one filtered scan)."""
    return tables["pat_enc_hsp"].filter(inclusive_date_window("hosp_disch_time", start, end)).select(CSN)


def qualifying_orders(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Active, e-prescribed Schedule II or benzodiazepine orders per encounter."""
    om = (tables["order_med"].filter(null_or_sentinel("discon_time"))
          .select("order_med_id", CSN, "medication_id", "ordering_date"))
    om3 = tables["order_med_3"].filter(F.col("epres_dest_c").isNotNull()).select(F.col("order_id").alias("order_med_id"))
    med = (tables["clarity_medication"]
           .filter((F.col("dea_class_code_c") == K.SCHEDULE_II_DEA_CLASS)
                   | (F.col("pharm_subclass_c") == K.BENZODIAZEPINE_SUBCLASS))
           .select("medication_id", "thera_class_c", "name"))
    om5 = tables["order_med_5"].select(F.col("order_id").alias("order_med_id"), "ordered_days_supply_per_fill")
    return om.join(om3, "order_med_id").join(med, "medication_id").join(om5, "order_med_id")


def concurrent_rx(tables: Mapping[str, DataFrame], start, end, service_areas: Iterable,
                  rev_locs: Iterable | None = None, los_fixed: bool = False,
                  display_names: bool = False) -> DataFrame:
    """Per-CSN concurrent prescription rows (Q1).

    The flag is 0 when two or more qualifying orders exist (K8). The four
    medication lists are ordered by order id so their entries line up (A11).
    Orders are aggregated per encounter (semi-join to the window's encounters,
    partial + final aggregation), meet the cohort 1:1, and are flattened per
    external CSN: only cohort encounters contribute to a CSN they share with
    others, and a NULL CSN keeps its orders.
    """
    cohort = discharge_cohort(tables, start, end, service_areas, rev_locs, los_fixed)
    row = F.struct(F.col("order_med_id").alias("_k"), F.col("thera_class_c").cast("string").alias("thera_class_c"),
                   F.col("name").alias("medication_name"), fmt_iso("ordering_date").alias("med_order_date"),
                   F.col("order_med_id").cast("string").alias("med_id"))
    orders = (qualifying_orders(tables).join(window_encounters(tables, start, end), CSN, "left_semi")
              .groupBy(CSN).agg(F.collect_list(F.when(F.col("order_med_id").isNotNull(), row)).alias("_orders")))
    encounters = (cohort.join(orders, CSN, "left").groupBy("csn").agg(
        F.max("department_id").alias("department_id"),
        F.max("pat_id").alias("pat_id"),
        F.max("age_at_encounter").alias("age_at_encounter"),
        F.max("hsp_account_id").alias("hsp_account_id"),
        F.max("adt_pat_class_c").alias("adt_pat_class_c"),
        F.max("discharge_date").alias("discharge_date"),
        F.max("diagnosis").alias("diagnosis"),
        F.array_sort(F.flatten(F.collect_list("_orders"))).alias("_orders"))
        .withColumns({**aligned_fields("_orders", ["thera_class_c", "medication_name", "med_order_date", "med_id"], "; "),
                      "counts": F.size("_orders").cast("long")}))
    counts = F.col("counts")
    out = (encounters
           .select("department_id", "pat_id", "age_at_encounter", "csn", "hsp_account_id", "adt_pat_class_c",
                   "discharge_date", "diagnosis", "thera_class_c", "medication_name", "med_order_date", "med_id",
                   "counts",
                   F.when(counts > 1, 0).otherwise(1).alias("no_concurrent_prescription_flag"),
                   F.lit("Y").alias("first_order")))
    if display_names:
        out = out.select(*[F.col(c).alias(K.CONCURRENT_RX_LABELS[c]) for c in out.columns])
    return out
