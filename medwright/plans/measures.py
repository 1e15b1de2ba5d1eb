"""Percentage quality measures: denominator, latest-result numerator, ratio (Q2, Q3).

Both measures share one shape:

* denominator: patients aged ``age_range`` on ``as_of`` with an active problem
  whose ICD-10 list matches, seen in a completed office visit in
  ``[start, end]`` (``SELECT DISTINCT`` over patient, dob, age, list — K33);
* numerator: among those patients, the latest result per patient, tested
  against a threshold;
* result: ``num / den * 100`` rounded to 2 places and rendered as text.

"now" is the explicit ``as_of`` date, so a report reruns identically (S9).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import exact_age, fmt_mdy, lit_date
from ..functions.text import contains, percent_text, split_pair, starts_with_any
from ..operators.windows import latest, latest_any
from ..sources.temptables import stored_once


def denominator(tables: Mapping[str, DataFrame], start, end, as_of, dx_match, age_range) -> DataFrame:
    """Distinct (pat_id, dob, age, current_icd10_list) rows of the denominator."""
    pe, pat, pl, edg = (tables[n] for n in ("pat_enc", "patient", "problem_list", "clarity_edg"))
    visits = (pe.filter((F.col("contact_date") >= lit_date(start)) & (F.col("contact_date") <= lit_date(end))
                        & (F.col("enc_type_c") == K.OFFICE_VISIT_ENC_TYPE) & F.col("appt_cancel_date").isNull())
              .select("pat_id"))
    problems = pl.filter(F.col("problem_status_c") == K.PROBLEM_ACTIVE).select("pat_id", "dx_id")
    dx = edg.filter(dx_match("current_icd10_list")).select("dx_id", "current_icd10_list")
    age = exact_age("birth_date", lit_date(as_of))
    # A visit only qualifies its patient: as a semi-join it never multiplies
    # the patient's problems, however often they come.
    return (pat.select("pat_id", "birth_date").join(visits, "pat_id", "left_semi")
            .join(problems, "pat_id")
            .join(dx, "dx_id")
            .filter(age.between(*age_range))
            .select("pat_id", fmt_mdy("birth_date").alias("dob"), age.alias("age"), "current_icd10_list")
            .distinct())


def _ratio(num: DataFrame, den: DataFrame, name: str, with_counts: bool) -> DataFrame:
    n = num.agg(F.count_distinct("pat_id").alias("numerator"))
    d = den.agg(F.count_distinct("pat_id").alias("denominator"))
    out = n.crossJoin(d)  # 1 x 1 (J13)
    cols = [percent_text("numerator", "denominator").alias(name)]
    if with_counts:
        cols = ["numerator", "denominator", *cols]
    return out.select(*cols)


def _over(den: DataFrame, measure, cache: bool) -> DataFrame:
    """The denominator feeds both the numerator and its own count. With AQE
    the two consumers do not share an exchange, so it is stored once (it is
    one row per qualifying patient and diagnosis list)."""
    return stored_once(den, "denominator", measure) if cache else measure(den)


def a1c_candidates(tables: Mapping[str, DataFrame], den: DataFrame,
                   proc_id=K.A1C_PROC_ID, lab_status=K.LAB_STATUS_FINAL) -> DataFrame:
    """Final A1C results of denominator patients, over all of their encounters (K3)."""
    patients = den.select("pat_id")
    enc = tables["pat_enc"].select("pat_id", "pat_enc_csn_id").join(patients, "pat_id", "left_semi")
    orders = (tables["order_proc"]
              .filter((F.col("lab_status_c") == lab_status) & (F.col("proc_id") == proc_id))
              .select("order_proc_id", "pat_enc_csn_id"))
    results = tables["order_results"].select("order_proc_id", "line", "result_date", "ord_num_value")
    return (enc.join(orders, "pat_enc_csn_id").join(results, "order_proc_id")
            .select("pat_id", "result_date", "line", "ord_num_value"))


def measure_latest_value(tables: Mapping[str, DataFrame], start, end, as_of,
                         dx_prefixes=K.DIABETES_ICD10_PREFIXES, age_range=K.DIABETES_AGE,
                         proc_id=K.A1C_PROC_ID, threshold=K.A1C_THRESHOLD,
                         threshold_stage: str = "pre", with_counts: bool = False, cache: bool = True) -> DataFrame:
    """Diabetes control measure (Q2).

    ``threshold_stage="pre"`` is the report as written: results under the
    threshold are filtered *before* the latest one is chosen, so any patient
    who was ever under it counts (K1). ``"post"`` applies the stated rule:
    the most recent result must be under the threshold (W4 vs W5).
    """
    if threshold_stage not in ("pre", "post"):
        raise ValueError("threshold_stage must be 'pre' or 'post'")
    order = ["result_date", "line", "ord_num_value"]
    under = F.col("ord_num_value") < threshold

    def measure(den: DataFrame) -> DataFrame:
        rows = a1c_candidates(tables, den, proc_id)
        num = latest(rows.filter(under), "pat_id", order) if threshold_stage == "pre" else latest(rows, "pat_id", order).filter(under)
        return _ratio(num, den, "measure_percentage", with_counts)

    return _over(denominator(tables, start, end, as_of, lambda c: starts_with_any(c, dx_prefixes), age_range), measure, cache)


def bp_readings(tables: Mapping[str, DataFrame], den: DataFrame, flowsheet_id=K.BP_FLOWSHEET_ID) -> DataFrame:
    """Blood-pressure readings of denominator patients, parsed from ``sys/dia`` text."""
    patients = den.select("pat_id")
    enc = tables["pat_enc"].select("pat_id", "inpatient_data_id").join(patients, "pat_id", "left_semi")
    rec = tables["ip_flwsht_rec"].select("inpatient_data_id", "fsd_id")
    meas = (tables["ip_flwsht_meas"].filter(F.col("flo_meas_id") == flowsheet_id)
            .select("fsd_id", "recorded_time", "meas_value"))
    systolic, diastolic = split_pair("meas_value")
    return (enc.join(rec, "inpatient_data_id").join(meas, "fsd_id")
            .select("pat_id", F.col("recorded_time").alias("result_date"),
                    systolic.alias("systolic"), diastolic.alias("diastolic"), "meas_value"))


def rejected_readings(tables: Mapping[str, DataFrame], start, end, as_of, dx_token=K.HYPERTENSION_ICD10_TOKEN,
                      age_range=K.HYPERTENSION_AGE) -> DataFrame:
    """How many readings of denominator patients there are, and how many have
    text that is not ``sys/dia`` and so parse to NULL (K31)."""
    den = denominator(tables, start, end, as_of, lambda c: contains(c, dx_token), age_range)
    bad = F.col("meas_value").isNotNull() & (F.col("systolic").isNull() | F.col("diastolic").isNull())
    return bp_readings(tables, den).agg(F.count(F.lit(1)).alias("readings"), F.count_if(bad).alias("rejected"))


def measure_bp_control(tables: Mapping[str, DataFrame], start, end, as_of,
                       dx_token=K.HYPERTENSION_ICD10_TOKEN, age_range=K.HYPERTENSION_AGE,
                       sys_max=K.SYSTOLIC_MAX, dia_max=K.DIASTOLIC_MAX,
                       with_counts: bool = False, cache: bool = True, display_names: bool = False) -> DataFrame:
    """Blood-pressure control measure (Q3).

    Latest readings keep ties (DENSE_RANK, W3); the value test runs after
    the ranking (W5), so a patient passes when any reading at the latest
    instant is under both limits. Malformed readings parse to NULL (K31).
    """
    controlled = (F.col("diastolic") < dia_max) & (F.col("systolic") < sys_max)
    name = K.HYPERTENSION_LABEL if display_names else "hypertension_measure"

    def measure(den: DataFrame) -> DataFrame:
        num = latest_any(bp_readings(tables, den), "pat_id", "result_date", controlled).filter("passes")
        return _ratio(num, den, name, with_counts)

    return _over(denominator(tables, start, end, as_of, lambda c: contains(c, dx_token), age_range), measure, cache)
