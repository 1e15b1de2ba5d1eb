"""One focused check per remaining quirk of SURVEY §2.L (others live in
test_functions / test_operators / test_reports / test_etl)."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from medwright.functions import predicates
from medwright.plans import dispense, load, measures, outreach, safety, turnaround

from .test_reports import T, _df, _measure_tables, _rx_tables, _tat_tables


def test_k3_numerator_results_outside_period_count(spark):
    # the only low A1C is from 2019, years before the 2024 measurement period
    t = _measure_tables(spark, [(100, 1, T(2019, 1, 1), 6.0)])
    r = measures.measure_latest_value(t, "2024-01-01", "2024-12-31", "2024-12-31", with_counts=True).first()
    assert r.numerator == 1


def test_k4_stay_test_as_written_always_passes(spark):
    tabs = _rx_tables(spark)
    long_stay = _df(spark, "pat_enc_csn_id long, adt_pat_class_c int, hosp_disch_time timestamp_ntz, "
                           "hosp_admsn_time timestamp_ntz, department_id long",
                    [(c, 1, T(2024, 2, 20), T(2023, 6, 1), 7) for c in (1, 2, 3, 4)])  # 264-day stays
    tabs = {**tabs, "pat_enc_hsp": long_stay}
    as_written = safety.discharge_cohort(tabs, "2024-02-01", "2024-02-29", [9503]).count()
    fixed = safety.discharge_cohort(tabs, "2024-02-01", "2024-02-29", [9503], los_fixed=True).count()
    assert (as_written, fixed) == (3, 0)


def test_k6_hospice_exclusion_drops_null_class(spark):
    df = spark.createDataFrame([(1, "Hospice"), (2, None), (3, "Commercial"), (4, "hospice")], "id int, fc string")
    kept = [r.id for r in df.filter(predicates.not_equal("fc", "Hospice")).collect()]
    assert kept == [3, 4]  # NULL drops; comparison is exact (case-sensitive)


def test_k10_k11_independent_max_and_lexical_dates(spark):
    df = spark.createDataFrame([(1, "12/31/2023 09:00", "A", 5), (1, "01/02/2024 10:00", "B", 9)],
                               "k int, txt string, a string, b int")
    r = df.groupBy("k").agg(F.max("txt").alias("txt"), F.max("a").alias("a"), F.max("b").alias("b")).first()
    assert r.txt == "12/31/2023 09:00"          # lexical, not chronological (K11)
    assert (r.a, r.b) == ("B", 9)               # columns may come from different rows (K10)


def test_k13_order_status_left_join_is_inner(spark):
    # an order without a status row cannot satisfy "resulting lab IN (..)"
    df = spark.createDataFrame([(1,), (2,)], "order_proc_id long")
    status = spark.createDataFrame([(1, 513435)], "order_proc_id long, resulting_lab_id long")
    out = df.join(status, "order_proc_id", "left").filter(F.col("resulting_lab_id").isin(513435))
    assert [r.order_proc_id for r in out.collect()] == [1]


def _dispense_tables(spark, second_paid):
    fact = _df(spark, """patientdurablekey long, medicationkey long, fillpharmacykey long, firstcoveragekey long,
                         secondcoveragekey long, primarycomponentndc string, primarycomponentquantity double,
                         dispensesentinstant timestamp_ntz, rxnumber string, fillnumber int, dayssupply int, mode string,
                         fillstatus string, _isdeleted int, patientchargedamount decimal(18,2),
                         patientpaidamount decimal(18,2), firstpayorchargedamount decimal(18,2),
                         firstpayorpaidamount decimal(18,2), secondpayorchargedamount decimal(18,2),
                         secondpayorpaidamount decimal(18,2), thirdpayorchargedamount decimal(18,2),
                         thirdpayorpaidamount decimal(18,2), medicationacquisitioncost decimal(18,2)""", [
        (1, 1, 1, 1, None, "NDC1", 30.0, T(2024, 3, 8, 12), "RX1", 0, 30, "Outpatient", "Shipped", 0,
         *[Decimal(x) for x in ("10.00", "10.00", "50.00", "40.00", "5.00")],
         second_paid, Decimal("0.00"), Decimal("0.00"), Decimal("45.00")),
        (1, 1, 1, 1, None, "NDC1", 30.0, T(2024, 3, 8, 12), "RX2", 0, 30, "Outpatient", "Shipped", 1,  # deleted
         *[Decimal("1.00")] * 9),
    ])
    return {"medicationdispensefact": fact,
            "patientdim": _df(spark, "durablekey long, name string", [(1, "PAT")]),
            "medicationdim": _df(spark, "medicationkey long, name string", [(1, "DRUG")]),
            "pharmacydim": _df(spark, "pharmacykey long, name string, npi string", [(1, "PH", "12345")]),
            "coveragedim": _df(spark, "coveragekey long, benefitplanepicid long, subscribergroupnumber string, "
                                      "payorname string, payorfinancialclass string", [(1, 7, "G", "PAYOR", "Commercial")]),
            "clarity_epp": _df(spark, "benefit_plan_id long, benefit_plan_name string", [(7, "PLAN")]),
            "clarity_epp_2": _df(spark, "benefit_plan_id long, bin_num string, processor_cntrl_num string", [(7, "BIN", "PCN")])}


def test_k14_total_paid_null_when_a_payor_amount_is_null(spark):
    t = _dispense_tables(spark, None)
    as_written = dispense.dispense_payer_detail(t, "2024-03-10").collect()
    assert len(as_written) == 1 and as_written[0].total_paid_amount is None and as_written[0].rx_gross_margin is None
    zero = dispense.dispense_payer_detail(t, "2024-03-10", null_as_zero=True).first()
    assert (float(zero.total_paid_amount), float(zero.rx_gross_margin)) == (50.0, 5.0)
    labels = dispense.dispense_payer_detail(t, "2024-03-10", display_names=True).columns
    assert "Primary Payer BIN" in labels and "RX_Gross_Margin" in labels


def test_k19_user_is_lexical_max_not_latest(spark):
    t = _tat_tables(spark)
    extra = _df(spark, "action_id long, action_type_c int, action_dttm_local timestamp_ntz, user_id string",
                [(502, 30, T(2024, 1, 5, 7, 0, 0), "u2")])  # earlier entry by BOB
    t = {**t, "ord_act_ot": t["ord_act_ot"].unionByName(extra)}
    r = {x.order_med_id: x for x in turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00").collect()}
    assert r["2-1"].entered_user == "BOB" and r["2-1"].entered_dttm == T(2024, 1, 5, 8, 0, 0)


def test_k21_flag_list_repeats_when_details_share_an_action(spark):
    t = _tat_tables(spark)
    detail = _df(spark, "action_id long", [(501,), (501,)])
    r = turnaround.tat_flags(t, detail).first()
    assert r.flag_ids == "1,1,90024,90024"


def test_k23_empty_parameter_means_no_filter(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    for empty in (None, [], [None], [""]):
        assert df.filter(predicates.optional_in("x", empty)).count() == 2
    assert df.filter(predicates.optional_in("x", [2])).count() == 1


def test_k28_caller_order_breaks_staging_ties(spark):
    d = dt.date(2024, 3, 10)
    src = spark.createDataFrame([(1, "A", d), (1, "B", d)], "patientid long, wicresult string, wicresultdate date")
    desc = load.dedup(src, "patientid", ["wicresultdate", "wicresult"]).first()
    assert desc.wicresult == "B"


def test_k32_list_start_vs_anywhere(spark):
    results = [(600, 1, T(2024, 6, 1), 7.0)]
    readings = [(6000, "5", T(2024, 6, 1, 9), "120/80")]
    t = _measure_tables(spark, results, readings)
    t = {**t, "clarity_edg": _df(spark, "dx_id long, current_icd10_list string", [(1, "E11.9"), (2, "Z00.0,I10,E11.9")])}
    args = ("2024-01-01", "2024-12-31", "2024-12-31")
    diabetes = measures.measure_latest_value(t, *args, with_counts=True).first()
    bp = measures.measure_bp_control(t, *args, with_counts=True).first()
    assert diabetes.denominator == 2   # patients 1 and 4 via dx 1; patient 6's list does not *start* with E1x
    assert bp.denominator == 2         # I10 anywhere in the list: patients 1 and 6


def test_k34_turnaround_end_is_closed_on_the_timestamp(spark):
    t = _tat_tables(spark)
    inst = T(2024, 1, 5)
    assert turnaround.tat_detail(t, "2024-01-01 00:00:00", inst.isoformat(sep=" ")).count() == 2
    assert turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-04 23:59:59").count() == 0


def test_k36_uninsured_encounters_drop(spark):
    tabs = _rx_tables(spark)
    tabs = {**tabs, "coverage": _df(spark, "coverage_id long, payor_id long", [(2, 1)])}  # nobody's coverage id 1
    assert safety.concurrent_rx(tabs, "2024-02-01", "2024-02-29", [9503]).count() == 0


def test_k12_region_rules_are_data(spark):
    df = spark.createDataFrame([(0, "HUMANA"), (0, "AETNA"), (2, "HUMANA"), (5, "AETNA"), (0, None)], "pos long, payor string")
    rules = [{"pos_ids": (0, 1), "excluded_payors": ("HUMANA",)}, {"pos_ids": (2,), "excluded_payors": ()}]
    got = sorted((r.pos, r.payor) for r in df.filter(outreach.region_payer_rule(rules, F.col("pos"), F.col("payor"))).collect())
    assert got == [(0, "AETNA"), (2, "HUMANA")]   # NULL payer never passes NOT IN; region 5 has no rule
