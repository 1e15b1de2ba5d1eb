"""Pipeline behaviour on small hand-built clinical fixtures (quirk ledger)."""
import datetime as dt

from medwright.plans import measures, safety, turnaround

D = dt.date
T = dt.datetime


def _df(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def _measure_tables(spark, results, readings=()):
    pat_enc = _df(spark, "pat_enc_csn_id long, pat_id long, contact_date date, enc_type_c int, appt_cancel_date date, "
                         "inpatient_data_id long", [
        (10, 1, D(2024, 3, 1), 101, None, 10),
        (20, 2, D(2024, 3, 1), 101, None, 20),    # 14 years old
        (30, 3, D(2024, 3, 1), 101, None, 30),    # inactive problem
        (40, 4, D(2024, 3, 1), 101, None, 40),    # turns 18 on as_of
        (50, 5, D(2024, 3, 1), 101, D(2024, 3, 1), 50),  # cancelled visit
        (60, 6, D(2024, 3, 1), 101, None, 60),
    ])
    patient = _df(spark, "pat_id long, birth_date date", [
        (1, D(1980, 1, 1)), (2, D(2010, 1, 1)), (3, D(1980, 1, 1)), (4, D(2006, 12, 31)), (5, D(1980, 1, 1)),
        (6, D(1970, 2, 28))])
    problems = _df(spark, "pat_id long, dx_id long, problem_status_c int",
                   [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 1, 2), (4, 1, 1), (5, 1, 1), (6, 2, 1)])
    edg = _df(spark, "dx_id long, current_icd10_list string", [(1, "E11.9"), (2, "E10.65,I10")])
    order_proc = _df(spark, "order_proc_id long, pat_enc_csn_id long, proc_id int, lab_status_c int",
                     [(100, 10, 828, 3), (101, 10, 828, 3), (600, 60, 828, 3)])
    order_results = _df(spark, "order_proc_id long, line int, result_date timestamp_ntz, ord_num_value double", results)
    rec = _df(spark, "inpatient_data_id long, fsd_id long", [(10, 1000), (60, 6000)])
    meas = _df(spark, "fsd_id long, flo_meas_id string, recorded_time timestamp_ntz, meas_value string", list(readings))
    return {"pat_enc": pat_enc, "patient": patient, "problem_list": problems, "clarity_edg": edg,
            "order_proc": order_proc, "order_results": order_results, "ip_flwsht_rec": rec, "ip_flwsht_meas": meas}


def test_a1c_threshold_before_vs_after_latest(spark):
    # patient 1: early 6.9, latest 9.1 (K1); patient 6: latest 7.0
    results = [(100, 1, T(2023, 1, 1), 6.9), (101, 1, T(2024, 5, 1), 9.1), (600, 1, T(2024, 6, 1), 7.0)]
    t = _measure_tables(spark, results)
    args = ("2024-01-01", "2024-12-31", "2024-12-31")
    pre = measures.measure_latest_value(t, *args, threshold_stage="pre", with_counts=True).first()
    post = measures.measure_latest_value(t, *args, threshold_stage="post", with_counts=True).first()
    # denominator: patients 1, 4 (18 on as_of), 6 -> 3; 2 too young, 3 inactive, 5 cancelled
    assert (pre.numerator, pre.denominator, pre.measure_percentage) == (2, 3, "66.67%")
    assert (post.numerator, post.denominator, post.measure_percentage) == (1, 3, "33.33%")


def test_bp_latest_ties_and_limits(spark):
    readings = [
        (1000, "5", T(2024, 5, 1, 9), "150/95"),
        (1000, "5", T(2024, 6, 1, 9), "140/89"),   # tie at the latest instant: fails
        (1000, "5", T(2024, 6, 1, 9), "139/89"),   # tie at the latest instant: passes
        (6000, "5", T(2024, 6, 1, 9), "139/90"),   # diastolic not < 90
        (6000, "7", T(2024, 7, 1, 9), "100/60"),   # not a BP flowsheet row
    ]
    t = _measure_tables(spark, [], readings)
    r = measures.measure_bp_control(t, "2024-01-01", "2024-12-31", "2024-12-31", with_counts=True).first()
    # hypertension denominator: patients with I10 on an active problem: 1 and 6
    assert (r.numerator, r.denominator, r.hypertension_measure) == (1, 2, "50%")


def _rx_tables(spark):
    ts = T(2024, 2, 1, 8)
    pe = _df(spark, "pat_enc_csn_id long, pat_id long, contact_date date, hsp_account_id long, coverage_id long",
             [(1, 1, D(2024, 2, 1), 11, 1), (2, 2, D(2024, 2, 1), 12, 1), (3, 3, D(2024, 2, 1), 13, 1),
              (4, 4, D(2024, 2, 1), 14, 1)])
    hsp = _df(spark, "pat_enc_csn_id long, adt_pat_class_c int, hosp_disch_time timestamp_ntz, "
                     "hosp_admsn_time timestamp_ntz, department_id long",
              [(c, 1, T(2024, 2, 3, 10), ts, 7) for c in (1, 2, 3, 4)])
    dep = _df(spark, "department_id long, rev_loc_id long, serv_area_id long", [(7, 70, 9503)])
    patient = _df(spark, "pat_id long, birth_date date", [(1, D(1980, 1, 1)), (2, D(1980, 1, 1)), (3, D(1980, 1, 1)),
                                                           (4, D(2006, 12, 31))])  # 4: calendar-year age 18 (K5)
    csn = _df(spark, "uci long, csn string", [(c, f"CSN{c}") for c in (1, 2, 3, 4)])
    cvg = _df(spark, "coverage_id long, payor_id long", [(1, 1)])
    epm = _df(spark, "payor_id long, financial_class string", [(1, "Commercial")])
    sa = _df(spark, "serv_area_id long", [(9503,)])
    dx = _df(spark, "pat_enc_csn_id long, dx_id long", [(1, 1), (2, 2), (3, 3)])
    edg = _df(spark, "dx_id long", [(1,), (2,), (3,)])
    icd = _df(spark, "dx_id long, line int, code string",
              [(1, 1, "I10"), (2, 1, "C50.9"), (3, 1, "D08.0"), (3, 2, "C18.0")])  # C on line 2 does not count
    om = _df(spark, "order_med_id long, pat_enc_csn_id long, medication_id long, discon_time timestamp_ntz, "
                    "ordering_date timestamp_ntz",
             [(100, 1, 1, None, ts), (101, 1, 2, T(1900, 1, 1), ts), (102, 1, 3, T(2024, 2, 2), ts),
              (300, 3, 1, None, ts), (400, 4, 9, None, ts)])
    om3 = _df(spark, "order_id long, epres_dest_c int", [(100, 1), (101, 1), (102, 1), (300, 1), (400, 1)])
    om5 = _df(spark, "order_id long, ordered_days_supply_per_fill int", [(100, 7), (101, 7), (102, 7), (300, 7), (400, 7)])
    med = _df(spark, "medication_id long, name string, thera_class_c int, dea_class_code_c int, pharm_subclass_c int",
              [(1, "OXY", 60, 2, 1), (2, "LORAZ", 57, None, 950319), (3, "MORPH", 60, 2, 1), (9, "ASPIRIN", 1, None, 2)])
    return {"pat_enc": pe, "pat_enc_hsp": hsp, "clarity_dep": dep, "patient": patient, "ept_csn": csn,
            "coverage": cvg, "clarity_epm": epm, "clarity_sa": sa, "pat_enc_dx": dx, "clarity_edg": edg,
            "edg_current_icd10": icd, "order_med": om, "order_med_3": om3, "order_med_5": om5,
            "clarity_medication": med}


def test_concurrent_rx_flags_and_exclusions(spark):
    out = {r.csn: r for r in safety.concurrent_rx(_rx_tables(spark), "2024-02-01", "2024-02-29", [9503]).collect()}
    assert set(out) == {"CSN1", "CSN3", "CSN4"}          # CSN2 has cancer (C50.9) and is excluded
    r1 = out["CSN1"]                                      # order 102 discontinued; 100 + 101 qualify
    assert (r1.counts, r1.no_concurrent_prescription_flag) == (2, 0)
    assert (r1.med_id, r1.medication_name, r1.thera_class_c) == ("100; 101", "OXY; LORAZ", "60; 57")
    assert r1.diagnosis == "I10" and r1.first_order == "Y"
    assert (out["CSN3"].counts, out["CSN3"].no_concurrent_prescription_flag) == (1, 1)
    assert out["CSN3"].diagnosis == "D08.0"               # D08 is not in the cancer list
    assert (out["CSN4"].counts, out["CSN4"].no_concurrent_prescription_flag, out["CSN4"].med_id) == (0, 1, None)
    assert out["CSN4"].age_at_encounter == 18


def _tat_tables(spark):
    odi = _df(spark, "order_med_id long, fill_number int, rx_num_formatted_hx string, fill_phr_id long, "
                     "contact_date_real double, action_instant timestamp_ntz, fill_service_date date, fill_status_c string",
              [(1, 1, "RX1", 10, 1.0, T(2024, 1, 5), D(2024, 1, 5), "50"),
               (2, 1, "RX2", 11, 1.0, T(2024, 1, 5), D(2024, 1, 5), "50"),
               (3, 1, "RX3", 10, 1.0, T(2024, 1, 5), D(2024, 1, 5), None)])   # NULL status drops
    om = _df(spark, "order_med_id long, ordering_mode_c string, login_dep_id long", [(1, "1", 7), (2, "1", 7), (3, "1", 7)])
    dep = _df(spark, "department_id long, serv_area_id long", [(7, 9503)])
    phr = _df(spark, "pharmacy_id long, pharmacy_name string", [(10, "MAIN"), (11, "MAIN")])  # namesakes (K20)
    link = _df(spark, "action_id long, order_id long, order_date double", [(501, 1, 1.0), (502, 2, 1.0), (503, 3, 1.0)])
    ot = _df(spark, "action_id long, action_type_c int, action_dttm_local timestamp_ntz, user_id string", [
        (501, 30, T(2024, 1, 5, 10, 0, 30), "u1"), (501, 45, T(2024, 1, 5, 11, 0, 29), "u2"),
        (501, 60, T(2024, 1, 5, 20, 5, 29), "u1"),
        (502, 30, T(2024, 1, 5, 8, 0, 0), "u1"), (502, 45, T(2024, 1, 5, 9, 0, 0), "u1"),
        (502, 60, T(2024, 1, 5, 10, 0, 0), "u2"),
        (503, 30, T(2024, 1, 5, 8, 0, 0), "u1"), (503, 60, T(2024, 1, 5, 9, 0, 0), "u1")])
    flags = _df(spark, "action_id long, rx_resolv_flag_id string", [(501, "90024"), (501, "1")])
    info = _df(spark, "record_id string, display_name string", [("90024", "DUR"), ("1", "NOTE")])
    fmap = _df(spark, "community_id string", [("90024",), ("1",)])
    emp = _df(spark, "epic_emp_id string, name string", [("u1", "ANN"), ("u2", "BOB")])
    return {"order_disp_info": odi, "order_med": om, "clarity_dep": dep, "rx_phr": phr, "ord_act_ord_info": link,
            "ord_act_ot": ot, "ord_act_flags": flags, "flag_info": info, "flg_map": fmap, "clarity_emp": emp}


def test_turnaround_report_quirks(spark):
    t = _tat_tables(spark)
    rows = {r.order_id: r for r in turnaround.turnaround_report(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00",
                                                                cache=False).collect()}
    assert set(rows) == {"1-1", "2-1"}
    r1 = rows["1-1"]
    assert (r1.time_to_filled, r1.time_to_verified, r1.turnaround_time) == ("00:60", "9:05", "10:05")
    assert (r1.flag_name, r1.flag_ids) == ("NOTE,DUR", "1,90024")
    assert (r1.entered_user, r1.filled_user, r1.verified_user) == ("ANN", "BOB", "ANN")
    # averages are grouped by name and attached to the max id only
    assert rows["2-1"].average_turn_around_time_minutes == (605 + 120) // 2
    assert r1.average_turn_around_time_minutes is None
    clean = turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00", report_option="2")
    assert [r.order_med_id for r in clean.collect()] == ["2-1"]
    as_number = turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00", report_option=2)
    assert [r.order_med_id for r in as_number.collect()] == ["2-1"]
    unknown = turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00", report_option="4")
    assert unknown.count() == 0   # no branch of the option test is true
    flagged = turnaround.tat_detail(t, "2024-01-01 00:00:00", "2024-01-31 00:00:00", report_option="3")
    assert [r.order_med_id for r in flagged.collect()] == ["1-1"]


def test_display_names_use_report_labels(spark):
    rx = safety.concurrent_rx(_rx_tables(spark), "2024-02-01", "2024-02-29", [9503], display_names=True)
    assert rx.columns[:4] == ["DEPARTMENT_ID", "PAT_ID", "Age_At_Encounter", "CSN"]
    assert "NoConcurrentPrescriptionFlag" in rx.columns and rx.count() == 3
    tat = turnaround.turnaround_report(_tat_tables(spark), "2024-01-01 00:00:00", "2024-01-31 00:00:00",
                                       cache=False, display_names=True)
    assert tat.columns[0] == "Pharmacy_Name" and "Average_Turn_Around_Time_Minutes" in tat.columns
    bp = measures.measure_bp_control(_measure_tables(spark, []), "2024-01-01", "2024-12-31", "2024-12-31",
                                     display_names=True)
    assert bp.columns == ["HyperTension_Measure"]
