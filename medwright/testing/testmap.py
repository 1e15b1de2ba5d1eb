"""Clinical-shaped views over the supplied TPC-H-style test tables.

The reports run on clinical tables (encounters, orders, results, action
logs, a dispensing star schema). The test data is TPC-H-like, so each
clinical table is *derived* from a supplied table with integer arithmetic
only (so Spark and the DuckDB oracle agree bit for bit). Every view grows
with its source table; nothing here is sampled or capped.

The same derivations are written as DuckDB SQL in ``oracle.py``.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Mapping rules (test fixture constants, not report logic).
SEGMENT_DX = {"BUILDING": 1, "MACHINERY": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "AUTOMOBILE": 5}
DX_ICD10_LIST = {1: "E11.9", 2: "E10.65,I10", 3: "I10", 4: "C50.9", 5: "D57.1"}
EVENT_ACTION_TYPE = {"signup": 30, "click": 45, "purchase": 60, "view": 10, "error": 99}


def _case(col: Column, mapping: dict, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out.otherwise(default) if default is not None else out


def _s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _money(cents: Column, pct: int) -> Column:
    """``pct`` percent of an amount in cents, as an exact DECIMAL(18,2)."""
    return ((cents * pct / 100).cast("long") / 100.0).cast("decimal(18,2)")


_SESSIONS: dict[tuple[int, str], "TestTables"] = {}


def tables_for(spark: SparkSession, sf_dir: str) -> "TestTables":
    """The view set for a session and directory, defined once and reused, like
    views in a catalog (plans only: no data is cached)."""
    key = (id(spark._jsparkSession), sf_dir.rstrip("/"))
    if key not in _SESSIONS:
        _SESSIONS[key] = TestTables(spark, sf_dir)
    return _SESSIONS[key]


class TestTables:
    """Lazily built clinical views for one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._base: dict[str, DataFrame] = {}
        self._groups: dict[str, dict[str, DataFrame]] = {}

    def base(self, name: str) -> DataFrame:
        """The supplied table (file listing and footer schema resolved once)."""
        if name not in self._base:
            self._base[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._base[name]

    # ------------------------------------------------------------------ shared
    @cached_property
    def patient(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.base("customer").select(
            key.alias("pat_id"),
            F.date_add(F.lit(dt.date(1930, 1, 1)), ((key * 7919) % 32850).cast("int")).alias("birth_date"),
            F.concat(F.lit("MRN"), _s(key)).alias("pat_mrn_id"),
            F.col("c_name").alias("pat_name"),
            F.concat(F.lit("555-"), F.lpad(_s(key % 10000), 4, "0")).alias("home_phone"),
            F.when(key % 4 != 0, F.concat(F.lit("patient"), _s(key), F.lit("@example.org"))).alias("email_address"),
        )

    @cached_property
    def pat_enc(self) -> DataFrame:
        day = F.to_date("o_orderdate")
        return self.base("orders").select(
            F.col("o_orderkey").alias("pat_enc_csn_id"),
            F.col("o_custkey").alias("pat_id"),
            day.alias("contact_date"),
            (F.col("o_orderkey") * 10 + 1).alias("hsp_account_id"),
            F.col("o_custkey").alias("coverage_id"),
            F.when(F.substring("o_orderpriority", 1, 1).cast("int") <= 3, 101).otherwise(50).alias("enc_type_c"),
            F.when(F.col("o_orderstatus") == "P", day).alias("appt_cancel_date"),
            F.col("o_orderkey").alias("inpatient_data_id"),
        )

    @cached_property
    def clarity_dep(self) -> DataFrame:
        return self.base("nation").select(
            F.col("n_nationkey").cast("long").alias("department_id"),
            F.concat(F.lit("DEPT "), F.col("n_name")).alias("department_name"),
            F.col("n_regionkey").cast("long").alias("rev_loc_id"),
            F.when(F.col("n_regionkey") == 4, 9500).otherwise(9503).cast("long").alias("serv_area_id"),
        )

    @cached_property
    def coverage(self) -> DataFrame:
        return self.base("customer").select(F.col("c_custkey").alias("coverage_id"), F.col("c_custkey").alias("payor_id"))

    @cached_property
    def clarity_epm(self) -> DataFrame:
        c = self.base("customer")
        fin = (F.when(F.col("c_nationkey") % 10 == 9, "Hospice")
               .when(F.col("c_acctbal") < 0, F.lit(None).cast("string")).otherwise("Commercial"))
        return c.select(F.col("c_custkey").alias("payor_id"), F.col("c_mktsegment").alias("payor_name"),
                        fin.alias("financial_class"))

    # ---------------------------------------------------------------- measures
    @cached_property
    def problem_list(self) -> DataFrame:
        c = self.base("customer")
        return c.select(F.col("c_custkey").alias("pat_id"),
                        _case(F.col("c_mktsegment"), SEGMENT_DX, 5).alias("dx_id"),
                        F.when(F.col("c_acctbal") >= 0, 1).otherwise(2).alias("problem_status_c"))

    @cached_property
    def measure_edg(self) -> DataFrame:
        dx = self.problem_list.select("dx_id").distinct()
        return dx.select("dx_id", _case(F.col("dx_id"), DX_ICD10_LIST).alias("current_icd10_list"))

    @cached_property
    def lab_order_proc(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").alias("order_proc_id"), F.col("o_orderkey").alias("pat_enc_csn_id"),
            F.lit(828).alias("proc_id"), F.lit(3).alias("lab_status_c"))

    @cached_property
    def order_results(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("order_proc_id"), F.col("l_linenumber").alias("line"),
            F.col("l_shipdate").alias("result_date"), (F.col("l_quantity") / 4).alias("ord_num_value"))

    @cached_property
    def ip_flwsht_rec(self) -> DataFrame:
        return self.base("orders").select(F.col("o_orderkey").alias("inpatient_data_id"),
                                          F.col("o_orderkey").alias("fsd_id"))

    @cached_property
    def ip_flwsht_meas(self) -> DataFrame:
        # Some readings are not ``sys/dia``.
        text = F.when(F.col("l_partkey") % 29 == 0, "refused").otherwise(
            F.concat(_s((100 + F.col("l_quantity")).cast("int")), F.lit("/"), _s(60 + F.col("l_partkey") % 45)))
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("fsd_id"), F.lit("5").alias("flo_meas_id"),
            F.col("l_shipdate").alias("recorded_time"), text.alias("meas_value"))

    def measure_tables(self) -> dict[str, DataFrame]:
        return {"patient": self.patient, "pat_enc": self.pat_enc, "problem_list": self.problem_list,
                "clarity_edg": self.measure_edg, "order_proc": self.lab_order_proc,
                "order_results": self.order_results, "ip_flwsht_rec": self.ip_flwsht_rec,
                "ip_flwsht_meas": self.ip_flwsht_meas}

    # ------------------------------------------------- concurrent prescriptions
    @cached_property
    def pat_enc_hsp(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.base("orders").select(
            k.alias("pat_enc_csn_id"), (1 + k % 3).cast("int").alias("adt_pat_class_c"),
            F.timestamp_add("HOUR", (k % 120).cast("int"), F.col("o_orderdate")).alias("hosp_disch_time"),
            F.col("o_orderdate").alias("hosp_admsn_time"), (k % 25).alias("department_id"))

    @cached_property
    def clarity_sa(self) -> DataFrame:
        return self.base("region").select((9500 + F.col("r_regionkey")).cast("long").alias("serv_area_id"))

    @cached_property
    def ept_csn(self) -> DataFrame:
        """Mostly one CSN per encounter; some share one with the encounter before, some have two, some NULL."""
        k = F.col("o_orderkey")
        o = self.base("orders")
        own = F.when(k % 97 != 0, F.concat(F.lit("CSN"), _s(F.when(k % 10 == 1, k - 1).otherwise(k))))
        return o.select(k.alias("uci"), own.alias("csn")).unionByName(
            o.filter(k % 40 == 0).select(k.alias("uci"), F.concat(F.lit("CSN2-"), _s(k)).alias("csn")))

    @cached_property
    def pat_enc_dx(self) -> DataFrame:
        return self.base("lineitem").select(F.col("l_orderkey").alias("pat_enc_csn_id"), F.col("l_partkey").alias("dx_id"))

    def _icd_codes(self) -> tuple[Column, Column]:
        key, size = F.col("p_partkey"), F.col("p_size")
        letter = (F.when(F.col("p_type") == "PROMO", "C").when(key % 8 == 0, "D")
                  .when(key % 2 == 0, "E").otherwise("I"))
        code1 = F.concat(letter, F.lpad(_s((size * 7) % 60), 2, "0"), F.lit("."), _s(key % 10))
        code2 = F.concat(F.lit("Z"), F.lpad(_s(size), 2, "0"), F.lit(".0"))
        return code1, code2

    @cached_property
    def rx_edg(self) -> DataFrame:
        # Some diagnoses have no EDG row, although they have codes.
        code1, code2 = self._icd_codes()
        return self.base("part").filter(F.col("p_partkey") % 11 != 0).select(F.col("p_partkey").alias("dx_id"),
                                        F.concat(code1, F.lit(","), code2).alias("current_icd10_list"))

    @cached_property
    def edg_current_icd10(self) -> DataFrame:
        code1, code2 = self._icd_codes()
        p = self.base("part")
        first = p.select(F.col("p_partkey").alias("dx_id"), F.lit(1).alias("line"), code1.alias("code"))
        second = p.select(F.col("p_partkey").alias("dx_id"), F.lit(2).alias("line"), code2.alias("code"))
        return first.unionByName(second)

    @cached_property
    def order_med(self) -> DataFrame:
        li = self.base("lineitem")
        g = li.groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_partkey").alias("medication_id"), F.min("l_shipdate").alias("ordering_date"))
        ln = F.col("l_linenumber")
        discon = (F.when(ln % 4 == 0, F.lit("1900-01-01 00:00:00").cast("timestamp_ntz"))
                  .when(ln % 4 == 1, F.timestamp_add("DAY", F.lit(3), F.col("ordering_date"))))
        return g.select((F.col("l_orderkey") * 8 + ln).alias("order_med_id"), F.col("l_orderkey").alias("pat_enc_csn_id"),
                        "medication_id", discon.alias("discon_time"), "ordering_date")

    @cached_property
    def order_med_3(self) -> DataFrame:
        return self.order_med.select(F.col("order_med_id").alias("order_id"),
                                     F.when(F.col("medication_id") % 3 != 0, 1).alias("epres_dest_c"))

    @cached_property
    def order_med_5(self) -> DataFrame:
        return self.order_med.select(F.col("order_med_id").alias("order_id"),
                                     (7 * (F.col("order_med_id") % 4 + 1)).cast("int").alias("ordered_days_supply_per_fill"))

    @cached_property
    def clarity_medication(self) -> DataFrame:
        size = F.col("p_size")
        return self.base("part").select(
            F.col("p_partkey").alias("medication_id"), F.col("p_name").alias("name"), size.alias("thera_class_c"),
            F.when(size <= 5, size).alias("dea_class_code_c"),
            F.when(F.col("p_type") == "SMALL", 950319).otherwise(100000 + size).alias("pharm_subclass_c"))

    def rx_tables(self) -> dict[str, DataFrame]:
        return {"pat_enc": self.pat_enc, "pat_enc_hsp": self.pat_enc_hsp, "clarity_dep": self.clarity_dep,
                "patient": self.patient, "ept_csn": self.ept_csn, "coverage": self.coverage,
                "clarity_epm": self.clarity_epm, "clarity_sa": self.clarity_sa, "pat_enc_dx": self.pat_enc_dx,
                "clarity_edg": self.rx_edg, "edg_current_icd10": self.edg_current_icd10,
                "order_med": self.order_med, "order_med_3": self.order_med_3, "order_med_5": self.order_med_5,
                "clarity_medication": self.clarity_medication}

    # -------------------------------------------------------------- turnaround
    @cached_property
    def _events_keyed(self) -> DataFrame:
        week = (F.datediff(F.to_date("ts"), F.lit(dt.date(1970, 1, 1))) / 7).cast("long")
        return self.base("events").withColumn("week", week).withColumn("order_key", F.col("user_id") * 10000 + F.col("week"))

    @cached_property
    def order_disp_info(self) -> DataFrame:
        g = self._events_keyed.groupBy("user_id", "week", "order_key").agg(
            F.min("ts").alias("action_instant"), F.count(F.lit(1)).alias("n"))
        u = F.col("user_id")
        return g.select(
            F.col("order_key").alias("order_med_id"), (1 + F.col("week") % 2).cast("int").alias("fill_number"),
            F.concat(F.lit("RX"), _s("order_key")).alias("rx_num_formatted_hx"),
            (u % 25).alias("fill_phr_id"), F.col("week").cast("double").alias("contact_date_real"),
            "action_instant",
            F.when(F.col("n") >= 3, F.to_date("action_instant")).alias("fill_service_date"),
            F.when(u % 7 == 3, "100").when(u % 11 == 5, F.lit(None).cast("string")).otherwise("50").alias("fill_status_c"))

    @cached_property
    def rx_order_med(self) -> DataFrame:
        k = F.col("order_med_id")
        return self.order_disp_info.select(
            "order_med_id", F.when(k % 5 == 0, "2").otherwise("1").alias("ordering_mode_c"),
            F.col("fill_phr_id").alias("login_dep_id"))

    @cached_property
    def rx_phr(self) -> DataFrame:
        return self.base("nation").select(F.col("n_nationkey").cast("long").alias("pharmacy_id"),
                                          F.concat(F.lit("PHARMACY "), _s(F.col("n_nationkey") % 20)).alias("pharmacy_name"))

    @cached_property
    def ord_act_ord_info(self) -> DataFrame:
        return self.order_disp_info.select(F.col("order_med_id").alias("action_id"), F.col("order_med_id").alias("order_id"),
                                           F.col("contact_date_real").alias("order_date"))

    @cached_property
    def ord_act_ot(self) -> DataFrame:
        e = self._events_keyed
        return e.select(F.col("order_key").alias("action_id"),
                        _case(F.col("event_type"), EVENT_ACTION_TYPE, 99).alias("action_type_c"),
                        F.col("ts").alias("action_dttm_local"), _s((F.col("event_id") * 7) % 97).alias("user_id"))

    @cached_property
    def ord_act_flags(self) -> DataFrame:
        e = self._events_keyed.filter(F.col("event_type") == "error")
        return e.select(F.col("order_key").alias("action_id"),
                        _s(90001 + F.col("value").cast("long") % 50).alias("rx_resolv_flag_id"))

    @cached_property
    def flag_info(self) -> DataFrame:
        p = self.base("part").select("p_size").distinct()
        return p.select(_s(90000 + F.col("p_size")).alias("record_id"),
                        F.concat(F.lit("FLAG "), _s("p_size")).alias("display_name"))

    @cached_property
    def flg_map(self) -> DataFrame:
        p = self.base("part").filter(F.col("p_type") != "PROMO").select("p_size").distinct()
        return p.select(_s(90000 + F.col("p_size")).alias("community_id"))

    @cached_property
    def clarity_emp(self) -> DataFrame:
        return self.base("customer").select(_s("c_custkey").alias("epic_emp_id"), F.col("c_name").alias("name"))

    def tat_tables(self) -> dict[str, DataFrame]:
        return {"order_disp_info": self.order_disp_info, "order_med": self.rx_order_med, "clarity_dep": self.clarity_dep,
                "rx_phr": self.rx_phr, "ord_act_ord_info": self.ord_act_ord_info, "ord_act_ot": self.ord_act_ot,
                "ord_act_flags": self.ord_act_flags, "flag_info": self.flag_info, "flg_map": self.flg_map,
                "clarity_emp": self.clarity_emp}

    # ---------------------------------------------------------------- dispense
    @cached_property
    def medicationdispensefact(self) -> DataFrame:
        li, o = self.base("lineitem"), self.base("orders").select("o_orderkey", "o_custkey")
        f = li.join(o, li.l_orderkey == o.o_orderkey)
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        second = F.col("l_linenumber") % 2 == 0
        return f.select(
            F.col("o_custkey").alias("patientdurablekey"), F.col("l_partkey").alias("medicationkey"),
            F.col("l_suppkey").alias("fillpharmacykey"), F.col("o_custkey").alias("firstcoveragekey"),
            F.when(second, F.col("l_suppkey")).alias("secondcoveragekey"),
            F.concat(F.lit("NDC"), F.lpad(_s("l_partkey"), 8, "0")).alias("primarycomponentndc"),
            F.col("l_quantity").alias("primarycomponentquantity"), F.col("l_shipdate").alias("dispensesentinstant"),
            _s("l_orderkey").alias("rxnumber"), F.col("l_linenumber").alias("fillnumber"),
            (F.col("l_linenumber") * 10).alias("dayssupply"),
            F.when(F.col("l_linestatus") == "O", "Outpatient").otherwise("Inpatient").alias("mode"),
            F.when(F.col("l_returnflag") == "R", "Shipped").when(F.col("l_returnflag") == "A", "Dispensed")
             .otherwise("Canceled").alias("fillstatus"),
            F.when(F.col("l_tax") >= 0.08, 1).otherwise(0).alias("_isdeleted"),
            _money(cents, 20).alias("patientchargedamount"), _money(cents, 15).alias("patientpaidamount"),
            _money(cents, 50).alias("firstpayorchargedamount"), _money(cents, 45).alias("firstpayorpaidamount"),
            F.when(second, _money(cents, 10)).alias("secondpayorchargedamount"),
            F.when(second, _money(cents, 8)).alias("secondpayorpaidamount"),
            _money(cents, 0).alias("thirdpayorchargedamount"), _money(cents, 0).alias("thirdpayorpaidamount"),
            _money(cents, 60).alias("medicationacquisitioncost"))

    @cached_property
    def coveragedim(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("coveragekey"), F.col("c_nationkey").cast("long").alias("benefitplanepicid"),
            F.col("c_custkey").alias("coverageepicid"),
            F.concat(F.lit("GRP"), _s(F.col("c_custkey") % 100)).alias("subscribergroupnumber"),
            F.col("c_mktsegment").alias("payorname"),
            F.when(F.col("c_acctbal") < 0, "Self-Pay").otherwise("Commercial").alias("payorfinancialclass"))

    @cached_property
    def clarity_epp(self) -> DataFrame:
        return self.base("nation").select(
            F.col("n_nationkey").cast("long").alias("benefit_plan_id"),
            F.concat(F.lit("PLAN "), F.col("n_name")).alias("benefit_plan_name"), _s("n_regionkey").alias("clm_fin_cl_c"))

    @cached_property
    def clarity_epp_2(self) -> DataFrame:
        n = self.base("nation").filter(F.col("n_regionkey") < 4)
        return n.select(F.col("n_nationkey").cast("long").alias("benefit_plan_id"),
                        F.lpad(_s(F.col("n_nationkey") * 37), 6, "0").alias("bin_num"),
                        F.concat(F.lit("PCN"), _s("n_regionkey")).alias("processor_cntrl_num"))

    def dispense_tables(self) -> dict[str, DataFrame]:
        if "dispense" not in self._groups:
            self._groups["dispense"] = self._dispense_tables()
        return self._groups["dispense"]

    def _dispense_tables(self) -> dict[str, DataFrame]:
        c, p, s = self.base("customer"), self.base("part"), self.base("supplier")
        return {"medicationdispensefact": self.medicationdispensefact,
                "patientdim": c.select(F.col("c_custkey").alias("durablekey"), F.col("c_name").alias("name")),
                "medicationdim": p.select(F.col("p_partkey").alias("medicationkey"), F.col("p_name").alias("name")),
                "pharmacydim": s.select(F.col("s_suppkey").alias("pharmacykey"), F.col("s_name").alias("name"),
                                        _s(1234500 + F.col("s_nationkey")).alias("npi")),
                "coveragedim": self.coveragedim, "clarity_epp": self.clarity_epp, "clarity_epp_2": self.clarity_epp_2}

    # ---------------------------------------------------------------- outreach
    def outreach_tables(self) -> dict[str, DataFrame]:
        if "outreach" not in self._groups:
            self._groups["outreach"] = self._outreach_tables()
        return self._groups["outreach"]

    def _outreach_tables(self) -> dict[str, DataFrame]:
        e, r, c = self.base("events"), self.base("region"), self.base("customer")
        eid, u, rk = F.col("event_id"), F.col("user_id"), F.col("r_regionkey")
        order_proc = e.select(
            eid.alias("order_proc_id"), eid.alias("pat_enc_csn_id"), F.col("ts").alias("order_inst"),
            F.timestamp_add("DAY", F.lit(7), F.col("ts")).alias("fut_expect_comp_dt"),
            F.timestamp_add("DAY", F.lit(30), F.col("ts")).alias("standing_exp_date"),
            F.concat(F.lit("LAB "), F.upper("event_type")).alias("display_name"),
            _s(eid % 10).alias("authrzing_prov_id"),
            F.when(eid % 10 == 7, 95016).otherwise(1 + eid % 3).alias("order_class_c"),
            (1 + eid % 6).alias("order_priority_c"),
            F.when(F.col("value") < 300, 9503).otherwise(7).alias("specimen_type_c"),
            F.when(F.col("event_type").isin("view", "click"), "F").otherwise("S").alias("future_or_stand"),
            (950660 + eid % 10).alias("proc_id"))
        pat_enc = e.select(eid.alias("pat_enc_csn_id"), u.alias("pat_id"), u.alias("coverage_id"))
        ept_csn = e.select(eid.alias("uci"), F.concat(F.lit("CSN"), _s(eid)).alias("csn"))
        order_status = e.select(eid.alias("order_id"), F.when(eid % 9 == 0, 513432).otherwise(513435).alias("resulting_lab_id"))
        ord_map = e.select(eid.alias("cid"), F.concat(F.lit("ORD"), _s(eid)).alias("internal_id"))
        order_proc_2 = e.select(eid.alias("order_proc_id"), (u % 25).alias("login_dep_id"), (u % 5).alias("refg_facility_id"),
                                F.when(eid % 13 == 0, 1).otherwise(2).alias("act_order_c"))
        last_edit = e.select(eid.alias("order_id"),
                             F.when(F.col("value") < 5, 4).when(F.col("value") < 10, 6).otherwise(1).alias("ord_lst_ed_action_c"))
        phone = lambda area: F.concat(F.lit(area), F.lpad(_s(F.col("c_custkey") % 10000), 4, "0"))
        comm = c.select(F.col("c_custkey").alias("pat_id"),
                        F.when(F.col("c_nationkey") % 3 == 0, 1).when(F.col("c_nationkey") % 3 == 1, 6).otherwise(3)
                        .alias("other_communic_c"), phone("321-555-").alias("other_communic_num")).unionByName(
            c.filter(F.col("c_acctbal") > 5000).select(F.col("c_custkey").alias("pat_id"), F.lit(1).alias("other_communic_c"),
                                                       phone("689-555-").alias("other_communic_num")))
        return {
            "order_proc": order_proc, "pat_enc": pat_enc, "coverage": self.coverage, "clarity_epm": self.clarity_epm,
            "patient": self.patient, "ept_csn": ept_csn, "order_status": order_status,
            "clarity_llb": r.select((513432 + rk).cast("long").alias("resulting_lab_id"),
                                    F.concat(F.lit("LAB "), F.col("r_name")).alias("llb_name")),
            "ord_map": ord_map,
            "clarity_ser": self.base("supplier").select(_s("s_suppkey").alias("prov_id"), F.col("s_name").alias("prov_name")),
            "order_proc_2": order_proc_2, "clarity_dep": self.clarity_dep,
            "clarity_dep_4": self.base("nation").select(F.col("n_nationkey").cast("long").alias("department_id"),
                                                        (F.col("n_nationkey") % 4).cast("long").alias("region_id")),
            "clarity_pos": r.select(rk.cast("long").alias("pos_id"), F.col("r_name").alias("pos_name")),
            "clarity_loc": r.select(rk.cast("long").alias("loc_id"), F.concat(F.lit("LOC "), F.col("r_name")).alias("loc_name")),
            "code_assc_map": r.select(F.lit("pos.pos_id").alias("code_name"), _s(rk).alias("code_value"),
                                      F.when(rk == 4, "N").otherwise("Y").alias("active_flag"),
                                      F.lit("salesforce_lab_orders").alias("usage"), F.lit("region_abbr").alias("code_assc_name"),
                                      F.substring("r_name", 1, 3).alias("code_assc_value")),
            "other_communctn": comm,
            "identity_id": c.select(F.col("c_custkey").alias("pat_id"),
                                    F.when(F.col("c_acctbal") >= 0, 9502).otherwise(100).alias("identity_type_id"),
                                    F.concat(F.lit("AMRN"), _s("c_custkey")).alias("identity_id")),
            "zc_order_class": r.select((rk + 1).cast("long").alias("order_class_c"),
                                       F.concat(F.lit("CLASS "), F.col("r_name")).alias("name")),
            "zc_order_priority": r.select((rk + 1).cast("long").alias("order_priority_c"),
                                          F.concat(F.lit("PRIORITY "), F.col("r_name")).alias("name")),
            "zc_specimen_type": r.select((9500 + rk).cast("long").alias("specimen_type_c"),
                                         F.concat(F.lit("SPECIMEN "), F.col("r_name")).alias("name")),
            "order_last_edit": last_edit,
        }

    # -------------------------------------------------------------------- load
    @cached_property
    def patientwic_source(self) -> DataFrame:
        li = self.base("lineitem")
        result = F.concat(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("-"), _s(F.col("l_quantity").cast("int")))
        return li.select(F.when(F.col("l_orderkey") % 13 != 0, F.col("l_orderkey")).alias("patientid"), result.alias("wicresult"),
                         F.to_date("l_shipdate").alias("wicresultdate"))
