"""Third-party payer detail for shipped/dispensed fills (Q7).

Star join: the dispense fact, filtered first (date window, mode, deleted,
fill status — all pushed into the fact scan), then three inner dimensions
and the coverage dimension in two roles (primary, secondary) each with its
plan tables. The grain is rx number + fill number; every output is a MAX
(values may come from different rows when the key repeats, K10).

``total_paid`` and ``rx_gross_margin`` use NULL-propagating ``+`` as
written, so a missing payor amount makes them NULL (K14);
``null_as_zero=True`` treats missing amounts as 0 instead. The three
joins that feed no output column are left out (K15).

Display names: ``display_names=True`` renames columns to the report's
quoted labels (``"Primary Payer BIN"`` ..); the default is snake_case.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.dates import fmt_ymd, trailing_days_window
from ..operators.joins import role


def dispense_payer_detail(tables: Mapping[str, DataFrame], as_of, npis: Iterable[str] = K.DISPENSE_NPIS,
                          days: int = K.DISPENSE_DAYS, null_as_zero: bool = False,
                          display_names: bool = False) -> DataFrame:
    fact = tables["medicationdispensefact"].filter(
        trailing_days_window("dispensesentinstant", as_of, days)
        & (F.col("mode") == K.DISPENSE_MODE) & (F.col("_isdeleted") == 0)
        & F.col("fillstatus").isin(*K.DISPENSE_FILL_STATUSES))
    pat = tables["patientdim"].select(F.col("durablekey").alias("patientdurablekey"), F.col("name").alias("patient_name"))
    med = tables["medicationdim"].select("medicationkey", F.col("name").alias("drug_name"))
    pharm = (tables["pharmacydim"].filter(F.col("npi").isin(list(npis)))
             .select(F.col("pharmacykey").alias("fillpharmacykey"), F.col("name").alias("pharmacy_name"), "npi"))
    cov = tables["coveragedim"].select("coveragekey", "benefitplanepicid", "subscribergroupnumber", "payorname",
                                       "payorfinancialclass")
    epp = tables["clarity_epp"].select("benefit_plan_id", "benefit_plan_name")
    epp2 = tables["clarity_epp_2"].select("benefit_plan_id", "bin_num", "processor_cntrl_num")

    cov1, cov2 = role(cov, "c1_"), role(cov, "c2_")
    plan1, plan2 = role(epp, "p1_"), role(epp, "p2_")
    bin1, bin2 = role(epp2, "b1_"), role(epp2, "b2_")

    rows = (fact.join(pat, "patientdurablekey").join(med, "medicationkey").join(pharm, "fillpharmacykey")
            .join(cov1, F.col("firstcoveragekey") == F.col("c1_coveragekey"), "left")
            .join(plan1, F.col("p1_benefit_plan_id") == F.col("c1_benefitplanepicid"), "left")
            .join(bin1, F.col("b1_benefit_plan_id") == F.col("c1_benefitplanepicid"), "left")
            .join(cov2, F.col("secondcoveragekey") == F.col("c2_coveragekey"), "left")
            .join(bin2, F.col("b2_benefit_plan_id") == F.col("c2_benefitplanepicid"), "left")
            .join(plan2, F.col("p2_benefit_plan_id") == F.col("c2_benefitplanepicid"), "left"))

    paid = ["patientpaidamount", "firstpayorpaidamount", "secondpayorpaidamount", "thirdpayorpaidamount"]
    amount = (lambda c: F.coalesce(F.col(c), F.lit(0))) if null_as_zero else F.col
    total = amount(paid[0])
    for c in paid[1:]:
        total = total + amount(c)

    out = rows.groupBy(F.col("rxnumber").alias("_rx"), F.col("fillnumber").alias("_fill")).agg(
        F.max("patient_name").alias("patient_name"),
        F.max("pharmacy_name").alias("pharmacy_name"),
        F.max("npi").alias("pharmacy_npi"),
        F.max("primarycomponentndc").alias("dispensed_ndc"),
        F.max("drug_name").alias("dispensed_drug"),
        F.max(fmt_ymd("dispensesentinstant")).alias("dispensed_date"),
        F.max("rxnumber").alias("rx_number"),
        F.max("primarycomponentquantity").alias("dispensed_quantity"),
        F.max("dayssupply").alias("dispensed_days_supply"),
        F.max("fillnumber").alias("refill_nbr"),
        F.max("b1_bin_num").alias("primary_payer_bin"),
        F.max("b1_processor_cntrl_num").alias("primary_payer_pcn"),
        F.max("c1_subscribergroupnumber").alias("primary_payor_group_number"),
        F.max("c1_payorname").alias("primary_payor_name"),
        F.max("p1_benefit_plan_name").alias("primary_participating_plan"),
        F.max("c1_payorfinancialclass").alias("primary_sponsoring_payor_type"),
        F.max("b2_bin_num").alias("secondary_payer_bin"),
        F.max("b2_processor_cntrl_num").alias("secondary_payer_pcn"),
        F.max("c2_payorname").alias("secondary_payor_name"),
        F.max("p2_benefit_plan_name").alias("secondary_participating_plan"),
        F.max("patientchargedamount").alias("patient_charged_amount"),
        F.max("patientpaidamount").alias("patient_paid_amount"),
        F.max("firstpayorchargedamount").alias("first_payor_charged_amount"),
        F.max("firstpayorpaidamount").alias("first_payor_paid_amount"),
        F.max("secondpayorchargedamount").alias("second_payor_charged_amount"),
        F.max("secondpayorpaidamount").alias("second_payor_paid_amount"),
        F.max("thirdpayorchargedamount").alias("third_payor_charged_amount"),
        F.max("thirdpayorpaidamount").alias("third_payor_paid_amount"),
        F.max("medicationacquisitioncost").alias("acquisition_cost"),
        F.max(total).cast("decimal(18,2)").alias("total_paid_amount"),
        F.max(total - F.col("medicationacquisitioncost")).cast("decimal(18,2)").alias("rx_gross_margin"),
    ).drop("_rx", "_fill")
    if display_names:
        out = out.select(*[F.col(c).alias(K.DISPENSE_LABELS[c]) for c in out.columns])
    return out
