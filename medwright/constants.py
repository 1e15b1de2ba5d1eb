"""Fixed values the reports must use verbatim.

Everything in this module is a FIXED VALUE taken from the report
definitions (code lists, identifiers, literal labels). They are kept
together, in their original order, so that a reviewer can compare them
with the report specifications line by line. Pipelines take them as
default arguments; callers may override any of them.
"""

# --- FIXED VALUES: concurrent prescription report -------------------------
# ICD-10 prefixes treated as an active cancer diagnosis (51 prefixes).
CANCER_ICD10_PREFIXES = (
    "C",
    "D00", "D01", "D02", "D03", "D04", "D05", "D06", "D07", "D09",
    "D10", "D11", "D12", "D13", "D14", "D15", "D16", "D17", "D18", "D19",
    "D20", "D21", "D22", "D23", "D24", "D25", "D26", "D27", "D28", "D29",
    "D30", "D31", "D32", "D33", "D34", "D35", "D36", "D37", "D38", "D39",
    "D40", "D41", "D42", "D43", "D44", "D45", "D46", "D47", "D48", "D49",
    "D57",
)
SCHEDULE_II_DEA_CLASS = 2
BENZODIAZEPINE_SUBCLASS = 950319
HOSPICE_FINANCIAL_CLASS = "Hospice"
MAX_STAY_DAYS = 120
ADULT_AGE = 18

# --- FIXED VALUES: quality measures -----------------------------------------
DIABETES_ICD10_PREFIXES = ("E10.", "E11.")
A1C_PROC_ID = 828
LAB_STATUS_FINAL = 3
A1C_THRESHOLD = 7.5
DIABETES_AGE = (18, 75)
HYPERTENSION_ICD10_TOKEN = "I10"
BP_FLOWSHEET_ID = "5"
SYSTOLIC_MAX = 140
DIASTOLIC_MAX = 90
HYPERTENSION_AGE = (18, 85)
OFFICE_VISIT_ENC_TYPE = 101
PROBLEM_ACTIVE = 1

# --- FIXED VALUES: pharmacy turnaround report -------------------------------
ACTION_ENTERED = 30
ACTION_FILLED = 45
ACTION_VERIFIED = 60
OUTPATIENT_ORDERING_MODE = "1"
TURNAROUND_SERVICE_AREAS = ("51340984", "9503", "5134521")
EXCLUDED_FILL_STATUS = "100"
INTERVENTION_FLAG_IDS = (
    "90024", "90025", "90026", "90027", "90046001", "90048000", "90048145",
    "90048147", "9508", "513122", "513136", "513159", "51335",
)

# --- FIXED VALUES: dispensing / third-party payer extract -------------------
DISPENSE_MODE = "Outpatient"
DISPENSE_FILL_STATUSES = ("Shipped", "Dispensed")
DISPENSE_NPIS = ("12345",)
DISPENSE_DAYS = 7

# --- FIXED VALUES: future lab outreach extract ------------------------------
OUTREACH_SERVICE_AREA = 9503
OUTREACH_RESULTING_LABS = (513435,)
OUTREACH_SPECIMEN_BLOOD = 9503
OUTREACH_ACTIVE_ORDER = 2
OUTREACH_EXCLUDED_ORDER_CLASSES = (95016,)
OUTREACH_MOBILE_COMM_TYPES = (1, 6)
OUTREACH_IDENTITY_TYPE = 9502
OUTREACH_CANCEL_EDIT_ACTIONS = (4, 6)
OUTREACH_CODE_MAP = {
    "code_name": "pos.pos_id",
    "active_flag": "Y",
    "usage": "salesforce_lab_orders",
    "code_assc_name": "region_abbr",
}
OUTREACH_EXCLUDED_PROC_IDS = (
    "51343890", "51343891", "51343892", "51344011",
    "51344012", "51344013", "51344014", "51344015",
    "51344016", "51344017", "51344018", "51344019",
    "51344020", "51344021", "51344022", "51344023",
    "51344024", "51344025", "51344026", "51344027",
    "51344028", "51344029", "51344030", "51344031",
    "51344335", "51344756", "51343888", "51343889",
    "51345775", "51364522", "51366063", "51376952",
    "950662", "950780", "950781", "950784", "950787",
    "51343957", "51343958", "51343959", "51343960",
    "51343962", "51343965", "51343967", "51343974",
    "51343975", "51343976", "51343977", "51343978",
    "51343983", "51343986", "51343987", "51344002",
    "51358891", "51358892", "51358893", "51358894",
    "51358896", "51360619", "51360636", "51360853",
    "51377783", "95017142", "95022250",
)
# Region rule groups: both groups carry the same placeholder region id in the
# report definition, so the default rules are kept exactly as written.
OUTREACH_REGION_RULES = (
    {
        "region_group": "CFDS",
        "pos_ids": (12345, 12345),
        "excluded_payors": (
            "BLUE CROSS FL", "BLUE CROSS FL MEDICARE", "BLUE CROSS GA", "CAREPLUS",
            "FLORIDA HEALTHCARE PLANS", "FREEDOM HEALTH", "HEALTHSMART",
            "HUMANA", "HUMANA MEDICARE", "SIMPLY HEALTHCARE FL MEDICAID",
            "SUREST", "VETERANS ADMINISTRATION", "WELLCARE MEDICARE",
            "SIMPLY HEALTHCARE MEDICARE", "BLUE CROSS CO", "CHAMPVA", "WELLCARE NC MEDICAID",
        ),
    },
    {
        "region_group": "WFD",
        "pos_ids": (12345, 12345),
        "excluded_payors": (
            "AARP", "ALLIED BENEFIT SYSTEMS", "CAREPLUS", "FLORIDA HEALTHCARE PLANS",
            "FLORIDA HEALTHCARE PLANS MEDICARE", "FREEDOM HEALTH", "GROUP AND PENSION ADMINISTRATORS",
            "HEALTHSMART", "HUMANA", "HUMANA MEDICARE", "LUCENT HEALTH", "MEDICAID FL", "MEDICAID FL SHARE OF COST",
            "MERITAIN HEALTH", "MOLINA HEALTHCARE FL MEDICAID", "OPTIMUM HEALTHCARE", "PREFERRED CARE PARTNERS",
            "PRIORITY HEALTH MEDICARE", "SIMPLY HEALTHCARE FL MEDICAID", "SIMPLY HEALTHCARE MEDICARE",
            "SUNSHINE HEALTH", "SUNSHINE HEALTH FL MEDICAID", "SUREST", "TUFTS HEALTH PLAN", "UMR",
            "UNITED HEALTHCARE FL MEDICAID", "UNITED HEALTHCARE GOLDEN RULE", "VETERANS ADMINISTRATION",
            "WELLCARE MEDICARE", "WELLMED/UNITED HEALTHCARE MEDICARE",
        ),
    },
)

# --- FIXED VALUES: report column labels (display_names=True) ---------------
CONCURRENT_RX_LABELS = {
    "department_id": "DEPARTMENT_ID", "pat_id": "PAT_ID", "age_at_encounter": "Age_At_Encounter", "csn": "CSN",
    "hsp_account_id": "HSP_ACCOUNT_ID", "adt_pat_class_c": "ADT_PAT_CLASS_C", "discharge_date": "Discharge_Date",
    "diagnosis": "Diagnosis", "thera_class_c": "Thera_Class_C", "medication_name": "Medication_Name",
    "med_order_date": "Med_Order_Date", "med_id": "MedId", "counts": "counts",
    "no_concurrent_prescription_flag": "NoConcurrentPrescriptionFlag", "first_order": "FIRST_ORDER",
}
HYPERTENSION_LABEL = "HyperTension_Measure"
TURNAROUND_LABELS = {
    "pharmacy_name": "Pharmacy_Name", "rx_number": "Rx_Number", "order_id": "order_id",
    "rx_fill_number": "rx_fill_number", "action_id": "Action_id", "flag_name": "Flag_Name", "flag_ids": "flag_ids",
    "entered_dttm": "Entered_DtTm", "entered_user": "Entered_User", "filled_dttm": "Filled_DtTm",
    "filled_user": "Filled_User", "verified_dttm": "Verified_DtTm", "verified_user": "Verified_User",
    "time_to_filled": "Time_To_Filled", "time_to_verified": "Time_To_Verified", "turnaround_time": "Turnaround_Time",
    "average_time_to_filled_minutes": "Average_Time_To_Filled_Minutes",
    "average_time_to_verified_minutes": "Average_Time_To_Verified_Minutes",
    "average_turn_around_time_minutes": "Average_Turn_Around_Time_Minutes",
}

# --- FIXED VALUES: incremental load and vendor schema gate ------------------
LOAD_PROCEDURE_NAME = "dbo.LoadPatientWICResults"
STATUS_SUCCESS = "Success"
STATUS_FAILED = "Failed"
VENDOR_SOURCE_NAME = "WIC Vendor"
VENDOR_EXPECTED_SCHEMA = (
    # source_name, table_schema, table_name, column_name, expected_data_type, expected_max_length, is_required
    ("WIC Vendor", "dbo", "PatientWIC_Source", "PatientID", "int", None, True),
    ("WIC Vendor", "dbo", "PatientWIC_Source", "WICResult", "varchar", 50, True),
    ("WIC Vendor", "dbo", "PatientWIC_Source", "WICResultDate", "date", None, True),
)
SCHEMA_GATE_MESSAGE = (
    "Vendor schema validation failed. A required column is missing or has the wrong data type/length."
)

# FIXED VALUES: column labels of the dispensing extract, in its order.
DISPENSE_LABELS = {
    "patient_name": "Patient_Name", "pharmacy_name": "pharmacy_name", "pharmacy_npi": "pharmacy_npi",
    "dispensed_ndc": "Dispensed_ndc", "dispensed_drug": "Dispensed_Drug", "dispensed_date": "Dispensed_Date",
    "rx_number": "RX_Number", "dispensed_quantity": "Dispensed Quantity",
    "dispensed_days_supply": "Dispensed Days Supply", "refill_nbr": "Refill_Nbr",
    "primary_payer_bin": "Primary Payer BIN", "primary_payer_pcn": "Primary Payer PCN",
    "primary_payor_group_number": "Primary Payor Group Number", "primary_payor_name": "Primary Payor Name",
    "primary_participating_plan": "Primary Participating Plan",
    "primary_sponsoring_payor_type": "Primary Sponsoring Payor Type",
    "secondary_payer_bin": "Secondary Payer BIN", "secondary_payer_pcn": "Secondary Payer PCN",
    "secondary_payor_name": "Secondary Payor Name", "secondary_participating_plan": "Secondary Participating Plan",
    "patient_charged_amount": "Patient_Charged_Amount", "patient_paid_amount": "Patient_Paid_Amount",
    "first_payor_charged_amount": "First_Payor_Charged_Amount", "first_payor_paid_amount": "First_Payor_Paid_Amount",
    "second_payor_charged_amount": "Second_Payor_Charged_Amount",
    "second_payor_paid_amount": "Second_Payor_Paid_Amount",
    "third_payor_charged_amount": "Third_Payor_Charged_Amount", "third_payor_paid_amount": "Third_Payor_Paid_Amount",
    "acquisition_cost": "Acquisition_Cost", "total_paid_amount": "Total_Paid_Amount",
    "rx_gross_margin": "RX_Gross_Margin",
}
