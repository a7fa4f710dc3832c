"""Names, lists, patterns and weights that outputs depend on."""

# Billing code type -> column of the charge row, in output order.
CODE_COLUMNS = {
    "CPT": "cpt_code",
    "HCPCS": "hcpcs_code",
    "MS-DRG": "ms_drg_code",
    "NDC": "ndc_code",
    "RC": "rc_code",
    "ICD": "icd_code",
    "DRG": "drg_code",
    "CDM": "cdm_code",
    "LOCAL": "local_code",
    "APC": "apc_code",
    "EAPG": "eapg_code",
    "HIPPS": "hipps_code",
    "CDT": "cdt_code",
    "R-DRG": "r_drg_code",
    "S-DRG": "s_drg_code",
    "APS-DRG": "aps_drg_code",
    "AP-DRG": "ap_drg_code",
    "APR-DRG": "apr_drg_code",
    "TRIS-DRG": "tris_drg_code",
}

# Keywords that mark a plan as belonging to New York.
NEW_YORK_KEYWORDS = [
    "new york",
    "ny ",
    "ny-",
    "nys",
    "nyc",
    "n.y.",
    "empire",
    "healthfirst",
    "fidelis",
    "emblemhealth",
    "metroplus",
    "affinity",
    "excellus",
    "mvp health",
    "cdphp",
    "independent health",
    "univera",
]

# Explanation shown for each billing code type.
CODE_TYPE_EXPLANATIONS = {
    "CPT": "Standard codes for medical procedures and services performed by clinicians.",
    "HCPCS": "Codes for medical services supplies and equipment used for billing.",
    "ICD": "Codes that describe diagnoses and medical conditions being treated.",
    "DRG": "Hospital inpatient case groups used to determine payment for a stay.",
    "MS-DRG": "Medicare severity-adjusted DRG groups for inpatient hospital payment.",
    "R-DRG": "Refined DRG categories that add more clinical detail than basic DRGs.",
    "S-DRG": "Severity-based DRG categories that account for how sick the patient is.",
    "APS-DRG": "All-patient severity-adjusted DRG groups used across broader populations.",
    "AP-DRG": "All-patient DRG categories for grouping inpatient hospital stays.",
    "APR-DRG": "All-patient refined DRG groups with severity and mortality risk levels.",
    "TRIS-DRG": "TRICARE DRG categories used for military health system payment.",
    "APC": "Outpatient hospital payment categories used by Medicare.",
    "NDC": "National Drug Code that identifies a specific medication and package.",
    "HIPPS": "Codes used for payment in post-acute care settings like rehab and skilled nursing.",
    "LOCAL": "Hospital-specific internal billing code used when no standard code fits.",
    "EAPG": "Enhanced outpatient grouping codes used to price outpatient services.",
    "CDT": "Standard codes for dental procedures and services.",
    "RC": "Revenue center code that identifies the hospital department or service area billed.",
    "CDM": "Hospital chargemaster code for a billable item service or supply.",
    "CMG": "Case-mix group used to classify rehabilitation cases for payment.",
    "MS-LTC-DRG": "Medicare severity DRG categories tailored to long-term care hospitals.",
}

# Characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What a plain decimal number looks like.
NUMBER_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# First line of a code description file.
DESCRIPTION_HEADER = ["code_type", "code", "consumer_description"]

# Enumerations of the published file formats.
SETTINGS = ["inpatient", "outpatient", "both"]
MARKET_TYPES = ["group", "individual"]
PLAN_ID_TYPES = ["ein", "hios"]
NEGOTIATION_ARRANGEMENTS = ["ffs", "bundle", "capitation"]
NEGOTIATED_TYPES = ["negotiated", "derived", "fee schedule", "percentage", "per diem"]
RATE_BILLING_CLASSES = ["professional", "institutional", "both"]
CHARGE_BILLING_CLASSES = ["professional", "facility", "both"]
METHODOLOGIES = [
    "case rate",
    "fee schedule",
    "percent of total billed charges",
    "per diem",
    "other",
]
RATE_CODE_TYPES = [
    "CPT", "HCPCS", "ICD", "MS-DRG", "R-DRG", "S-DRG", "APS-DRG", "AP-DRG", "APR-DRG",
    "APC", "NDC", "HIPPS", "LOCAL", "EAPG", "CDT", "RC", "CSTM-ALL",
]

# Patterns of the published file formats.
SERVICE_CODE_PATTERN = (
    "^(0[1-9]|1[0-9]|2[0-7]|3[1-4]|4[1-2]|4[9]|5[0-8]|6[0-2]|6[5-6]|7[1-2]|81|99)$"
)
ANY_SERVICE_CODE_PATTERN = "^CSTM-00$"
EIN_PATTERN = "^[0-9]{2}-?[0-9]{7}$"
NPI_TIN_PATTERN = "^[1-9][0-9]{9}$"
COUNT_PATTERN = r"^(0|1 through 10|1[1-9]|[2-9]\d+|[1-9]\d{2,})$"
URL_PATTERN = "^https://"
ISO_DATE_PATTERN = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"

# Points per criterion of plan matching.
MATCH_WEIGHTS = {
    "state": 15.0,
    "exact_name": 40.0,
    "fuzzy_name": 25.0,
    "issuer": 25.0,
    "metal_level": 10.0,
    "plan_type": 10.0,
    "ein": 50.0,
}
