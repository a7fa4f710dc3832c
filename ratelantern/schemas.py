"""Read schemas of the raw documents and of the charge row."""

from pyspark.sql import types as T

from ratelantern.fixed_values import CODE_COLUMNS

# --- table of contents -----------------------------------------------------------------

FILE_LOCATION = "struct<description: string, location: string>"
REPORTING_STRUCTURE = (
    "struct<"
    "reporting_plans: array<struct<plan_name: string, issuer_name: string, plan_id_type: string,"
    " plan_id: string, plan_sponsor_name: string, plan_market_type: string>>,"
    f" in_network_files: array<{FILE_LOCATION}>,"
    f" allowed_amount_file: {FILE_LOCATION}>"
)
TOC_HEADER = (
    "reporting_entity_name string, reporting_entity_type string,"
    " last_updated_on string, version string"
)
TOC_DOCUMENT = f"{TOC_HEADER}, reporting_structure array<{REPORTING_STRUCTURE}>"

# --- in-network rates ------------------------------------------------------------------

PROVIDER_GROUP = (
    "struct<npi: array<bigint>,"
    " tin: struct<type: string, value: string, business_name: string>>"
)
PROVIDER_REFERENCE = (
    "struct<provider_group_id: bigint, network_name: array<string>,"
    f" provider_groups: array<{PROVIDER_GROUP}>>"
)
CONTAINED_CODE_FIELDS = [
    "billing_code_type",
    "billing_code_type_version",
    "billing_code",
    "description",
]
CONTAINED_CODE = "struct<" + ", ".join(f"{f}: string" for f in CONTAINED_CODE_FIELDS) + ">"
NEGOTIATED_PRICE = (
    "struct<negotiated_type: string, negotiated_rate: double, billing_class: string,"
    " setting: string, expiration_date: string, service_code: array<string>,"
    " billing_code_modifier: array<string>, additional_information: string>"
)
IN_NETWORK_ITEM = (
    "struct<negotiation_arrangement: string, name: string, billing_code_type: string,"
    " billing_code_type_version: string, billing_code: string, description: string,"
    f" negotiated_rates: array<struct<provider_references: array<bigint>,"
    f" provider_groups: array<{PROVIDER_GROUP}>, negotiated_prices: array<{NEGOTIATED_PRICE}>>>,"
    f" bundled_codes: array<{CONTAINED_CODE}>, covered_services: array<{CONTAINED_CODE}>>"
)
RATE_HEADER_REQUIRED = [
    "reporting_entity_name",
    "reporting_entity_type",
    "last_updated_on",
    "version",
]
RATE_HEADER_OPTIONAL = [
    "plan_name",
    "issuer_name",
    "plan_sponsor_name",
    "plan_id_type",
    "plan_id",
    "plan_market_type",
]
RATE_HEADER = ", ".join(f"{f} string" for f in RATE_HEADER_REQUIRED + RATE_HEADER_OPTIONAL)
IN_NETWORK_DOCUMENT = (
    f"{RATE_HEADER}, provider_references array<{PROVIDER_REFERENCE}>,"
    f" in_network array<{IN_NETWORK_ITEM}>"
)

# --- hospital JSON, the union of versions 2 and 3 ----------------------------------------
# Numbers that some files write as text ("24,945.00") are read as text and parsed later.

PAYER_INFORMATION = (
    "struct<payer_name: string, plan_name: string, methodology: string,"
    " standard_charge_dollar: double, standard_charge_percentage: double,"
    " standard_charge_algorithm: string, estimated_amount: double, median_amount: double,"
    " `10th_percentile`: double, `90th_percentile`: double, count: string,"
    " additional_payer_notes: string>"
)
STANDARD_CHARGE = (
    "struct<setting: string, gross_charge: double, gross_charges: string,"
    " discounted_cash: double, minimum: double, maximum: double,"
    " modifier_code: array<string>, additional_generic_notes: string,"
    f" payers_information: array<{PAYER_INFORMATION}>>"
)
HOSPITAL_ITEM = (
    "struct<description: string, code_information: array<struct<code: string, type: string>>,"
    " drug_information: struct<unit: string, type: string>,"
    f" standard_charges: array<{STANDARD_CHARGE}>>"
)
MODIFIER = (
    "struct<description: string, code: string, setting: string,"
    " modifier_payer_information: array<struct<payer_name: string, plan_name: string,"
    " description: string>>>"
)
HOSPITAL_HEADER = (
    "hospital_name string, last_updated_on string, version string,"
    " hospital_location array<string>, location_name array<string>,"
    " hospital_address array<string>, type_2_npi array<string>,"
    " license_information struct<license_number: string, state: string>,"
    " affirmation struct<confirm_affirmation: boolean>,"
    " attestation struct<confirm_attestation: boolean, attester_name: string>"
)
HOSPITAL_DOCUMENT = (
    f"{HOSPITAL_HEADER}, standard_charge_information array<{HOSPITAL_ITEM}>,"
    f" modifier_information array<{MODIFIER}>"
)

# --- the charge row ----------------------------------------------------------------------

_TEXT, _NUMBER = T.StringType(), T.DoubleType()

CHARGE_COLUMNS: dict[str, T.DataType] = {
    "description": _TEXT,
    "setting": _TEXT,
    **{column: _TEXT for column in CODE_COLUMNS.values()},
    "payer_name": _TEXT,
    "plan_name": _TEXT,
    "gross_charge": _NUMBER,
    "discounted_cash": _NUMBER,
    "negotiated_dollar": _NUMBER,
    "negotiated_percentage": _NUMBER,
    "negotiated_algorithm": _TEXT,
    "estimated_amount": _NUMBER,
    "min_charge": _NUMBER,
    "max_charge": _NUMBER,
    "methodology": _TEXT,
    "drug_unit_of_measurement": _NUMBER,
    "drug_type_of_measurement": _TEXT,
    "modifiers": _TEXT,
    "additional_generic_notes": _TEXT,
    "additional_payer_notes": _TEXT,
    "billing_class": _TEXT,
    "financial_aid_policy": _TEXT,
    "general_contract_provisions": _TEXT,
    "hospital_name": _TEXT,
    "last_updated_on": _TEXT,
    "version": _TEXT,
    "hospital_location": _TEXT,
    "hospital_address": _TEXT,
    "license_number": _TEXT,
    "license_state": _TEXT,
    "affirmation": T.BooleanType(),
}

# Values only version 3 JSON carries, plus where a row came from. ``row_ord`` orders the rows
# of a file; ``row_chunk`` cuts that order into pieces small enough for one task.
CHARGE_EXTRAS: dict[str, T.DataType] = {
    "median_amount": _NUMBER,
    "percentile_10th": _NUMBER,
    "percentile_90th": _NUMBER,
    "count": _TEXT,
    "npis": T.ArrayType(_TEXT),
    "attester_name": _TEXT,
    "source_file": _TEXT,
    "row_ord": T.LongType(),
    "row_chunk": T.LongType(),
    "payer_ord": T.IntegerType(),
}

# --- small inputs --------------------------------------------------------------------------

HOSPITAL_PROFILE = (
    "name string, address string, year_founded int, beds map<string, bigint>,"
    " physicians map<string, bigint>, employees map<string, bigint>,"
    " revenue map<string, bigint>, is_inpatient boolean, is_outpatient boolean"
)
PROFILE_METRICS = ["beds", "physicians", "employees", "revenue"]
