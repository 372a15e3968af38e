"""Table schemas, code labels and key constraints of the drug-plan data model."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
MONEY = T.DecimalType(10, 2)
RATE = T.DecimalType(10, 4)
PRICE = T.DecimalType(18, 4)


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in columns.items()])


def _channel(name: str) -> dict[str, T.DataType]:
    return {
        f"cost_type_{name}": INT,
        f"cost_amt_{name}": RATE,
        f"cost_min_amt_{name}": MONEY,
        f"cost_max_amt_{name}": MONEY,
    }


PLAN_INFORMATION = _struct(
    contract_id=STR, plan_id=STR, segment_id=STR, plan_key=STR, contract_name=STR,
    plan_name=STR, drug_list_id=STR, premium=MONEY, deductible=MONEY, snp=INT,
    plan_suppressed_yn=STR, state=STR, county_code=STR, ma_region_code=STR,
    pdp_region_code=STR,
)
GEOGRAPHIC_LOCATOR = _struct(
    county_code=STR, state_name=STR, county_name=STR, ma_region_code=STR,
    ma_region_name=STR, pdp_region_code=STR, pdp_region_name=STR,
)
DRUG_LIST_DRUGS = _struct(
    drug_list_id=STR, drug_list_version=STR, contract_year=INT, rxcui=LONG, ndc=STR,
    tier_level_value=INT, quantity_limit_yn=STR, quantity_limit_amount=INT,
    quantity_limit_days=INT, prior_authorization_yn=STR, step_therapy_yn=STR,
)
DRUG_PRICING = _struct(
    plan_key=STR, ndc=STR, days_supply=INT, unit_cost=PRICE, contract_id=STR, plan_id=STR,
)
BENEFICIARY_COSTS = _struct(
    plan_key=STR, coverage_level=INT, tier=INT, days_supply=INT,
    **_channel("pref"), **_channel("nonpref"), **_channel("mail_pref"),
    **_channel("mail_nonpref"), tier_specialty_yn=STR, deductible_applies_yn=STR,
)
PLAN_ENROLLMENT = _struct(
    contract_number=STR, plan_id=STR, plan_name=STR, parent_organization=STR,
    organization_marketing_name=STR, enrollment=LONG,
)
CONTRACT_ORGANIZATIONS = _struct(
    contract_number=STR, parent_organization=STR, organization_marketing_name=STR,
    enrollment=LONG,
)
DRUG_NAMES = _struct(rxcui=LONG, description=STR)

SCHEMAS: dict[str, T.StructType] = {
    "plan_information": PLAN_INFORMATION,
    "geographic_locator": GEOGRAPHIC_LOCATOR,
    "drug_list_drugs": DRUG_LIST_DRUGS,
    "drug_pricing": DRUG_PRICING,
    "beneficiary_costs": BENEFICIARY_COSTS,
    "plan_enrollment": PLAN_ENROLLMENT,
    "contract_organizations": CONTRACT_ORGANIZATIONS,
    "drug_names": DRUG_NAMES,
}

# Tables whose columns are only known from the delivered file: kept as text.
TEXT_TABLES = ("insulin_costs", "excluded_drugs", "indication_based")

# May be absent from a delivery; read as empty then.
OPTIONAL_TABLES = ("drug_pricing", "plan_enrollment", "contract_organizations", "drug_names")

# Enrollment is published for one year only and serves every snapshot.
ENROLLMENT_TABLES = ("plan_enrollment",)
ENROLLMENT_YEAR = 2025

# Column order of the delivered files, for tables renamed by position.
POSITIONAL = {
    "geographic_locator": GEOGRAPHIC_LOCATOR.names,
    "drug_list_drugs": DRUG_LIST_DRUGS.names,
    "beneficiary_costs": ["contract_id", "plan_id", "segment_id", *BENEFICIARY_COSTS.names[1:]],
    "drug_pricing": ["contract_id", "plan_id", "segment_id", "ndc", "days_supply", "unit_cost"],
}

PLAN_KEY_PARTS = ("contract_id", "plan_id", "segment_id")

# Declared keys: table -> unique column lists.
UNIQUE_KEYS = {
    "geographic_locator": ["county_code"],
    "drug_pricing": ["plan_key", "ndc", "days_supply"],
    "beneficiary_costs": ["plan_key", "coverage_level", "tier", "days_supply"],
}

# Declared references: child table and column, parent table and column.
REFERENCES = (
    ("plan_information", "county_code", "geographic_locator", "county_code"),
    ("plan_information", "drug_list_id", "drug_list_drugs", "drug_list_id"),
    ("plan_enrollment", "contract_number", "plan_information", "contract_id"),
    ("beneficiary_costs", "plan_key", "plan_information", "plan_key"),
    ("drug_pricing", "plan_key", "plan_information", "plan_key"),
    ("drug_pricing", "ndc", "drug_list_drugs", "ndc"),
    ("drug_list_drugs", "rxcui", "drug_names", "rxcui"),
)

# Text that a delivered file uses for "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Code labels.
TIER_NAMES = {
    1: "Generic", 2: "Preferred Generic", 3: "Preferred Brand", 4: "Non-Preferred",
    5: "Specialty", 6: "Tier 6",
}
TIER_NAMES_SHORT = {
    1: "Generic", 2: "Preferred Generic", 3: "Preferred Brand", 4: "Non-Preferred",
    5: "Specialty",
}
TIER_NAMES_PAGE = {
    1: "Generic", 2: "Preferred Brand", 3: "Non-Preferred Brand", 4: "Non-Preferred Drug",
    5: "Specialty Tier", 6: "Select Care Drugs",
}
SNP_NAMES = {0: "Standard MA-PD", 1: "SNP Type 1", 2: "Dual Eligible SNP", 3: "SNP Type 3"}
CONTRACT_TYPES = {"H": "MA-PD", "S": "PDP", "R": "PACE"}
COPAY, COINSURANCE, NO_CHARGE = 0, 1, 2
COST_TYPES = {COPAY: "Copay", COINSURANCE: "Coinsurance"}
SPECIALTY_TIER = 5
