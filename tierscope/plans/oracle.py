"""The registered queries restated in SQL for a second engine.

Each text is a WITH chain over the provided tables: the derivation of the drug-plan
tables it needs, then the query.
"""

from __future__ import annotations

import re

from tierscope.plans import samples as P
from tierscope.plans.prelude import PRELUDE

# Fixed values, written out here so that they are not those of the code under test.
COMPANIES = (
    "Elevance", "UnitedHealth", "Humana", "CVS", "Molina", "Centene", "Alignment",
)
COMPANY_PATTERNS = (
    ("ELEVANCE", "Elevance"), ("UNITEDHEALTH", "UnitedHealth"), ("UNITED HEALTH", "UnitedHealth"),
    ("HUMANA", "Humana"), ("CVS", "CVS"), ("AETNA", "CVS"), ("MOLINA", "Molina"),
    ("CENTENE", "Centene"), ("ALIGNMENT", "Alignment"),
)
TIERS = {
    1: "Generic", 2: "Preferred Generic", 3: "Preferred Brand", 4: "Non-Preferred",
    5: "Specialty", 6: "Tier 6",
}
TIERS_SHORT = {tier: name for tier, name in TIERS.items() if tier < 6}
TIERS_PAGE = {
    1: "Generic", 2: "Preferred Brand", 3: "Non-Preferred Brand", 4: "Non-Preferred Drug",
    5: "Specialty Tier", 6: "Select Care Drugs",
}
PLAN_TYPES = {0: "Standard MA-PD", 1: "SNP Type 1", 2: "Dual Eligible SNP", 3: "SNP Type 3"}

FID, CNTY, NDC = f"'{P.DRUG_LIST}'", f"'{P.COUNTY}'", f"'{P.NDC}'"

# ---------------------------------------------------------------- SQL fragments


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def rnd(x: str, digits: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {digits}) AS DOUBLE)"


def avg(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0))"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return rnd(f"CAST({part} AS DOUBLE) * 100.0 / NULLIF({whole}, 0)", digits)


def pct0(part: str, whole: str) -> str:
    return f"COALESCE({pct(part, whole)}, 0.0)"


def rows_if(condition: str) -> str:
    """SUM(CASE ...): NULL over no rows."""
    return f"CAST(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def names(column: str, labels: dict, default: str) -> str:
    whens = " ".join(f"WHEN {code} THEN '{text}'" for code, text in labels.items())
    return f"CASE {column} {whens} ELSE {default} END"


NULL_TEXT = "CAST(NULL AS VARCHAR)"
PA, ST, QL = "prior_authorization_yn", "step_therapy_yn", "quantity_limit_yn"

# ---------------------------------------------------------------- shared derivations

PLAN_ROW = (
    "contract_id, plan_id, segment_id, plan_key, contract_name, plan_name, drug_list_id, "
    "CAST(premium AS DOUBLE) AS premium, CAST(deductible AS DOUBLE) AS deductible, snp, "
    f"{NULL_TEXT} AS plan_suppressed_yn, state, county_code, {NULL_TEXT} AS ma_region_code, "
    f"{NULL_TEXT} AS pdp_region_code"
)
DRUG_ROW = (
    "drug_list_id, rxcui, ndc, tier_level_value, quantity_limit_yn, quantity_limit_amount, "
    "quantity_limit_days, prior_authorization_yn, step_therapy_yn, "
    f"{NULL_TEXT} AS drug_list_version, CAST(NULL AS INTEGER) AS contract_year"
)

SHARED = {
    "plans": "SELECT DISTINCT plan_key, contract_id, plan_id, segment_id, plan_name, drug_list_id, "
    "premium, deductible, snp AS snp_type FROM plan_information",
    "contracts": "SELECT DISTINCT contract_id, contract_name FROM plan_information",
    "pg": "SELECT plan_key, state AS state_code, county_code FROM plan_information",
    "fs": """
SELECT f.drug_list_id, COUNT(DISTINCT d.ndc) AS total_drugs,
       COUNT(DISTINCT d.ndc) FILTER (WHERE d.tier_level_value = 5) AS specialty_drugs
FROM (SELECT DISTINCT drug_list_id FROM plan_information WHERE drug_list_id IS NOT NULL) f
LEFT JOIN drug_list_drugs d USING (drug_list_id) GROUP BY 1""",
    "fsum": """
SELECT fs.*, n.plans_using FROM fs JOIN (SELECT drug_list_id, COUNT(DISTINCT plan_key) AS plans_using
  FROM plans GROUP BY 1) n USING (drug_list_id)""",
    "county": f"""
SELECT g.county_code, g.state_name, g.county_name, COUNT(DISTINCT p.plan_key) AS plan_count,
       {avg('p.premium')} AS avg_premium, MIN(p.premium) AS min_premium, MAX(p.premium) AS max_premium
FROM pg JOIN plans p USING (plan_key) JOIN geographic_locator g ON g.county_code = pg.county_code
GROUP BY 1, 2, 3""",
    "parent": """
SELECT p.contract_id, p.contract_name, COALESCE(e.parent_organization, p.contract_name) AS parent_org
FROM plan_information p LEFT JOIN plan_enrollment e
  ON e.contract_number = p.contract_id AND e.plan_id = p.plan_id
WHERE p.drug_list_id = """ + FID,
    "orgs": """
SELECT parent_organization, MAX(organization_marketing_name) AS organization_marketing_name,
       CAST(SUM(enrollment) AS BIGINT) AS total_enrollment,
       COUNT(DISTINCT contract_number || '-' || plan_id) AS plan_count,
       COUNT(DISTINCT contract_number) AS contract_count, COUNT(DISTINCT drug_list_id) AS drug_list_count
FROM (SELECT DISTINCT e.parent_organization, e.organization_marketing_name, e.contract_number,
             e.plan_id, e.enrollment, p.drug_list_id
      FROM plan_enrollment e JOIN plan_information p
        ON p.contract_id = e.contract_number AND p.plan_id = e.plan_id
      WHERE e.contract_number LIKE 'H%' AND p.drug_list_id IS NOT NULL
        AND e.enrollment IS NOT NULL AND e.parent_organization IS NOT NULL)
GROUP BY 1 ORDER BY total_enrollment DESC, parent_organization""",
    "org_plans": f"""
SELECT e.contract_number, e.plan_id, e.contract_number || '-' || e.plan_id AS plan_full_id,
       e.parent_organization, e.organization_marketing_name, e.plan_name,
       e.enrollment, p.drug_list_id, COUNT(DISTINCT p.state) AS state_count
FROM plan_enrollment e JOIN plan_information p
  ON p.contract_id = e.contract_number AND p.plan_id = e.plan_id
WHERE e.parent_organization = '{P.ORGANIZATION}' AND e.contract_number LIKE 'H%'
  AND p.drug_list_id IS NOT NULL
GROUP BY ALL""",
    "contract_f": f"""
SELECT drug_list_id, MAX(contract_name) AS contract_name, COUNT(DISTINCT plan_id) AS plan_count,
       COUNT(DISTINCT state) AS state_count, COUNT(DISTINCT county_code) AS county_count
FROM plan_information WHERE contract_id = '{P.CONTRACT}' GROUP BY 1""",
    "rules1": "SELECT plan_key, tier, cost_type_pref AS kind, cost_amt_pref AS amt, "
    "cost_max_amt_pref AS cap, tier_specialty_yn AS spec, TRUE AS ruled FROM beneficiary_costs "
    "WHERE (coverage_level, days_supply) = (1, 1)",
    "own30": """
SELECT x.*, d.tier_level_value AS tier, u.unit_cost AS unit, d.ndc
FROM plans x, drug_list_drugs d, (SELECT * FROM drug_pricing WHERE days_supply = 30) u
WHERE d.drug_list_id = x.drug_list_id AND u.plan_key = x.plan_key AND u.ndc = d.ndc""",
    "shared30": """
SELECT o.*, r.kind, r.amt, r.cap, r.ruled,
       CASE r.kind WHEN 0 THEN r.amt WHEN 1 THEN LEAST(o.unit * r.amt, r.cap) ELSE 0 END AS pays
FROM own30 o LEFT JOIN rules1 r USING (plan_key, tier)""",
    "tier_price": f"""
SELECT dp.ndc, {avg('dp.unit_cost')} AS price FROM drug_pricing dp
JOIN plan_information p ON p.plan_key = dp.plan_key WHERE p.drug_list_id = {FID} GROUP BY 1""",
    "tier_rule": f"""
SELECT bc.cost_type_pref AS kind, {dbl('bc.cost_amt_pref')} AS amount, bc.tier_specialty_yn AS spec
FROM beneficiary_costs bc JOIN plan_information p ON p.plan_key = bc.plan_key
WHERE p.drug_list_id = {FID} AND bc.coverage_level = 1 AND bc.tier = {P.TIER}
ORDER BY 2 NULLS LAST, 1, 3 LIMIT 1""",
    "tier_page": f"""
SELECT d.rxcui, d.ndc, d.tier_level_value AS tier, d.{PA} AS prior_auth, d.{ST} AS step_therapy,
       d.{QL} AS quantity_limit, COALESCE(t.price, 0.0) AS negotiated_cost,
       CASE WHEN r.kind IN (1, 2) AND r.amount > 0 THEN 'COINSURANCE' ELSE 'COPAY' END AS cost_type,
       CASE WHEN r.kind IN (1, 2) AND r.amount < 1 THEN r.amount * 100 ELSE r.amount END AS cost_amt,
       r.spec AS is_specialty,
       CASE WHEN r.kind = 0 THEN r.amount
            WHEN r.kind IN (1, 2) AND r.amount >= 1 THEN t.price * (r.amount / 100.0)
            WHEN r.kind IN (1, 2) AND r.amount < 1 THEN t.price * r.amount ELSE 0.0 END AS member_pays,
       COALESCE(t.price, 0.0) - member_pays AS plan_net_cost
FROM (SELECT DISTINCT rxcui, ndc, tier_level_value, {PA}, {ST}, {QL} FROM drug_list_drugs
      WHERE drug_list_id = {FID} AND tier_level_value = {P.TIER}) d
LEFT JOIN tier_price t ON t.ndc = d.ndc CROSS JOIN tier_rule r
ORDER BY negotiated_cost DESC, d.ndc, d.rxcui""",
    "sample_key": f"SELECT MIN(plan_key) AS k FROM plan_information WHERE drug_list_id = {FID}",
    "dosage": r"""
SELECT rxcui, CASE
    WHEN len(m) > 0 THEN COALESCE(
      list_filter(m, lambda x: x.v >= 1 AND x.v = list_max(list_transform(m, lambda y: y.v)))[1].t,
      m[len(m)].t)
    WHEN regexp_extract(description, '(\d+(\.\d+)?)', 1) <> ''
      THEN regexp_extract(description, '(\d+(\.\d+)?)', 1) || 'mg'
    ELSE 'N/A' END AS dosage
FROM (SELECT rxcui, description, list_transform(
        regexp_extract_all(description, '(?i)\d+(?:\.\d+)?\s*(?:MG/ML|MG)'),
        lambda s: {'v': CAST(regexp_extract(s, '\d+(?:\.\d+)?') AS DOUBLE),
                   't': regexp_extract(s, '\d+(?:\.\d+)?') || ' ' || regexp_extract(s, '(?i)MG/ML|MG')}) AS m
      FROM drug_names)""",
    "grp": "SELECT * FROM (VALUES "
    + ", ".join(f"('{g}', {r})" for g, listed in P.DRUG_GROUPS.items() for r in listed)
    + ") v(drug_name, rxcui)",
    "company": "SELECT * FROM (VALUES " + ", ".join(f"('{c}')" for c in COMPANIES) + ") v(company)",
    "gndc": "SELECT DISTINCT g.drug_name, d.rxcui, d.ndc FROM drug_list_drugs d JOIN grp g "
    "ON g.rxcui = d.rxcui WHERE d.ndc <> ''",
    "owned": """
SELECT p.*, COALESCE(e.parent_organization, p.contract_name) AS parent_org
FROM plan_information p LEFT JOIN plan_enrollment e
  ON e.contract_number = p.contract_id AND e.plan_id = p.plan_id""",
    "cplans": "SELECT DISTINCT contract_id, plan_id, plan_key, drug_list_id, parent_org, CASE "
    + " ".join(f"WHEN UPPER(parent_org) LIKE '%{p}%' THEN '{c}'" for p, c in COMPANY_PATTERNS)
    + " END AS company FROM owned WHERE contract_id IN (SELECT contract_id FROM owned WHERE "
    + " OR ".join(f"UPPER(parent_org) LIKE '%{c.upper()}%'" for c in COMPANIES)
    + ")",
    "cp": "SELECT * FROM cplans WHERE company IS NOT NULL",
    "gdose": "SELECT g.*, COALESCE(x.dosage, 'NDC: ' || g.ndc) AS dosage FROM gndc g "
    "LEFT JOIN dosage x ON x.rxcui = g.rxcui",
    "cov_total": "SELECT company, COUNT(DISTINCT drug_list_id) AS total_drug_lists, "
    "COUNT(DISTINCT plan_id) AS total_plans FROM cp GROUP BY 1",
    "cov": "SELECT cp.company, g.drug_name, g.rxcui, g.ndc, "
    "COUNT(DISTINCT cp.drug_list_id) AS drug_lists_with_drug, "
    "COUNT(DISTINCT cp.plan_id) AS plans_with_drug, "
    + ", ".join(
        f"COUNT(DISTINCT cp.plan_id) FILTER (WHERE {cond}) AS {name}_count"
        for name, cond in [
            *[(f"tier{n}", f"d.tier_level_value = {n}") for n in (3, 4, 5, 6)],
            ("pa", f"d.{PA} = 'Y'"), ("st", f"d.{ST} = 'Y'"), ("ql", f"d.{QL} = 'Y'"),
        ]
    )
    + " FROM cp JOIN drug_list_drugs d ON d.drug_list_id = cp.drug_list_id "
    "JOIN gndc g ON g.ndc = d.ndc AND g.rxcui = d.rxcui GROUP BY 1, 2, 3, 4",
    "coverage": "SELECT g.drug_name, g.rxcui, g.ndc, g.dosage, c.company, "
    + ", ".join(
        f"COALESCE({m}, 0) AS {m}"
        for m in (
            "total_drug_lists", "total_plans", "drug_lists_with_drug", "plans_with_drug",
            *[f"{n}_count" for n in ("tier3", "tier4", "tier5", "tier6", "pa", "st", "ql")],
        )
    )
    + f", {pct0('drug_lists_with_drug', 'total_drug_lists')} AS drug_list_pct, "
    f"{pct0('plans_with_drug', 'total_plans')} AS plan_pct, "
    + ", ".join(
        f"{pct0(f'{n}_count', 'plans_with_drug')} AS {n}_pct"
        for n in ("tier3", "tier4", "tier5", "tier6", "pa", "st", "ql")
    )
    + " FROM gdose g CROSS JOIN company c LEFT JOIN cov_total USING (company) "
    "LEFT JOIN cov v ON v.company = c.company AND v.ndc = g.ndc AND v.rxcui = g.rxcui "
    "AND v.drug_name = g.drug_name",
    "cprice": f"""
SELECT g.drug_name, g.rxcui, g.ndc, g.dosage, c.company,
       COALESCE(x.a, 0.0) AS avg_unit_cost, COALESCE(x.lo, 0.0) AS min_unit_cost,
       COALESCE(x.hi, 0.0) AS max_unit_cost, COALESCE(x.n, 0) AS plan_count
FROM gdose g CROSS JOIN company c LEFT JOIN (
  SELECT p.company, dp.ndc, {avg('dp.unit_cost')} AS a, {dbl('MIN(dp.unit_cost)')} AS lo,
         {dbl('MAX(dp.unit_cost)')} AS hi, COUNT(*) AS n
  FROM (SELECT DISTINCT contract_id, plan_key, parent_org, company FROM cp) p
  JOIN drug_pricing dp ON dp.plan_key = p.plan_key WHERE dp.days_supply = 30 GROUP BY 1, 2) x
ON x.company = c.company AND x.ndc = g.ndc""",
    "placed": """
SELECT DISTINCT cp.company, g.drug_name, g.rxcui, g.ndc, cp.plan_key, d.tier_level_value AS tier
FROM cp JOIN drug_list_drugs d ON d.drug_list_id = cp.drug_list_id
JOIN gndc g ON g.ndc = d.ndc AND g.rxcui = d.rxcui""",
    "amounts": """
SELECT x.company, x.drug_name, x.rxcui, x.ndc, b.cost_type_pref AS kind, b.cost_amt_pref AS amt,
       COUNT(DISTINCT x.plan_key) AS n
FROM placed x JOIN beneficiary_costs b ON b.plan_key = x.plan_key AND b.tier = x.tier
WHERE b.coverage_level = 1 AND b.days_supply = 1 GROUP BY ALL""",
}

ORG_COUNTS = (
    "COUNT(DISTINCT drug_list_id) AS drug_lists, "
    f"{rnd(avg('premium'), 2)} AS avg_premium, COUNT(DISTINCT state) AS states"
)
DRUG_ROWS = (
    f"SELECT rxcui, ndc, tier_level_value AS tier, {PA}, {ST}, {QL} FROM drug_list_drugs "
    f"WHERE drug_list_id = {FID}"
)
RESTRICTIONS = (
    f"COALESCE(NULLIF(concat_ws(', ', CASE WHEN {QL} = 'Y' THEN 'Qty Limit' END, "
    f"CASE WHEN {PA} = 'Y' THEN 'Prior Auth' END, CASE WHEN {ST} = 'Y' THEN 'Step Therapy' END), ''), 'None')"
)
GROUPS = (
    f"SELECT rxcui, ndc, tier_level_value AS tier, {QL}, {PA}, {ST}, "
    f"COUNT(DISTINCT ndc) AS ndc_count, {RESTRICTIONS} AS restrictions FROM drug_list_drugs "
    f"WHERE drug_list_id = {FID} AND tier_level_value IN (5, 6) GROUP BY ALL"
)
PLAN_LIST = f"""
SELECT p.contract_id, p.plan_id, c.contract_name, p.plan_name, {dbl('p.premium')} AS premium,
       {dbl('p.deductible')} AS deductible, p.snp_type, COUNT(DISTINCT pg.county_code) AS counties_covered
FROM plans p JOIN contracts c USING (contract_id) LEFT JOIN pg ON pg.plan_key = p.plan_key
WHERE p.drug_list_id = {FID}
GROUP BY p.plan_key, p.contract_id, p.plan_id, c.contract_name, p.plan_name, p.premium, p.deductible,
         p.snp_type"""
AREA_PLANS = (
    f"SELECT DISTINCT contract_id, plan_id, plan_name, {dbl('premium')} AS premium, "
    f"{dbl('deductible')} AS deductible, drug_list_id, snp AS snp_type FROM plan_information"
)
AREA_ORDER = (
    "ORDER BY premium NULLS LAST, deductible NULLS LAST, contract_id, plan_id, plan_name, "
    "drug_list_id NULLS LAST, snp_type"
)
COMPETITION = (
    "SELECT state_name, county_name, county_code, plan_count, "
    f"{rnd('avg_premium', 2)} AS avg_premium FROM county"
)
MEMBERS = ", ".join(f"'{n}'" for n in P.MEMBER_NDCS)
MEMBER_COST = f"""
SELECT plan_key, plan_name, {dbl('MAX(premium)')} AS monthly_premium, {dbl('MAX(deductible)')} AS annual_deductible,
       {dbl('ROUND(SUM(pays * 12), 2)')} AS annual_drug_costs,
       {dbl('ROUND(MAX(premium * 12) + MAX(deductible) + SUM(pays * 12), 2)')} AS total_annual_cost
FROM shared30 WHERE ruled AND ndc IN ({MEMBERS}) {{contract}} GROUP BY 1, 2"""
DISPLAY = f"""
SELECT tier, {names('kind', {0: 'Copay', 1: 'Coinsurance'}, "'No Charge'")} AS cost_type_label,
       CASE kind WHEN 0 THEN '$' || printf('%.2f', amt) WHEN 1 THEN printf('%.2f', amt) || '%'
         ELSE 'No Charge' END AS cost_display
FROM (SELECT tier, arg_min(cost_type_pref, days_supply) AS kind,
             {dbl('arg_min(cost_amt_pref, days_supply)')} AS amt
      FROM beneficiary_costs WHERE plan_key = (SELECT k FROM sample_key) AND coverage_level = 1
        {{tiers}} GROUP BY 1)"""
CONTRACT_COSTS = f"""
SELECT c.contract_name, p.contract_id, COUNT(DISTINCT p.plan_key) AS plan_count,
       {dbl('MIN(dp.unit_cost)')} AS min_cost, {rnd(avg('dp.unit_cost'), 2)} AS avg_cost,
       {dbl('MAX(dp.unit_cost)')} AS max_cost,
       {rnd(f"({dbl('MAX(dp.unit_cost)')} - {dbl('MIN(dp.unit_cost)')}) / NULLIF({dbl('MIN(dp.unit_cost)')}, 0) * 100", 1)} AS cost_variation_pct
FROM drug_pricing dp JOIN plans p USING (plan_key) JOIN contracts c USING (contract_id)
WHERE dp.ndc = {NDC} AND dp.days_supply = 30 GROUP BY 1, 2"""


def value_counts(table: str, column: str) -> str:
    return (
        f"SELECT {column} AS value, COUNT(*) AS count, "
        f"{pct('COUNT(*)', f'(SELECT COUNT(*) FROM {table})', 2)} AS pct FROM {table} GROUP BY 1"
    )


def describe(table: str, column: str) -> str:
    x = dbl(column)
    quartiles = ", ".join(
        f"{rnd(f'quantile_cont({x}, {q})', 6)} AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)
    )
    return (
        f"SELECT COUNT({column}) AS count, {avg(column)} AS mean, {rnd(f'stddev_samp({x})', 6)} AS std, "
        f"MIN({x}) AS min, {quartiles}, MAX({x}) AS max FROM {table}"
    )


def report(*tables: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, "
        + (f"COUNT(*) AS rows FROM {name}" if rows is None else f"CAST({rows} AS BIGINT) AS rows")
        for name, rows in (t if isinstance(t, tuple) else (t, None) for t in tables)
    )


ALL_TABLES = tuple(PRELUDE)
PIVOT = "SELECT drug_name, rxcui, ndc, dosage, " + ", ".join(
    f"COALESCE(MAX({m}) FILTER (WHERE company = '{c}'), 0) AS \"{c}_{m}\""
    for c in COMPANIES for m in ("avg_unit_cost", "min_unit_cost", "max_unit_cost", "plan_count")
) + " FROM cprice GROUP BY 1, 2, 3, 4"
AREA = f"WHERE state = '{P.STATE}'"

BODIES: dict[str, str] = {
    # sources and sinks
    "read_pipe": f"SELECT {PLAN_ROW} FROM plan_information",
    "read_pipe_latin1": "SELECT DISTINCT plan_key, plan_name || ' é' AS plan_name FROM plan_information",
    "unzip_pipe": "SELECT ndc, tier_level_value, drug_list_id FROM drug_list_drugs",
    "clean_columns": "SELECT drug_list_id, ndc, tier_level_value FROM drug_list_drugs",
    "rename_positional": "SELECT * FROM geographic_locator",
    "coerce": f"SELECT plan_key, county_code, CASE WHEN snp <> 4 THEN {dbl('premium')} END AS premium, "
    "snp FROM plan_information",
    "with_plan_key": "SELECT DISTINCT contract_id, plan_id, CASE WHEN snp <> 0 THEN segment_id END AS segment_id, "
    "CASE WHEN snp <> 0 THEN contract_id || '|' || plan_id || '|' || segment_id END AS plan_key "
    "FROM plan_information",
    "null_tokens": "SELECT plan_key, CASE WHEN snp NOT IN (1, 2) THEN state END AS state FROM plan_information",
    "write_table": f"SELECT {DRUG_ROW} FROM drug_list_drugs",
    "write_pricing": f"SELECT plan_key, ndc, days_supply, {dbl('unit_cost')} AS unit_cost, "
    f"{NULL_TEXT} AS contract_id, {NULL_TEXT} AS plan_id FROM drug_pricing",
    "append_pricing": f"SELECT plan_key, ndc, days_supply, {dbl('unit_cost')} AS unit_cost, "
    "split_part(plan_key, '|', 1) AS contract_id, split_part(plan_key, '|', 2) AS plan_id FROM drug_pricing",
    "ingest_report": report(*ALL_TABLES),
    "load_tables": "SELECT * FROM drug_list_drugs",
    "load_tables_costs": f"SELECT plan_key, coverage_level, tier, days_supply, cost_type_pref, "
    f"{dbl('cost_amt_pref')} AS cost_amt_pref, {dbl('cost_max_amt_pref')} AS cost_max_amt_pref, "
    "tier_specialty_yn FROM beneficiary_costs",
    "snapshot": "SELECT plan_key, county_code, drug_list_id, CAST(NULL AS DOUBLE) AS premium FROM plan_information",
    "read_drug_names": "SELECT * FROM drug_names",
    "export_csv": GROUPS,
    "to_records": """
SELECT '{"plan_key":"' || plan_key || '","county_code":"' || county_code || '","drug_list_id":"'
  || COALESCE(drug_list_id, 'none') || '","snp":' || snp || '}' AS record FROM plan_information""",
    # normalization
    "contracts": "SELECT contract_id, contract_name, substr(contract_id, 1, 1) AS contract_type FROM contracts",
    "drug_lists": f"SELECT DISTINCT drug_list_id, {NULL_TEXT} AS drug_list_version, 2025 AS contract_year "
    "FROM plan_information WHERE drug_list_id IS NOT NULL",
    "plans": f"SELECT plan_key, contract_id, plan_id, segment_id, plan_name, drug_list_id, "
    f"{dbl('premium')} AS premium, {dbl('deductible')} AS deductible, snp_type, "
    f"{NULL_TEXT} AS plan_suppressed_yn FROM plans",
    "plan_geography": f"SELECT *, {NULL_TEXT} AS ma_region_code, {NULL_TEXT} AS pdp_region_code FROM pg",
    "duplicate_keys": "SELECT plan_key, county_code, COUNT(*) AS count FROM pg GROUP BY 1, 2 HAVING COUNT(*) > 1",
    "orphans": f"""
SELECT plan_key, contract_id, plan_id, segment_id, plan_name, drug_list_id, {dbl('premium')} AS premium,
       {dbl('deductible')} AS deductible, snp_type, {NULL_TEXT} AS plan_suppressed_yn
FROM plans p WHERE NOT EXISTS (SELECT 1 FROM plan_enrollment e
  WHERE e.contract_number = p.contract_id AND e.plan_id = p.plan_id)""",
    "declared_keys": """
SELECT 'geographic_locator' AS table_name, COUNT(*) AS repeated
FROM (SELECT county_code FROM geographic_locator GROUP BY ALL HAVING COUNT(*) > 1)
UNION ALL SELECT 'drug_pricing', COUNT(*)
FROM (SELECT plan_key, ndc, days_supply FROM drug_pricing GROUP BY ALL HAVING COUNT(*) > 1)
UNION ALL SELECT 'beneficiary_costs', COUNT(*) FROM (
  SELECT plan_key, coverage_level, tier, days_supply FROM beneficiary_costs GROUP BY ALL HAVING COUNT(*) > 1)""",
    "declared_references": " UNION ALL ".join(
        f"SELECT '{child}.{c}' AS reference, COUNT(*) AS orphans FROM {child} "
        f"WHERE {c} NOT IN (SELECT {p} FROM {parent} WHERE {p} IS NOT NULL)"
        for child, c, parent, p in (
            ("plan_information", "county_code", "geographic_locator", "county_code"),
            ("plan_information", "drug_list_id", "drug_list_drugs", "drug_list_id"),
            ("plan_enrollment", "contract_number", "plan_information", "contract_id"),
            ("beneficiary_costs", "plan_key", "plan_information", "plan_key"),
            ("drug_pricing", "plan_key", "plan_information", "plan_key"),
            ("drug_pricing", "ndc", "drug_list_drugs", "ndc"),
            ("drug_list_drugs", "rxcui", "drug_names", "rxcui"),
        )
    ),
    # summaries
    "drug_list_summary": f"SELECT drug_list_id, {NULL_TEXT} AS drug_list_version, total_drugs, "
    "specialty_drugs, plans_using FROM fsum",
    "county_plan_summary": f"SELECT county_code, state_name, county_name, plan_count, avg_premium, "
    f"{dbl('min_premium')} AS min_premium, {dbl('max_premium')} AS max_premium FROM county",
    # drug lists
    "drug_list_list": "SELECT drug_list_id, COUNT(DISTINCT contract_name) AS org_count, "
    "MAX(contract_name) AS parent_org, COUNT(*) AS plan_count, COUNT(DISTINCT state) AS state_count "
    "FROM plan_information WHERE drug_list_id IS NOT NULL GROUP BY 1",
    "drug_list_list_of_org": "SELECT drug_list_id, COUNT(DISTINCT contract_name) AS org_count, "
    "MAX(contract_name) AS parent_org, COUNT(*) AS plan_count, COUNT(DISTINCT state) AS state_count "
    "FROM plan_information WHERE drug_list_id IS NOT NULL AND contract_name LIKE '%NATION_1%' GROUP BY 1",
    "drug_list_orgs": "SELECT drug_list_id, COUNT(DISTINCT contract_name) AS org_count, "
    "string_agg(DISTINCT contract_name, ', ' ORDER BY contract_name) AS organizations, "
    "COUNT(*) AS plan_count FROM plan_information WHERE drug_list_id IS NOT NULL GROUP BY 1",
    "org_prefixes": "SELECT DISTINCT contract_name AS org, contract_name AS shown FROM plan_information "
    "WHERE contract_name IS NOT NULL",
    "drug_lists_of_org": f"SELECT DISTINCT drug_list_id FROM plan_information "
    f"WHERE contract_name = '{P.ORG_NAME}'",
    "drug_list_parent": "SELECT contract_id, parent_org, COUNT(DISTINCT contract_name) AS entity_count "
    "FROM parent GROUP BY contract_id, parent_org, contract_name "
    "ORDER BY COUNT(*) DESC, contract_id, parent_org LIMIT 1",
    "tier_drug_counts": "SELECT tier_level_value AS tier, COUNT(DISTINCT rxcui) AS drug_count "
    f"FROM drug_list_drugs WHERE drug_list_id = {FID} GROUP BY 1",
    "restriction_counts": f"SELECT {rows_if(PA + " = 'Y'")} AS prior_auth_count, "
    f"{rows_if(ST + " = 'Y'")} AS step_therapy_count, {rows_if(QL + " = 'Y'")} AS quantity_limit_count, "
    f"COUNT(DISTINCT rxcui) AS total_drugs FROM drug_list_drugs WHERE drug_list_id = {FID}",
    "drug_list_geography": "SELECT COUNT(DISTINCT plan_id) AS plan_count, COUNT(DISTINCT state) AS state_count, "
    f"COUNT(DISTINCT county_code) AS county_count FROM plan_information WHERE drug_list_id = {FID}",
    "cost_sample": f"SELECT bc.tier, bc.cost_type_pref AS retail_cost_type, "
    f"{dbl('bc.cost_amt_pref')} AS retail_cost_amt, CAST(NULL AS INTEGER) AS mail_cost_type, "
    "CAST(NULL AS DOUBLE) AS mail_cost_amt, bc.tier_specialty_yn FROM beneficiary_costs bc "
    f"JOIN plan_information p ON p.plan_key = bc.plan_key WHERE p.drug_list_id = {FID} "
    "AND bc.coverage_level = 1 ORDER BY bc.plan_key, bc.tier, bc.days_supply",
    "specialty_counts": f"SELECT COUNT(DISTINCT rxcui) AS specialty_drug_count, "
    f"{rows_if(PA + " = 'Y'")} AS specialty_pa_count FROM drug_list_drugs "
    f"WHERE drug_list_id = {FID} AND tier_level_value IN (5, 6)",
    "tier_share": f"""
SELECT tier, {names('tier', TIERS_PAGE, "'Tier ' || tier")} AS tier_name, drug_count,
       {pct0('drug_count', '(SUM(drug_count) OVER ())')} AS pct_of_drug_list
FROM (SELECT tier_level_value AS tier, COUNT(DISTINCT rxcui) AS drug_count FROM drug_list_drugs
      WHERE drug_list_id = {FID} GROUP BY 1)""",
    "restriction_share": " UNION ALL ".join(
        f"SELECT '{text}' AS restriction, COUNT(*) FILTER (WHERE {c} = 'Y') AS drug_count, "
        f"{pct0(f"COUNT(*) FILTER (WHERE {c} = 'Y')", 'COUNT(DISTINCT rxcui)')} AS pct_of_drugs "
        f"FROM drug_list_drugs WHERE drug_list_id = {FID}"
        for c, text in ((PA, "Prior Authorization"), (ST, "Step Therapy"), (QL, "Quantity Limits"))
    ),
    "specialty_pa_share": f"SELECT COUNT(DISTINCT rxcui) AS specialty_drug_count, "
    f"{rows_if(PA + " = 'Y'")} AS specialty_pa_count, "
    f"{pct0(f"COUNT(*) FILTER (WHERE {PA} = 'Y')", 'COUNT(DISTINCT rxcui)')} AS pa_pct "
    f"FROM drug_list_drugs WHERE drug_list_id = {FID} AND tier_level_value IN (5, 6)",
    "drug_list_drugs_list": f"{DRUG_ROWS} ORDER BY tier, rxcui, ndc",
    "drug_list_drugs_list_specialty": f"{DRUG_ROWS} AND tier_level_value IN (5, 6) "
    "ORDER BY tier, rxcui, ndc",
    "drug_list_drugs_list_tier": f"{DRUG_ROWS} AND tier_level_value = {P.TIER} "
    "ORDER BY tier, rxcui, ndc",
    "drug_list_states": f"SELECT state, COUNT(DISTINCT plan_id) AS plan_count, {avg('premium')} AS avg_premium, "
    f"{avg('deductible')} AS avg_deductible FROM plan_information WHERE drug_list_id = {FID} GROUP BY 1",
    "drug_list_overview": f"SELECT {FID} AS drug_list_id, COUNT(DISTINCT p.plan_key) AS plans_using, "
    "COUNT(DISTINCT d.ndc) AS total_drugs, "
    "COUNT(DISTINCT d.ndc) FILTER (WHERE d.tier_level_value = 5) AS specialty_drugs, "
    "COUNT(DISTINCT p.state) AS states_covered FROM plan_information p "
    f"LEFT JOIN drug_list_drugs d ON d.drug_list_id = p.drug_list_id WHERE p.drug_list_id = {FID}",
    "drug_list_plans": PLAN_LIST,
    "drug_list_plans_first": f"{PLAN_LIST} ORDER BY p.premium NULLS LAST, p.deductible NULLS LAST, "
    "p.plan_key",
    "drug_list_plan_rows": f"SELECT contract_name AS parent_organization, contract_id, plan_id, plan_name, "
    f"{dbl('premium')} AS premium, {dbl('deductible')} AS deductible, state, snp AS snp_type "
    f"FROM plan_information WHERE drug_list_id = {FID}",
    "drug_list_plan_metrics": f"SELECT COUNT(*) AS plan_count, {avg('premium')} AS avg_premium, "
    f"{avg('deductible')} AS avg_deductible, COUNT(DISTINCT state) AS state_count "
    f"FROM plan_information WHERE drug_list_id = {FID}",
    "drug_list_parent_orgs": f"SELECT contract_name, COUNT(*) AS plan_count FROM plan_information "
    f"WHERE drug_list_id = {FID} GROUP BY 1 ORDER BY 2 DESC, 1",
    "tier_summary": f"SELECT tier_level_value AS tier, "
    f"{names('tier_level_value', TIERS, "'Other'")} AS tier_name, COUNT(*) AS drug_count, "
    f"{rows_if(PA + " = 'Y'")} AS with_prior_auth, {rows_if(QL + " = 'Y'")} AS with_qty_limits, "
    f"{rows_if(ST + " = 'Y'")} AS with_step_therapy FROM drug_list_drugs "
    f"WHERE drug_list_id = {FID} GROUP BY 1",
    "drug_list_drug_details": f"SELECT ndc, rxcui, tier_level_value AS tier, {QL}, quantity_limit_amount, "
    f"quantity_limit_days, {PA}, {ST}, COUNT(*) AS drug_list_count, "
    f"{names('tier_level_value', TIERS_SHORT, "'Other'")} AS tier_description "
    f"FROM drug_list_drugs WHERE drug_list_id = {FID} GROUP BY ALL",
    "specialty_drugs": f"SELECT ndc, rxcui, tier_level_value AS tier, {QL}, quantity_limit_amount, {PA}, {ST} "
    f"FROM drug_list_drugs WHERE drug_list_id = {FID} AND tier_level_value = 5",
    "specialty_drugs_first": f"SELECT ndc, rxcui, tier_level_value AS tier, {QL}, quantity_limit_amount, {PA}, {ST} "
    f"FROM drug_list_drugs WHERE drug_list_id = {FID} AND tier_level_value = 5 ORDER BY ndc LIMIT 25",
    "specialty_drug_groups": GROUPS,
    "specialty_drug_metrics": f"SELECT COUNT(*) AS specialty_drugs, "
    f"COUNT(*) FILTER (WHERE {PA} = 'Y') AS requiring_prior_auth FROM ({GROUPS})",
    "with_restriction_codes": f"SELECT drug_list_id, ndc, COALESCE(NULLIF(concat_ws(' ', "
    f"CASE WHEN {PA} = 'Y' THEN 'PA' END, CASE WHEN {ST} = 'Y' THEN 'ST' END, "
    f"CASE WHEN {QL} = 'Y' THEN 'QL' END), ''), '-') AS restrictions FROM drug_list_drugs",
    "drug_list_sizes": "SELECT drug_list_id, COUNT(DISTINCT ndc) AS total_drugs, "
    "COUNT(DISTINCT ndc) FILTER (WHERE tier_level_value = 5) AS specialty_drugs, "
    f"{pct('COUNT(DISTINCT ndc) FILTER (WHERE tier_level_value = 5)', 'COUNT(DISTINCT ndc)')} AS pct_specialty "
    "FROM drug_list_drugs GROUP BY 1 ORDER BY 2 DESC, 1",
    "restrictiveness": "SELECT d.drug_list_id, COUNT(DISTINCT d.ndc) AS total_drugs, "
    "COUNT(DISTINCT d.ndc) FILTER (WHERE d.tier_level_value = 5) AS specialty_drugs, "
    + ", ".join(
        f"{pct(f'COUNT(DISTINCT d.ndc) FILTER (WHERE d.{cond})', 'COUNT(DISTINCT d.ndc)')} AS {name}"
        for name, cond in (
            ("pct_with_pa", f"{PA} <> 'N'"), ("pct_with_step_therapy", f"{ST} = 'Y'"),
            ("pct_with_qty_limits", f"{QL} = 'Y'"),
        )
    )
    + " FROM (SELECT DISTINCT drug_list_id FROM plan_information) f "
    "JOIN drug_list_drugs d ON d.drug_list_id = f.drug_list_id GROUP BY 1",
    "restrictiveness_rows": f"SELECT drug_list_id, COUNT(*) AS total_drugs, "
    f"{rows_if(PA + " <> 'N'")} AS drugs_with_pa, "
    f"{pct(f"COUNT(*) FILTER (WHERE {PA} <> 'N')", 'COUNT(*)')} AS pct_with_pa FROM drug_list_drugs GROUP BY 1",
    "drug_list_drugs_sample_plan": f"""
SELECT d.ndc, d.rxcui, d.tier_level_value AS tier, d.{QL}, d.{PA}, d.{ST}, {dbl('u.unit_cost')} AS unit_cost,
       r.kind AS cost_type_pref, {dbl('r.amt')} AS cost_amt_pref, {dbl('r.cap')} AS cost_max_amt_pref
FROM (SELECT * FROM drug_list_drugs, sample_key WHERE k IS NOT NULL AND drug_list_id = {FID}) d
LEFT JOIN (SELECT * FROM drug_pricing WHERE days_supply = 30) u ON (u.plan_key, u.ndc) = (d.k, d.ndc)
LEFT JOIN rules1 r ON (r.plan_key, r.tier) = (d.k, d.tier_level_value)""",
    # organizations
    "organizations": "SELECT contract_name AS organization, COUNT(DISTINCT drug_list_id) AS drug_list_count, "
    "COUNT(*) AS plan_count FROM plan_information WHERE contract_name IS NOT NULL GROUP BY 1",
    "contract_list": "SELECT p.contract_id, COALESCE(o.parent_organization, MAX(p.contract_name)) AS parent_organization, "
    "COALESCE(o.organization_marketing_name, MAX(p.contract_name)) AS marketing_name, o.enrollment, "
    "COUNT(DISTINCT p.drug_list_id) AS drug_list_count, COUNT(DISTINCT p.plan_id) AS plan_count, "
    "COUNT(DISTINCT p.state) AS state_count FROM plan_information p "
    "LEFT JOIN contract_organizations o ON o.contract_number = p.contract_id WHERE p.contract_id IS NOT NULL "
    "GROUP BY p.contract_id, o.parent_organization, o.organization_marketing_name, o.enrollment",
    "orgs_by_enrollment": "SELECT * FROM orgs",
    "organization_plans": "SELECT * FROM org_plans",
    "contract_drug_lists": "SELECT * FROM contract_f",
    "org_totals": f"SELECT COUNT(*) AS organizations, {big('SUM(total_enrollment)')} AS total_enrollment, "
    f"{big('SUM(plan_count)')} AS total_plans, {big('SUM(contract_count)')} AS total_contracts FROM orgs",
    "search_orgs": f"SELECT * FROM orgs WHERE parent_organization ILIKE '%{P.SEARCH}%' "
    f"OR organization_marketing_name ILIKE '%{P.SEARCH}%'",
    "organization_totals": f"SELECT {big('SUM(enrollment)')} AS total_enrollment, COUNT(*) AS total_plans, "
    "COUNT(DISTINCT contract_number) AS total_contracts, COUNT(DISTINCT drug_list_id) AS total_drug_lists "
    "FROM org_plans",
    "contract_totals": f"SELECT {big('SUM(plan_count)')} AS total_plans, MAX(state_count) AS total_states, "
    "MAX(county_count) AS total_counties FROM contract_f",
    "global_stats": "SELECT COUNT(DISTINCT drug_list_id) AS total_drug_lists, COUNT(DISTINCT plan_id) AS total_plans, "
    "COUNT(DISTINCT contract_name) AS total_organizations, "
    "(SELECT COUNT(DISTINCT rxcui) FROM drug_list_drugs) AS total_drugs FROM plan_information",
    "top_contracts": f"SELECT contract_id, contract_name, COUNT(DISTINCT plan_key) AS plans, {ORG_COUNTS} "
    "FROM plan_information GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2",
    "top_contracts_in_area": f"SELECT contract_id, contract_name, COUNT(DISTINCT plan_key) AS plans, {ORG_COUNTS} "
    f"FROM plan_information {AREA} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2",
    "contract_comparison": f"SELECT contract_id, MIN(contract_name) AS contract_name, "
    f"COUNT(DISTINCT plan_id) AS plans, {ORG_COUNTS} FROM plan_information GROUP BY 1 ORDER BY 3 DESC, 1",
    "contract_types": "SELECT substr(contract_id, 1, 1) AS contract_type, COUNT(DISTINCT contract_id) AS contracts "
    "FROM plan_information GROUP BY 1",
    "contract_offerings": "SELECT contract_id, COUNT(*) AS plan_count FROM plan_information GROUP BY 1 "
    "ORDER BY 2 DESC, 1",
    # geography
    "plans_in_area_county": f"SELECT {PLAN_ROW} FROM plan_information WHERE county_code = {CNTY}",
    "plans_in_area_state": f"SELECT {PLAN_ROW} FROM plan_information {AREA}",
    "county_name": f"SELECT state_name, county_name FROM geographic_locator WHERE county_code = {CNTY}",
    "area_plan_count": f"SELECT COUNT(DISTINCT plan_key) AS plans FROM plan_information {AREA}",
    "area_plans": f"{AREA_PLANS} WHERE county_code = {CNTY} {AREA_ORDER}",
    "area_plans_first": f"{AREA_PLANS} {AREA} {AREA_ORDER} LIMIT 10",
    "area_premium_stats": f"SELECT COUNT(DISTINCT plan_key) AS total_plans, {rnd(avg('premium'), 2)} AS avg_premium, "
    f"{dbl('MIN(premium)')} AS min_premium, {dbl('MAX(premium)')} AS max_premium, "
    f"{rnd(avg('deductible'), 2)} AS avg_deductible "
    f"FROM (SELECT DISTINCT plan_key, premium, deductible FROM plan_information {AREA})",
    "area_drug_lists": "SELECT p.drug_list_id, COUNT(DISTINCT p.plan_key) AS plans_in_area, "
    "COUNT(DISTINCT d.ndc) AS total_drugs, "
    "COUNT(DISTINCT d.ndc) FILTER (WHERE d.tier_level_value = 5) AS specialty_drugs FROM plan_information p "
    f"LEFT JOIN drug_list_drugs d ON d.drug_list_id = p.drug_list_id WHERE p.state = '{P.STATE}' GROUP BY 1 "
    "ORDER BY 2 DESC, 1 NULLS LAST",
    "area_snp": f"SELECT {names('snp', PLAN_TYPES, "'Other'")} AS plan_type, "
    f"COUNT(DISTINCT plan_key) AS plan_count FROM plan_information {AREA} GROUP BY snp",
    "county_plans": f"SELECT p.contract_id, c.contract_name, p.plan_id, p.plan_name, {dbl('p.premium')} AS premium, "
    f"{dbl('p.deductible')} AS deductible, p.snp_type, p.drug_list_id, fs.specialty_drugs FROM pg "
    "JOIN plans p USING (plan_key) JOIN contracts c USING (contract_id) "
    f"LEFT JOIN fs ON fs.drug_list_id = p.drug_list_id WHERE pg.county_code = {CNTY}",
    "county_summary": f"SELECT county_code, state_name, county_name, plan_count, {rnd('avg_premium', 2)} AS avg_premium, "
    f"{dbl('min_premium')} AS min_premium, {dbl('max_premium')} AS max_premium FROM county "
    f"WHERE county_code = {CNTY}",
    "county_competition": f"{COMPETITION} WHERE state_name = '{P.STATE_NAME}' "
    "ORDER BY plan_count DESC, county_code",
    "county_competition_all": f"{COMPETITION} ORDER BY plan_count DESC, county_code",
    # drugs
    "drug_overview": "SELECT ndc, rxcui, COUNT(DISTINCT drug_list_id) AS drug_lists_covering, "
    f"COUNT(*) AS total_entries FROM drug_list_drugs WHERE ndc = {NDC} GROUP BY 1, 2",
    "drug_tiers": f"SELECT tier_level_value AS tier, {names('tier_level_value', TIERS_SHORT, "'Other'")} AS tier_name, "
    "COUNT(DISTINCT drug_list_id) AS drug_lists, COUNT(*) AS entries FROM drug_list_drugs "
    f"WHERE ndc = {NDC} GROUP BY 1",
    "drug_restrictions": f"SELECT {rows_if(PA + " = 'Y'")} AS with_prior_auth, {rows_if(QL + " = 'Y'")} AS with_qty_limits, "
    f"{rows_if(ST + " = 'Y'")} AS with_step_therapy, COUNT(*) AS total_entries FROM drug_list_drugs WHERE ndc = {NDC}",
    "drug_plans": f"SELECT DISTINCT p.contract_id, p.plan_id, p.plan_name, d.tier_level_value AS tier, d.drug_list_id, "
    f"{dbl('p.premium')} AS premium, d.{PA} AS pa, d.{QL} AS qty_limit FROM drug_list_drugs d "
    f"JOIN plan_information p ON p.drug_list_id = d.drug_list_id WHERE d.ndc = {NDC} "
    "ORDER BY premium NULLS LAST, contract_id, plan_id",
    "drug_cost_samples": """
SELECT contract_id, plan_id, tier, CASE kind WHEN 0 THEN printf('$%.2f copay', amt::DOUBLE)
    WHEN 1 THEN printf('%.0f%% coinsurance', amt::DOUBLE * 100) || COALESCE(printf(' (max $%.2f)', cap::DOUBLE), '')
    ELSE 'No charge' END AS cost_text
FROM (SELECT DISTINCT p.plan_key, p.contract_id, p.plan_id, d.tier_level_value AS tier
      FROM plan_information p JOIN drug_list_drugs d USING (drug_list_id) WHERE d.ndc = """ + NDC + """
      ORDER BY plan_key, tier) JOIN rules1 USING (plan_key, tier)""",
    "specialty_coverage_rows": "SELECT ndc, rxcui, COUNT(DISTINCT drug_list_id) AS drug_list_count, "
    f"{rows_if(PA + " = 'Y'")} AS pa_required_count FROM drug_list_drugs WHERE tier_level_value = 5 "
    "GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2",
    "specialty_coverage": "SELECT ndc, COUNT(DISTINCT drug_list_id) AS drug_list_count, "
    f"COUNT(DISTINCT drug_list_id) FILTER (WHERE {PA} = 'Y') AS pa_required_count, "
    f"COUNT(DISTINCT drug_list_id) FILTER (WHERE {QL} = 'Y') AS qty_limit_count FROM drug_list_drugs "
    "WHERE tier_level_value = 5 GROUP BY 1 ORDER BY 2 DESC, 1",
    "drug_dosages": "SELECT * FROM dosage",
    "group_ndcs": "SELECT * FROM gndc",
    "priority_sort": "SELECT rxcui, ndc, negotiated_cost FROM tier_page ORDER BY "
    f"CASE WHEN rxcui IN ({', '.join(map(str, P.PRIORITY))}) THEN 0 ELSE 1 END, negotiated_cost DESC, ndc, rxcui",
    "with_drug_name": "SELECT d.rxcui, d.ndc, COALESCE(n.description, 'RxCUI ' || d.rxcui) AS drug_name "
    "FROM (SELECT DISTINCT rxcui, ndc FROM drug_list_drugs) d LEFT JOIN drug_names n ON n.rxcui = d.rxcui",
    # costs
    "county_drug_costs": f"""
SELECT s.ndc, s.contract_id, s.plan_id, (SELECT c.contract_name FROM contracts c WHERE c.contract_id = s.contract_id)
         AS contract_name, {dbl('s.premium')} AS premium, {dbl('s.deductible')} AS deductible,
       {dbl('ROUND(s.unit, 2)')} AS negotiated_cost, s.kind AS cost_type_pref,
       {dbl('ROUND(s.amt, 2)')} AS member_cost_amt, {dbl('ROUND(s.cap, 2)')} AS member_cost_max,
       {dbl('s.unit - CASE s.kind WHEN 0 THEN COALESCE(s.amt, 0) WHEN 1 THEN s.unit * s.amt ELSE 0 END')}
         AS plan_net_cost
FROM shared30 s JOIN pg ON pg.plan_key = s.plan_key AND pg.county_code = {CNTY}
WHERE s.tier = 5 AND s.ndc = {NDC}""",
    "county_drug_costs_basic": f"""
SELECT p.contract_id, p.plan_name, {dbl('dp.unit_cost')} AS negotiated_cost,
       {dbl('bc.cost_amt_pref')} AS member_copay, {dbl('dp.unit_cost - bc.cost_amt_pref')} AS plan_net_cost
FROM drug_pricing dp JOIN plans p USING (plan_key) JOIN pg ON pg.plan_key = p.plan_key
JOIN beneficiary_costs bc ON bc.plan_key = p.plan_key
WHERE pg.county_code = {CNTY} AND dp.ndc = {NDC} AND dp.days_supply = 30""",
    "specialty_costs": f"SELECT contract_id, plan_key, ndc, {dbl('unit')} AS negotiated_cost, "
    f"{dbl('pays')} AS member_pays, {dbl('unit - pays')} AS plan_net_cost FROM shared30 WHERE tier = 5 AND ruled",
    "specialty_margin": f"SELECT contract_id, COUNT(DISTINCT ndc) AS specialty_drugs_priced, "
    f"{rnd(avg('unit'), 2)} AS avg_negotiated_cost, {rnd(avg('pays'), 2)} AS avg_member_pays, "
    f"{rnd(avg('unit - pays'), 2)} AS avg_plan_net_cost FROM shared30 WHERE tier = 5 AND ruled GROUP BY 1",
    "tier_drugs_priced": "SELECT * FROM tier_page",
    "county_specialty_costs": f"""
SELECT s.ndc, s.contract_id, s.plan_id, {dbl('s.premium')} AS premium, {dbl('s.deductible')} AS deductible,
       {dbl('s.unit')} AS negotiated_cost, {dbl('s.amt')} AS member_cost,
       {dbl('s.unit - COALESCE(s.amt * s.unit, 0)')} AS plan_net_cost
FROM shared30 s JOIN pg ON pg.plan_key = s.plan_key AND pg.county_code = {CNTY}
WHERE s.tier = 5 AND s.ruled""",
    "tier_page_summary": f"""
SELECT COUNT(*) AS total_drugs, {rnd('SUM(negotiated_cost) / COUNT(*)', 2)} AS avg_negotiated,
       {rnd('SUM(member_pays) / COUNT(*)', 2)} AS avg_member_pays,
       CASE MIN(cost_type) WHEN 'COPAY' THEN printf('$%.2f copay', MIN(cost_amt))
         WHEN 'COINSURANCE' THEN regexp_replace(CAST(MIN(cost_amt) AS VARCHAR), '\\.0$', '') || '% coinsurance'
         ELSE 'N/A' END AS cost_structure
FROM tier_page""",
    "contract_drug_costs": CONTRACT_COSTS,
    "contract_specialty_cost": f"SELECT contract_id, {avg('unit')} AS avg_cost FROM own30 WHERE tier = 5 GROUP BY 1",
    "member_annual_cost": MEMBER_COST.format(contract=""),
    "member_annual_cost_of_contract": MEMBER_COST.format(contract=f"AND contract_id = '{P.CONTRACT}'"),
    "plan_cost_structure": f"SELECT tier, {names('kind', {0: 'Copay', 1: 'Coinsurance'}, "'No Charge'")} AS cost_type, "
    f"{dbl('amt')} AS amount, {dbl('cap')} AS max_cap, spec AS specialty_flag "
    "FROM rules1 WHERE plan_key = (SELECT k FROM sample_key)",
    "plan_cost_display": DISPLAY.format(tiers="AND tier IN (5, 6)"),
    "plan_cost_display_all": DISPLAY.format(tiers=""),
    "specialty_pricing": f"""
SELECT d.rxcui, d.ndc, d.tier, d.restrictions, {avg('dp.unit_cost')} AS avg_unit_cost,
       {dbl('MIN(dp.unit_cost)')} AS min_unit_cost, {dbl('MAX(dp.unit_cost)')} AS max_unit_cost,
       COUNT(DISTINCT dp.plan_key) AS plan_count
FROM ({GROUPS}) d JOIN drug_pricing dp ON dp.ndc = d.ndc
WHERE dp.plan_key IN (SELECT plan_key FROM plan_information WHERE drug_list_id = {FID})
GROUP BY 1, 2, 3, 4 ORDER BY avg_unit_cost DESC, d.ndc, d.rxcui, d.tier""",
    "format_money": "SELECT contract_id, printf('$%.2f', min_cost) AS min_cost, "
    f"printf('$%.2f', max_cost) AS max_cost FROM ({CONTRACT_COSTS})",
    # drug classes
    "company_plans": "SELECT * FROM cp",
    "coverage_table": "SELECT * FROM coverage",
    "pricing_table": "SELECT * FROM cprice",
    "member_cost_table": "SELECT g.drug_name, g.rxcui, g.ndc, g.dosage, c.company, "
    + ", ".join(
        f"{big(f'COALESCE(x.{k}_plans, 0)')} AS {k}_plans, "
        f"COALESCE(round_even(x.{k}_plans * 100.0 / NULLIF(t.total, 0), 1), 0.0) AS {k}_pct"
        for k in ("copay", "coinsurance", "no_charge")
    )
    + ", COALESCE(round_even(x.mean_copay, 2), 0.0) AS avg_copay, "
    "COALESCE(round_even(x.mean_coinsurance, 1), 0.0) AS avg_coinsurance "
    "FROM gdose g CROSS JOIN company c LEFT JOIN (SELECT company, drug_name, rxcui, ndc, "
    + ", ".join(
        f"{dbl(f'SUM(n) FILTER (WHERE kind = {i})')} AS {k}_plans"
        for i, k in enumerate(("copay", "coinsurance", "no_charge"))
    )
    + f", {avg('CASE WHEN kind = 0 THEN amt END')} AS mean_copay, "
    f"{avg('CASE WHEN kind = 1 THEN amt END')} AS mean_coinsurance FROM amounts GROUP BY ALL) x "
    "ON x.company = c.company AND x.ndc = g.ndc AND x.rxcui = g.rxcui AND x.drug_name = g.drug_name "
    "LEFT JOIN (SELECT cp.company, d.rxcui, COUNT(DISTINCT cp.plan_key) AS total FROM cp "
    "JOIN drug_list_drugs d ON d.drug_list_id = cp.drug_list_id GROUP BY 1, 2) t "
    "ON t.company = c.company AND t.rxcui = g.rxcui",
    "company_totals": "SELECT contract_name, COUNT(DISTINCT drug_list_id) AS total_drug_lists, "
    "COUNT(DISTINCT plan_id) AS total_plans FROM plan_information WHERE "
    "regexp_matches(UPPER(contract_name), 'NATION_1|AETNA') GROUP BY 1",
    "fill_companies": "SELECT s.state, c.company, COALESCE(x.plans, 0) AS plans "
    "FROM (SELECT DISTINCT p.state FROM cp JOIN plan_information p ON p.plan_key = cp.plan_key "
    ") s CROSS JOIN company c "
    "LEFT JOIN (SELECT p.state, cp.company, COUNT(DISTINCT cp.plan_key) AS plans FROM cp "
    "JOIN plan_information p ON p.plan_key = cp.plan_key GROUP BY 1, 2) x "
    "ON x.state = s.state AND x.company = c.company",
    "pivot_companies": PIVOT,
    "nest_companies": "SELECT * FROM coverage",
    # profiling
    "plan_profile": "SELECT COUNT(*) AS records, COUNT(DISTINCT contract_id) AS contracts, "
    "COUNT(DISTINCT contract_id || '/' || plan_id) AS plans, COUNT(DISTINCT drug_list_id) AS drug_lists "
    "FROM plan_information",
    "plan_sample": f"SELECT contract_id, plan_id, contract_name, {dbl('premium')} AS premium, "
    f"{dbl('deductible')} AS deductible, drug_list_id FROM plan_information ORDER BY plan_key, county_code LIMIT 5",
    "describe_premium": describe("plan_information", "premium"),
    "describe_deductible": describe("plan_information", "deductible"),
    "describe_unit_cost": describe("drug_pricing", "unit_cost"),
    "value_counts_tier": value_counts("drug_list_drugs", "tier_level_value"),
    "value_counts_prior_auth": value_counts("drug_list_drugs", PA),
    "value_counts_quantity_limit": value_counts("drug_list_drugs", QL),
    "value_counts_cost_type": value_counts("beneficiary_costs", "cost_type_pref"),
    "value_counts_specialty": value_counts("beneficiary_costs", "tier_specialty_yn"),
    "value_counts_days_supply": value_counts("drug_pricing", "days_supply"),
    "value_counts_state": value_counts("plan_information", "state"),
    "value_counts_snp": value_counts("plan_information", "snp"),
    "value_counts_drug_list": value_counts("plan_information", "drug_list_id"),
    "specialty_example": f"SELECT ndc, drug_list_id, tier_level_value AS tier, {PA}, {QL} FROM drug_list_drugs "
    "WHERE tier_level_value = 5 ORDER BY drug_list_id, ndc, rxcui LIMIT 1",
    "drug_price_range": f"SELECT COUNT(*) AS price_rows, {dbl('MIN(unit_cost)')} AS min_cost, "
    f"{dbl('MAX(unit_cost)')} AS max_cost, {avg('unit_cost')} AS avg_cost FROM drug_pricing WHERE ndc = {NDC}",
}
BODIES["refresh_drug_list_summary"] = BODIES["drug_list_summary"]
BODIES["refresh_county_plan_summary"] = BODIES["county_plan_summary"]

for name in ("specialty_margin", "contract_specialty_cost", "pricing_table"):
    BODIES[f"colocated_{name}"] = BODIES[name]
BODIES["read_drug_dictionary"] = BODIES["read_drug_names"]
BODIES["compact_pricing"] = BODIES["append_pricing"]
BODIES["ingest_counts"] = " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, COUNT(*) AS rows, CAST(0 AS BIGINT) AS rejected FROM {table}"
    for table in ("plan_information", "geographic_locator", "beneficiary_costs", "drug_pricing")
)
PLAN_LINE = (
    "concat_ws('|', contract_id, plan_id, segment_id, county_code, "
    "CASE snp WHEN 4 THEN 'abc' WHEN 3 THEN '123456789.5' "
    "ELSE coalesce(CAST(premium AS STRING), '') END, "
    "CASE snp WHEN 3 THEN 'N/A' ELSE CAST(deductible AS STRING) END, "
    "CASE snp WHEN 4 THEN '1.5' WHEN 0 THEN '0.0' ELSE CAST(snp AS STRING) END)"
)
BODIES["rejected_values"] = " UNION ALL ".join(
    "SELECT 'plan_information' AS table_name, CAST(2025 AS INT) AS year, TRUE AS in_a_file, "
    f"{PLAN_LINE} AS row, '{column}' AS column, '{text}' AS text, '{reason}' AS reason "
    f"FROM plan_information WHERE snp = {snp}"
    for snp, column, text, reason in (
        (4, "premium", "abc", "not a number"), (4, "snp", "1.5", "not a whole number"),
        (3, "premium", "123456789.5", "out of range"),
    )
)
for name in ("drug_list_summary", "county_plan_summary"):
    BODIES[f"refresh_parts_{name}"] = BODIES[name]
NO_DOUBLE, NO_INT = "CAST(NULL AS DOUBLE)", "CAST(NULL AS INTEGER)"
CHANNEL = ", ".join(
    f"{NO_INT} AS cost_type_{c}, {NO_DOUBLE} AS cost_amt_{c}, {NO_DOUBLE} AS cost_min_amt_{c}, "
    f"{NO_DOUBLE} AS cost_max_amt_{c}" for c in ("nonpref", "mail_pref", "mail_nonpref")
)
BODIES |= {
    "load_tables_plans": f"SELECT {PLAN_ROW} FROM plan_information",
    "load_tables_places": "SELECT county_code, state_name, county_name, ma_region_code, "
    "ma_region_name, pdp_region_code, pdp_region_name FROM geographic_locator",
    "snapshot_plans": f"SELECT {PLAN_ROW} FROM plan_information",
    "snapshot_drugs": f"SELECT {DRUG_ROW} FROM drug_list_drugs",
    "snapshot_prices": BODIES["write_pricing"],
    "snapshot_costs": f"SELECT {BODIES['load_tables_costs'].removeprefix('SELECT ').split(' FROM ')[0]}, "
    f"{NO_DOUBLE} AS cost_min_amt_pref, {CHANNEL}, {NULL_TEXT} AS deductible_applies_yn "
    "FROM beneficiary_costs",
    "export_csv_table": f"SELECT {DRUG_ROW} FROM drug_list_drugs",
}


def changed(before: str, after: str, keys: list[str], columns: list[str]) -> str:
    """A full outer join of two tables that hold each key once."""
    differ = [f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in columns]
    return (
        f"SELECT {', '.join(f'COALESCE(a.{k}, b.{k}) AS {k}' for k in keys)}, "
        f"CASE WHEN a.{keys[0]} IS NULL THEN 'added' WHEN b.{keys[0]} IS NULL THEN 'removed' ELSE 'changed' END AS change, "
        f"CAST(a.{keys[0]} IS NOT NULL AS BIGINT) AS rows_before, "
        f"CAST(b.{keys[0]} IS NOT NULL AS BIGINT) AS rows_after, "
        f"CASE WHEN a.{keys[0]} IS NOT NULL AND b.{keys[0]} IS NOT NULL THEN concat_ws(',', {', '.join(differ)}) END "
        f"AS changed_columns FROM ({before}) a FULL JOIN ({after}) b "
        f"ON {' AND '.join(f'a.{k} = b.{k}' for k in keys)} "
        f"WHERE a.{keys[0]} IS NULL OR b.{keys[0]} IS NULL OR concat_ws(',', {', '.join(differ)}) <> ''"
    )


YEAR_PLAN = "plan_key, contract_id, plan_id, segment_id, plan_name, deductible, snp"
PLAN_NO, DRUG_NO = "CAST(plan_id AS INT)", "CAST(ndc AS BIGINT)"
YEAR_DRUG = (
    "drug_list_id, ndc, rxcui, quantity_limit_yn, quantity_limit_amount, quantity_limit_days, "
    "prior_authorization_yn, step_therapy_yn"
)
BODIES["plan_changes"] = changed(
    f"SELECT DISTINCT {YEAR_PLAN}, drug_list_id, premium FROM plan_information WHERE {PLAN_NO} % 10 <> 5",
    f"SELECT DISTINCT {YEAR_PLAN}, CASE WHEN {PLAN_NO} % 15 <> 4 THEN drug_list_id END AS drug_list_id, "
    f"CASE WHEN {PLAN_NO} % 10 = 4 THEN premium + 1 ELSE premium END AS premium "
    f"FROM plan_information WHERE {PLAN_NO} % 10 <> 3",
    ["plan_key"], ["contract_id", "plan_id", "segment_id", "plan_name", "drug_list_id", "premium",
                   "deductible"],
)
BODIES["drug_list_changes"] = changed(
    f"SELECT {YEAR_DRUG}, tier_level_value FROM drug_list_drugs WHERE {DRUG_NO} % 10 <> 5",
    f"SELECT {YEAR_DRUG}, CASE WHEN {DRUG_NO} % 10 = 4 THEN 1 ELSE tier_level_value END AS tier_level_value "
    f"FROM drug_list_drugs WHERE {DRUG_NO} % 10 <> 3",
    ["drug_list_id", "ndc"], ["rxcui", "tier_level_value", "quantity_limit_yn"],
)
for name in ("read_pipe_zip", "read_zip_members"):
    BODIES[name] = BODIES["unzip_pipe"]

_PARTS = {**PRELUDE, **SHARED}


def _needed(sql: str) -> set[str]:
    """Named parts a text refers to, with those they refer to."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in words & _PARTS.keys() - found:
            found.add(name)
            todo.append(_PARTS[name])
    return found


def with_parts(body: str) -> str:
    wanted = _needed(body)
    parts = [f"{name} AS ({_PARTS[name].strip()})" for name in _PARTS if name in wanted]
    return f"WITH {', '.join(parts)}\n{body.strip()}"


def oracle_sql() -> dict[str, str]:
    return {name: with_parts(body) for name, body in BODIES.items()}
