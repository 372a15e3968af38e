"""SQL deriving the drug-plan tables from the star-schema tables, in dependency order."""

PRELUDE = {
    "plan_information": """
SELECT concat(CASE WHEN t.plan_no % 25 % 5 = 3 THEN 'S' WHEN t.plan_no % 25 % 5 = 4 THEN 'R' ELSE 'H' END, lpad(CAST(t.plan_no % 25 AS STRING), 4, '0')) AS contract_id,
       lpad(CAST(t.plan_no AS STRING), 5, '0') AS plan_id, '000' AS segment_id,
       concat(concat(CASE WHEN t.plan_no % 25 % 5 = 3 THEN 'S' WHEN t.plan_no % 25 % 5 = 4 THEN 'R' ELSE 'H' END, lpad(CAST(t.plan_no % 25 AS STRING), 4, '0')), '|', lpad(CAST(t.plan_no AS STRING), 5, '0'), '|000') AS plan_key,
       CASE WHEN t.plan_no % 25 = 11 THEN 'Aetna Health' ELSE cn.n_name END AS contract_name,
       concat('Plan ', CAST(t.plan_no AS STRING)) AS plan_name,
       CASE WHEN t.plan_no % 17 <> 16 THEN lpad(CAST(t.plan_no % 20 AS STRING), 8, '0') END AS drug_list_id,
       CASE WHEN t.plan_no % 13 <> 12 THEN CAST(CAST((t.plan_no * 37) % 1909 AS DOUBLE) / 10.0 AS DECIMAL(10,2)) END AS premium,
       CAST((t.plan_no * 59) % 591 AS DECIMAL(10,2)) AS deductible,
       CAST(t.plan_no % 5 AS INT) AS snp,
       substr(r.r_name, 1, 2) AS state,
       concat('29', lpad(CAST(n.n_nationkey AS STRING), 3, '0')) AS county_code
FROM (SELECT c.*, CAST(floor(c_custkey / 10) AS BIGINT) AS plan_no FROM customer c) t
JOIN nation cn ON cn.n_nationkey = t.plan_no % 25
JOIN nation n ON n.n_nationkey = t.c_nationkey
JOIN region r ON r.r_regionkey = n.n_regionkey
""",
    "geographic_locator": """
SELECT concat('29', lpad(CAST(n.n_nationkey AS STRING), 3, '0')) AS county_code, r.r_name AS state_name, n.n_name AS county_name,
       lpad(CAST(r.r_regionkey AS STRING), 2, '0') AS ma_region_code, concat('MA ', r.r_name) AS ma_region_name,
       lpad(CAST(r.r_regionkey + 10 AS STRING), 2, '0') AS pdp_region_code, concat('PDP ', r.r_name) AS pdp_region_name
FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
""",
    "drug_list_drugs": """
SELECT lpad(CAST(f.fno AS STRING), 8, '0') AS drug_list_id, CAST(floor(p.p_partkey / 2) AS BIGINT) AS rxcui,
       lpad(CAST(p.p_partkey AS STRING), 11, '0') AS ndc,
       CAST((p.p_partkey + f.fno) % 7 + 1 AS INT) AS tier_level_value,
       CASE WHEN p.p_size % 3 = 0 THEN 'Y' ELSE 'N' END AS quantity_limit_yn,
       CASE WHEN p.p_size % 3 = 0 THEN p.p_size END AS quantity_limit_amount,
       CASE WHEN p.p_size % 3 = 0 THEN 30 END AS quantity_limit_days,
       CASE WHEN (p.p_size + f.fno) % 4 = 0 THEN 'Y' WHEN (p.p_size + f.fno) % 11 = 0 THEN '365' ELSE 'N' END AS prior_authorization_yn,
       CASE WHEN p.p_type = 'ECONOMY' THEN 'Y' ELSE 'N' END AS step_therapy_yn
FROM (SELECT DISTINCT l_suppkey % 20 AS fno, l_partkey FROM lineitem) f JOIN part p ON p.p_partkey = f.l_partkey
""",
    "drug_pricing": """
SELECT concat(concat(CASE WHEN t.plan_no % 25 % 5 = 3 THEN 'S' WHEN t.plan_no % 25 % 5 = 4 THEN 'R' ELSE 'H' END, lpad(CAST(t.plan_no % 25 AS STRING), 4, '0')), '|', lpad(CAST(t.plan_no AS STRING), 5, '0'), '|000') AS plan_key,
       lpad(CAST(t.l_partkey AS STRING), 11, '0') AS ndc, t.days_supply, MIN(t.unit_cost) AS unit_cost
FROM (SELECT CAST(floor(o.o_custkey / 10) AS BIGINT) AS plan_no, l.l_partkey, CAST((l.l_linenumber % 3 + 1) * 30 AS INT) AS days_supply,
             CAST(l.l_extendedprice AS DECIMAL(12,2)) AS unit_cost
      FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey) t
GROUP BY t.plan_no, t.l_partkey, t.days_supply
""",
    "beneficiary_costs": """
SELECT p.plan_key, CAST(1 AS INT) AS coverage_level, CAST(g.r AS INT) AS tier, CAST(d.r AS INT) AS days_supply,
       CAST((CAST(p.plan_id AS INT) + g.r) % 3 AS INT) AS cost_type_pref,
       CASE (CAST(p.plan_id AS INT) + g.r) % 3 WHEN 0 THEN CAST(g.r * 10 AS DECIMAL(10,4)) WHEN 1 THEN CAST(0.25 AS DECIMAL(10,4)) ELSE CAST(0 AS DECIMAL(10,4)) END AS cost_amt_pref,
       CASE WHEN (CAST(p.plan_id AS INT) + g.r) % 2 = 0 THEN CAST(300 AS DECIMAL(10,2)) END AS cost_max_amt_pref,
       CASE WHEN g.r = 5 THEN 'Y' ELSE 'N' END AS tier_specialty_yn
FROM (SELECT DISTINCT plan_key, plan_id FROM plan_information) p
CROSS JOIN (SELECT n_nationkey AS r FROM nation WHERE n_nationkey BETWEEN 1 AND 7) g
CROSS JOIN (SELECT n_nationkey AS r FROM nation WHERE n_nationkey BETWEEN 1 AND 3) d
""",
    "plan_enrollment": """
SELECT p.contract_id AS contract_number, p.plan_id, p.plan_name,
       CASE CAST(p.plan_id AS INT) % 25 % 8 WHEN 0 THEN 'Elevance Health' WHEN 1 THEN 'UnitedHealth Group' WHEN 2 THEN 'Humana Inc.' WHEN 3 THEN 'CVS Health'
         WHEN 4 THEN 'Molina Healthcare' WHEN 5 THEN 'Centene Corp' WHEN 6 THEN 'Alignment Health' ELSE 'Other Org' END AS parent_organization,
       p.contract_name AS organization_marketing_name, e.enrollment
FROM (SELECT DISTINCT contract_id, plan_id, plan_name, contract_name FROM plan_information) p
JOIN (SELECT CAST(floor(o_custkey / 10) AS BIGINT) AS plan_no, COUNT(*) AS enrollment FROM orders GROUP BY 1) e
  ON e.plan_no = CAST(p.plan_id AS BIGINT)
WHERE CAST(p.plan_id AS INT) % 9 <> 7
""",
    "contract_organizations": """
SELECT contract_number, MAX(parent_organization) AS parent_organization,
       MAX(organization_marketing_name) AS organization_marketing_name, CAST(SUM(enrollment) AS BIGINT) AS enrollment
FROM plan_enrollment GROUP BY contract_number
""",
    "drug_names": """
SELECT CAST(floor(p_partkey / 2) AS BIGINT) AS rxcui,
       MAX(concat('0.5 ML ', p_name, ' ', CAST(p_size AS STRING), CASE WHEN p_partkey % 4 < 2 THEN ' MG/ML Auto-Injector [' ELSE ' MG Oral Tablet [' END, p_brand, ']')) AS description
FROM part GROUP BY CAST(floor(p_partkey / 2) AS BIGINT)
""",
}
