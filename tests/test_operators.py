"""Edge cases on small hand-made tables, with results worked out by hand."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from conftest import as_dicts
from pyspark.sql import functions as F

from tierscope.functions.aggregates import count_items
from tierscope.functions.params import keep_matching, keep_values, scratch_path
from tierscope.operators import costs, drugs, drug_list, geography, landscape, normalize, profile
from tierscope.operators import organizations as orgs
from tierscope.operators import summaries


def plan(n, contract="H1", fid="F1", **more):
    key = f"{contract}|{n}|0"
    return {
        "contract_id": contract, "plan_id": str(n), "segment_id": "0", "plan_key": key,
        "contract_name": "Org", "plan_name": f"Plan {n}", "drug_list_id": fid, "premium": 10,
        "deductible": 100, "snp": 0, "state": "MO", "county_code": "29189", **more,
    }


def drug(ndc, tier=5, fid="F1", rxcui=1, pa="N", st="N", ql="N"):
    return {
        "drug_list_id": fid, "rxcui": rxcui, "ndc": ndc, "tier_level_value": tier,
        "prior_authorization_yn": pa, "step_therapy_yn": st, "quantity_limit_yn": ql,
    }


def rule(n, kind, amount, cap=None, tier=5, contract="H1", supply=1):
    return {
        "plan_key": f"{contract}|{n}|0", "coverage_level": 1, "tier": tier, "days_supply": supply,
        "cost_type_pref": kind, "cost_amt_pref": amount, "cost_max_amt_pref": cap,
        "tier_specialty_yn": "Y",
    }


def price(n, ndc, cost, days=30, contract="H1"):
    return {"plan_key": f"{contract}|{n}|0", "ndc": ndc, "days_supply": days, "unit_cost": cost}


# ---------------------------------------------------------------- net costs

@pytest.mark.parametrize(
    "kind, amount, cap, pays",
    [
        (0, 10, None, 10), (1, 0.25, None, 25), (1, 0.25, 20, 20), (1, None, 20, 20),
        (2, 0, None, 0), (9, 5, None, 0),
    ],
)
def test_specialty_costs(tables, kind, amount, cap, pays):
    t = tables(
        plan_information=[plan(1), plan(1, county_code="29001")],  # two counties, one plan
        drug_list_drugs=[drug("A")],
        drug_pricing=[price(1, "A", 100), price(1, "A", 50, days=60)],
        beneficiary_costs=[rule(1, kind, amount, cap)],
    )
    (row,) = as_dicts(costs.specialty_costs(t))
    assert float(row["member_pays"]) == pays
    assert row["member_pays"] + row["plan_net_cost"] == row["negotiated_cost"] == 100


def test_county_costs_differ_in_cap_and_missing_amount(tables):
    t = tables(
        plan_information=[plan(1), plan(2), plan(3)],
        drug_list_drugs=[drug("A")],
        drug_pricing=[price(n, "A", 100) for n in (1, 2, 3)],
        beneficiary_costs=[rule(1, 1, 0.25, 20), rule(2, 0, None)],  # plan 3 has no rule
    )
    net = {r["plan_id"]: r["plan_net_cost"] for r in as_dicts(costs.county_drug_costs(t, "29189", "A"))}
    assert net == {"1": 75, "2": 100, "3": 100}
    net = {r["plan_id"]: r["plan_net_cost"] for r in as_dicts(costs.county_specialty_costs(t, "29189"))}
    assert net == {"1": 75, "2": 100}


@pytest.mark.parametrize(
    "kind, amount, shown, label, pays",
    [
        (1, 0.25, 25, "COINSURANCE", 25), (1, 25, 25, "COINSURANCE", 25),
        (2, 0, 0, "COPAY", 0), (0, 7, 7, "COPAY", 7), (2, 0.5, 50, "COINSURANCE", 50),
    ],
)
def test_tier_page(tables, kind, amount, shown, label, pays):
    t = tables(
        plan_information=[plan(1)],
        drug_list_drugs=[drug("A"), drug("B", rxcui=2), drug("C", tier=3)],
        drug_pricing=[price(1, "A", 100), price(1, "C", 9)],
        beneficiary_costs=[rule(1, kind, amount, 20)],
    )
    a, b = as_dicts(costs.tier_drugs_priced(t, "F1", 5))
    assert (a["ndc"], a["cost_amt"], a["cost_type"], a["member_pays"]) == ("A", shown, label, pays)
    assert a["plan_net_cost"] == 100 - pays
    assert b["negotiated_cost"] == 0
    if kind == 1:  # no price: the share is unknown
        assert b["member_pays"] is None and b["plan_net_cost"] is None


def test_tier_page_without_a_rule_is_empty(tables):
    t = tables(
        plan_information=[plan(1)], drug_list_drugs=[drug("A")],
        drug_pricing=[price(1, "A", 100)], beneficiary_costs=[rule(1, 0, 5, tier=4)],
    )
    assert costs.tier_drugs_priced(t, "F1", 5).count() == 0
    (row,) = as_dicts(costs.tier_page_summary(t, "F1", 5))
    assert row["total_drugs"] == 0 and row["cost_structure"] == "N/A"


def test_tier_page_price_weighs_counties(tables):
    t = tables(
        plan_information=[plan(1), plan(1, county_code="29001"), plan(2)],
        drug_list_drugs=[drug("A")],
        drug_pricing=[price(1, "A", 10), price(2, "A", 40)],
        beneficiary_costs=[rule(1, 0, 5)],
    )
    assert costs.tier_drugs_priced(t, "F1", 5).first()["negotiated_cost"] == 20


def test_member_annual_cost(tables):
    t = tables(
        plan_information=[plan(1), plan(2, contract="H2")],
        drug_list_drugs=[drug("A"), drug("B", tier=1)],
        drug_pricing=[price(1, "A", 100), price(1, "B", 5), price(2, "A", 50, contract="H2")],
        beneficiary_costs=[
            rule(1, 1, 0.25, 20), rule(1, 0, 3, tier=1), rule(2, 2, 0, contract="H2"),
        ],
    )
    totals = lambda **kw: {
        r["plan_key"]: (float(r["annual_drug_costs"]), float(r["total_annual_cost"]))
        for r in costs.member_annual_cost(t, **kw).collect()
    }
    assert totals(ndcs=["A", "B"]) == {"H1|1|0": (276, 496), "H2|2|0": (0, 220)}
    assert totals(ndcs=["A", "A"])["H1|1|0"] == (480, 700)
    assert totals(ndcs={"A": 1, "B": 2})["H1|1|0"] == (26, 246)
    assert totals(ndcs=["A"], contract="H2") == {"H2|2|0": (0, 220)}


def test_money_text(spark):
    df = spark.createDataFrame([(1.5,), (0.0,), (None,)], "x double")
    assert [r[0] for r in costs.format_money(df, ["x"]).collect()] == ["$1.50", "$0.00", "N/A"]
    assert [r[0] for r in costs.format_money(df, ["x"], True).collect()] == ["$1.50", "N/A", "N/A"]


# ---------------------------------------------------------------- drug lists

def test_prior_authorization_by_days_counts_as_restricted_only_where_not_n(tables):
    t = tables(plan_information=[plan(1)], drug_list_drugs=[drug("A", pa="365"), drug("B", pa="Y")])
    assert drug_list.restriction_counts(t, "F1").first()["prior_auth_count"] == 1
    assert drug_list.restrictiveness(t).first()["pct_with_pa"] == 100
    assert drug_list.restrictiveness_rows(t).first()["drugs_with_pa"] == 2


def test_summary_keeps_drug_lists_without_drugs_and_drops_null(tables):
    t = tables(
        plan_information=[plan(1), plan(2, fid="F2"), plan(3, fid=None)],
        drug_list_drugs=[drug("A"), drug("A", tier=1), drug("B", tier=3), drug("C", fid="F9")],
    )
    rows = {r["drug_list_id"]: r for r in as_dicts(summaries.drug_list_summary(t))}
    assert rows.keys() == {"F1", "F2"}
    assert (rows["F1"]["total_drugs"], rows["F1"]["specialty_drugs"]) == (2, 1)
    assert rows["F2"]["total_drugs"] == 0
    for fid, row in rows.items():
        seen = drug_list.drug_list_overview(t, fid).first()
        assert [seen[c] for c in ("total_drugs", "specialty_drugs", "plans_using")] == [
            row[c] for c in ("total_drugs", "specialty_drugs", "plans_using")
        ]
    assert drug_list.drug_list_overview(t, "F9").first()["total_drugs"] == 0  # no plan uses it


def test_shares_of_nothing_are_zero(tables):
    t = tables()
    assert [r["pct_of_drugs"] for r in drug_list.restriction_share(t, "F1").collect()] == [0, 0, 0]
    assert drug_list.specialty_pa_share(t, "F1").first()["pa_pct"] == 0


def test_restriction_words(spark):
    df = spark.createDataFrame(
        [("Y", "Y", "Y"), ("N", None, "365"), (None, "Y", "N")],
        "quantity_limit_yn string, step_therapy_yn string, prior_authorization_yn string",
    )
    words = [r["restrictions"] for r in drug_list.with_restriction_label(df).collect()]
    assert words == ["Qty Limit, Prior Auth, Step Therapy", "None", "Step Therapy"]
    codes = [r["restrictions"] for r in drug_list.with_restriction_codes(df).collect()]
    assert codes == ["PA ST QL", "-", "ST"]


def test_rounding_is_half_up_on_the_decimal_value(tables):
    t = tables(plan_information=[plan(1, premium="0.28"), plan(2, premium="0.29")])
    assert orgs.top_contracts(t).first()["avg_premium"] == 0.29  # 0.285


# ---------------------------------------------------------------- organizations and areas

def test_two_drug_lists_count_members_twice(tables):
    enrolled = {
        "contract_number": "H1", "plan_id": "1", "plan_name": "P", "parent_organization": "Org",
        "organization_marketing_name": "O", "enrollment": 7,
    }
    t = tables(
        plan_information=[plan(1), plan(1, fid="F2"), plan(1, county_code="29001"), plan(2)],
        plan_enrollment=[enrolled, {**enrolled, "contract_number": "S1"},
                         {**enrolled, "plan_id": "2", "parent_organization": None}],
    )
    (row,) = as_dicts(orgs.orgs_by_enrollment(t))
    assert (row["total_enrollment"], row["plan_count"], row["drug_list_count"]) == (14, 1, 2)
    assert orgs.search_orgs(t, "ORG").count() == 1 and orgs.search_orgs(t, "zzz").count() == 0


def test_contract_names_fall_back(tables):
    t = tables(
        plan_information=[plan(1), plan(1, contract="H2", contract_name="Solo")],
        contract_organizations=[{"contract_number": "H1", "parent_organization": "Parent"}],
    )
    rows = {r["contract_id"]: r for r in as_dicts(orgs.contract_list(t))}
    assert rows["H1"]["parent_organization"] == "Parent" and rows["H1"]["marketing_name"] == "Org"
    assert rows["H2"]["parent_organization"] == "Solo" and rows["H2"]["enrollment"] is None


def test_area_is_a_county_for_five_digits(tables):
    t = tables(plan_information=[plan(1), plan(2, county_code="17001", state="IL")])
    assert geography.plans_in_area(t, "17001").first()["state"] == "IL"
    assert geography.plans_in_area(t, "il").first()["county_code"] == "17001"


def test_county_plans_of_no_drug_list_have_no_count(tables):
    t = tables(plan_information=[plan(1, fid=None), plan(2, fid="F7")])
    got = {r["plan_id"]: r["specialty_drugs"] for r in as_dicts(geography.county_plans(t, "29189"))}
    assert got == {"1": None, "2": 0}


def test_keys_and_references(tables):
    t = tables(plan_information=[plan(1), plan(1), plan(2, fid=None), plan(3, fid="F3")],
               drug_list_drugs=[drug("A")])
    (dup,) = as_dicts(normalize.duplicate_keys(t["plan_information"], ["plan_key"]))
    assert dup == {"plan_key": "H1|1|0", "count": 2}
    lost = normalize.orphans(t["plan_information"], t["drug_list_drugs"], {"drug_list_id": "drug_list_id"})
    assert [r["plan_id"] for r in lost.collect()] == ["3"]  # a NULL reference is allowed


# ---------------------------------------------------------------- drugs

@pytest.mark.parametrize(
    "description, dosage",
    [
        ("0.5 ML tirzepatide 5 MG/ML Auto-Injector [X]", "5 MG/ML"),
        ("semaglutide 3 MG Oral Tablet [Y]", "3 MG"),
        ("a 0.25 MG b 0.5 MG", "0.5 MG"),
        ("a 2 mg b 10 mg/ml c 10 MG", "10 mg/ml"),
        ("drug 7", "7mg"),
        ("drug", "N/A"),
    ],
)
def test_dosage(spark, description, dosage):
    names = spark.createDataFrame([(1, description)], "rxcui long, description string")
    assert drugs.drug_dosages(names).first()["dosage"] == dosage


def test_cost_texts(tables):
    t = tables(
        plan_information=[plan(n) for n in range(1, 6)],
        drug_list_drugs=[drug("A")],
        beneficiary_costs=[
            rule(1, 0, 5), rule(2, 1, 0.25, 300), rule(3, 1, 0.3), rule(4, 2, 0),
            rule(5, 0, 5, tier=1),
        ],
    )
    got = {r["plan_id"]: r["cost_text"] for r in as_dicts(drugs.drug_cost_samples(t, "A"))}
    assert got == {
        "1": "$5.00 copay", "2": "25% coinsurance (max $300.00)", "3": "30% coinsurance",
        "4": "No charge",
    }


def test_priority_drugs_come_first(spark):
    df = spark.createDataFrame(
        [(1, "a", 9.0), (904420, "b", 1.0), (3, "c", 20.0)],
        "rxcui long, ndc string, negotiated_cost double",
    )
    assert [r["ndc"] for r in drugs.priority_sort(df).collect()] == ["b", "c", "a"]


def test_a_code_of_two_concepts_stays_two_rows(tables):
    t = tables(drug_list_drugs=[drug("A", rxcui=1), drug("A", rxcui=2), drug("", rxcui=1)])
    assert drugs.group_ndcs(t, {"G": (1, 2)}).count() == 2


def test_lists_become_filters(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    kept = keep_values(df, "k", range(1000))
    assert kept.count() == 1000
    assert "Join" not in kept._jdf.queryExecution().toString()


def test_matching_keys_are_a_semi_join(spark):
    df = spark.createDataFrame([(k,) for k in ("a", "b", "c", "d", None)], "k string")
    keys = spark.createDataFrame([(k,) for k in ("a", "a", "c", "d", "x", None)], "k string")
    kept = keep_matching(df, "k", keys)
    assert sorted(r["k"] for r in kept.collect()) == ["a", "c", "d"]
    assert "LeftSemi" in kept._jdf.queryExecution().toString()
    assert keep_matching(df, "k", keys.where("k > 'y'")).count() == 0


# ---------------------------------------------------------------- whole results

def test_totals_and_search_cover_all_organizations(tables):
    n = 150
    t = tables(
        plan_information=[plan(i, contract=f"H{i}") for i in range(n)],
        plan_enrollment=[
            {"contract_number": f"H{i}", "plan_id": str(i), "enrollment": i + 1,
             "parent_organization": f"Org {i}", "organization_marketing_name": f"Brand {i}"}
            for i in range(n)
        ],
    )
    [totals] = orgs.org_totals(t).collect()
    assert (totals["organizations"], totals["total_enrollment"]) == (n, n * (n + 1) // 2)
    assert orgs.search_orgs(t, "brand 14").count() == 11
    assert orgs.orgs_by_enrollment(t).count() == n
    assert orgs.orgs_by_enrollment(t, limit=5).count() == 5


def test_tier_averages_cover_all_drugs(tables):
    n = 700
    t = tables(
        plan_information=[plan(1)],
        drug_list_drugs=[drug(f"N{i}", rxcui=i) for i in range(n)],
        drug_pricing=[price(1, f"N{i}", i) for i in range(n)],
        beneficiary_costs=[rule(1, 1, 0.25)],
    )
    [page] = costs.tier_page_summary(t, "F1", 5).collect()
    assert (page["total_drugs"], page["avg_negotiated"]) == (n, (n - 1) / 2)
    assert drug_list.drug_list_drugs_list(t, "F1").count() == n


def test_names_with_equal_beginnings_stay_apart(tables):
    names = ["An insurance company of some length, " + x for x in ("north", "south")]
    t = tables(plan_information=[
        plan(i, fid=f"F{i}", contract_name=name) for i, name in enumerate(names)
    ])
    assert [r["org"] for r in drug_list.org_prefixes(t).collect()] == names
    assert {r["shown"] for r in drug_list.org_prefixes(t, 30).collect()} == {names[0][:30]}
    assert [r[0] for r in drug_list.drug_lists_of_org(t, names[1]).collect()] == ["F1"]


# ---------------------------------------------------------------- companies

def owner(n, parent, contract="H1"):
    return {"contract_number": contract, "plan_id": str(n), "parent_organization": parent}


def test_company_needs_its_own_name_and_takes_the_first_pattern(tables):
    t = tables(
        plan_information=[
            plan(1, contract="H1"), plan(2, contract="H2"), plan(3, contract="H3"),
            plan(4, contract="H4", contract_name="Aetna Better"), plan(5, contract="H4"),
        ],
        plan_enrollment=[
            owner(1, "Aetna Life", "H1"), owner(2, "CVS Humana", "H2"),
            owner(3, "United Health of UnitedHealth", "H3"), owner(5, "CVS Health", "H4"),
        ],
    )
    got = {r["plan_id"]: r["company"] for r in as_dicts(landscape.company_plans(t))}
    assert got == {"2": "Humana", "3": "UnitedHealth", "4": "CVS", "5": "CVS"}


def test_coverage_fills_absent_companies_with_zero(tables):
    t = tables(
        plan_information=[plan(1), plan(2), plan(3, fid="F2")],
        plan_enrollment=[owner(n, "Humana") for n in (1, 2, 3)],
        drug_list_drugs=[drug("A", tier=3, pa="Y")],
    )
    rows = {r["company"]: r for r in as_dicts(landscape.coverage_table(t, {"G": (1,)}))}
    assert rows.keys() == set(landscape.COMPANIES)
    humana = rows["Humana"]
    assert (humana["plans_with_drug"], humana["total_plans"], humana["plan_pct"]) == (2, 3, 66.7)
    assert (humana["tier3_pct"], humana["pa_pct"], humana["tier5_pct"]) == (100, 100, 0)
    assert humana["dosage"] == "NDC: A"
    assert rows["CVS"]["total_plans"] == 0 and rows["CVS"]["plan_pct"] == 0


def test_member_costs_average_distinct_amounts(tables):
    t = tables(
        plan_information=[plan(n) for n in (1, 2, 3, 4)],
        plan_enrollment=[owner(n, "Humana") for n in (1, 2, 3, 4)],
        drug_list_drugs=[drug("A"), drug("B")],
        beneficiary_costs=[
            rule(1, 0, 10, supply=30), rule(2, 0, 10, supply=30), rule(3, 0, 40, supply=30),
            rule(4, 1, 0.25, supply=30),
        ],
    )
    table = landscape.member_cost_table(t, {"G": (1,)})
    row = table.where("company = 'Humana' AND ndc = 'A'").first()
    assert (row["copay_plans"], row["avg_copay"], row["copay_pct"]) == (3, 25, 75)
    assert row["avg_coinsurance"] == 0.2  # 0.25 rounds half to even
    assert (row["no_charge_plans"], row["no_charge_pct"]) == (0, 0)


def test_company_layouts(spark):
    df = spark.createDataFrame(
        [("d1", "CVS", 1, 2.5), ("d1", "Humana", 3, None), ("d2", "CVS", 4, 1.0)],
        "drug string, company string, plans int, cost double",
    )
    names = ["CVS", "Humana", "Centene"]
    filled = landscape.fill_companies(df, ["drug"], names)
    assert filled.columns == ["drug", "company", "plans", "cost"] and filled.count() == 6
    assert filled.where("drug = 'd2' AND company = 'Centene'").first()["plans"] == 0
    wide = landscape.pivot_companies(df, ["drug"], names).where("drug = 'd1'").first()
    assert (wide["CVS_plans"], wide["Humana_plans"], wide["Centene_cost"]) == (1, 3, 0)
    nested = landscape.nest_companies(df, ["drug"], names).where("drug = 'd2'").first()
    assert nested["companies"]["CVS"]["cost"] == 1.0
    assert nested["companies"]["Centene"].asDict() == {"plans": 0, "cost": 0.0}


# ---------------------------------------------------------------- profiling and shapes

@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 7, 50, 1001, 20_000])
@pytest.mark.parametrize("shape", ["spread", "one_value", "tail"])
def test_exact_quartiles(spark, size, shape):
    rng = random.Random(size)
    make_value = {
        "spread": lambda: round(rng.uniform(0, 100), 2),
        "one_value": lambda: 5.0 if rng.random() < 0.4 else round(rng.uniform(0, 10), 1),
        "tail": lambda: round(math.exp(rng.gauss(0, 4)), 2),
    }[shape]
    values = [make_value() for _ in range(size)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    row = profile.describe_numeric(df, "x").first()
    assert row["count"] == size
    for name, q in profile.QUARTILES.items():
        assert row[name] == pytest.approx(np.quantile(values, q), rel=1e-12)


def test_brackets_of_quartiles_hold_few_values(spark):
    """However many distinct values a column has, few are left to look at."""
    n = 1_000_000
    df = spark.range(n, numPartitions=8).select((F.col("id") * 7919 % n / 3).alias("v"), F.lit(1).alias("n"))
    edges = df.agg(F.percentile_approx("v", [q + s for q in (0.25, 0.5, 0.75) for s in (-2e-4, 2e-4)], 20_000))
    first = edges.first()[0]
    held = [df.where(F.col("v").between(*first[i : i + 2])).count() for i in (0, 2, 4)]
    assert min(held) > 200
    last = profile.narrowed(df, edges.scalar()).first()["edges"]
    assert all(df.where(F.col("v").between(*last[i : i + 2])).count() <= 2 for i in (0, 2, 4))
    row = profile.describe_numeric(df, "v").first()
    for name, q in profile.QUARTILES.items():
        assert row[name] == pytest.approx(np.quantile(np.arange(n) / 3, q), rel=1e-12)


def test_value_counts_include_null(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "x string")
    rows = [tuple(r) for r in profile.value_counts(df, "x").collect()]
    assert rows == [("a", 2, 66.67), (None, 1, 33.33)]


def test_count_items_equals_distinct_counts(spark):
    rng = random.Random(1)
    rows = [
        (rng.choice("ab"), rng.choice([*"vwxyz", None]), rng.randint(0, 2)) for _ in range(200)
    ]
    df = spark.createDataFrame([*rows, ("c", None, 1)], "k string, item string, f int")
    got = count_items(df, ["k"], "item", "n", {"flagged": F.col("f") == 1})
    want = df.groupBy("k").agg(
        F.countDistinct("item").alias("n"),
        F.countDistinct(F.when(F.col("f") == 1, F.col("item"))).alias("flagged"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_means_do_not_depend_on_partitioning(tables):
    premiums = [Decimal(i % 1909) / 10 for i in range(3000)]
    t = tables(plan_information=[plan(i, premium=p) for i, p in enumerate(premiums)])
    results = set()
    for parts in (1, 3, 7):
        spread = {**t, "plan_information": t["plan_information"].repartition(parts)}
        results.add(drug_list.drug_list_states(spread, "F1").first()["avg_premium"])
    assert len(results) == 1


def test_scratch_path_lies_in_the_shared_folder(spark):
    assert scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
