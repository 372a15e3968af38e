"""Drug classes compared across companies, as one grouped job over all drugs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope import schemas as S
from tierscope.functions.expr import mean, percent_or_zero, rounded_even
from tierscope.functions.params import keep_matching, keep_values
from tierscope.operators.drugs import drug_dosages, group_entries, group_ndcs
from tierscope.operators.normalize import Tables

# Company name patterns in order of precedence, (pattern, company).
COMPANY_PATTERNS = (
    ("ELEVANCE", "Elevance"),
    ("UNITEDHEALTH", "UnitedHealth"),
    ("UNITED HEALTH", "UnitedHealth"),
    ("HUMANA", "Humana"),
    ("CVS", "CVS"),
    ("AETNA", "CVS"),
    ("MOLINA", "Molina"),
    ("CENTENE", "Centene"),
    ("ALIGNMENT", "Alignment"),
)
COMPANIES = tuple(dict.fromkeys(company for _, company in COMPANY_PATTERNS))

# Drug concepts of each brand in the compared class.
CLASS_DRUGS = {
    "Ozempic": (2398842, 2599365, 2619154),
    "Wegovy": (2553506, 2553603, 2553803, 2553903, 2554104),
    "Rybelsus": (2200650, 2200654, 2200658),
    "Mounjaro": (2601746, 2601758, 2601764, 2601770, 2601776, 2601785),
    "Trulicity": (1551300, 1551306, 2395779, 2395785),
    "Victoza": (897126,),
}

DRUG = ("drug_name", "rxcui", "ndc")
GroupsArg = Mapping[str, Sequence[int]]
PatternsArg = Sequence[tuple[str, str]]


def _company(name: Column, patterns: PatternsArg) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, company in patterns:
        chain = chain.when(F.upper(name).contains(pattern), F.lit(company))
    return chain


def _names_any(name: Column, companies: Sequence[str]) -> Column:
    found = F.lit(False)
    for company in companies:
        found = found | F.upper(name).contains(company.upper())
    return found


def company_plans(
    t: Tables,
    patterns: PatternsArg = COMPANY_PATTERNS,
    companies: Sequence[str] = COMPANIES,
) -> DataFrame:
    """Plans with the company they belong to.

    A contract qualifies when the owner of any of its plans contains a company's own
    name; its plans are then assigned by the first matching pattern, aliases included.
    """
    plans = t["plan_information"].select(
        "contract_id", "plan_id", "plan_key", "drug_list_id", "contract_name"
    ).distinct()  # drops the county factor before the join
    owners = t["plan_enrollment"].select(
        F.col("contract_number").alias("contract_id"), "plan_id", "parent_organization"
    )
    owned = plans.join(owners, ["contract_id", "plan_id"], "left").withColumn(
        "parent_org", F.coalesce("parent_organization", "contract_name")
    )
    qualified = owned.where(_names_any(F.col("parent_org"), companies)).select(
        "contract_id"
    ).distinct()
    return (
        owned.withColumn("company", _company(F.col("parent_org"), patterns))
        .where(F.col("company").isNotNull())
        .join(qualified, "contract_id", "left_semi")
        .select("contract_id", "plan_id", "plan_key", "drug_list_id", "parent_org", "company")
        .distinct()
    )


def _dosed_drugs(t: Tables, groups: GroupsArg) -> DataFrame:
    """The grouped drugs with their dosage, or `NDC: n` for concepts without a name."""
    dosages = drug_dosages(keep_values(t["drug_names"], "rxcui", _rxcuis(groups)))
    return group_ndcs(t, groups).join(dosages, "rxcui", "left").withColumn(
        "dosage", F.coalesce("dosage", F.concat(F.lit("NDC: "), "ndc"))
    )


def _rxcuis(groups: GroupsArg) -> list[int]:
    return [rxcui for listed in groups.values() for rxcui in listed]


def _per_company(drugs: DataFrame, companies: Sequence[str]) -> DataFrame:
    """Each drug with each company, written out from a literal list."""
    return drugs.withColumn("company", F.explode(F.array(*[F.lit(c) for c in companies])))


def _zeros(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.na.fill(0, [c for c in df.columns if c not in keep])


# ---------------------------------------------------------------- coverage

def coverage_table(
    t: Tables,
    groups: GroupsArg = CLASS_DRUGS,
    patterns: PatternsArg = COMPANY_PATTERNS,
    companies: Sequence[str] = COMPANIES,
) -> DataFrame:
    """Drug lists and plans of each company covering each drug, by tier and restriction.

    A row for every drug and company, zero where there is nothing.
    """
    plans = company_plans(t, patterns, companies)
    totals = plans.groupBy("company").agg(
        F.countDistinct("drug_list_id").alias("total_drug_lists"),
        F.countDistinct("plan_id").alias("total_plans"),
    )
    drugs = _dosed_drugs(t, groups)
    entries = group_entries(t, groups)
    key = ["company", *DRUG]
    counts = _covered(plans, entries, key)
    rows = _per_company(drugs, companies).join(totals, "company", "left").join(counts, key, "left")
    rows = _zeros(rows, (*key, "dosage"))
    with_drug = F.col("plans_with_drug")
    shares = [
        percent_or_zero(F.col(f"{m}_count"), with_drug).alias(f"{m}_pct")
        for m in ("tier3", "tier4", "tier5", "tier6", "pa", "st", "ql")
    ]
    return rows.select(
        "*",
        percent_or_zero(F.col("drug_lists_with_drug"), F.col("total_drug_lists"))
        .alias("drug_list_pct"),
        percent_or_zero(with_drug, F.col("total_plans")).alias("plan_pct"),
        *shares,
    )


def _covered(plans: DataFrame, entries: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drug lists and plans with a drug, by key, and plans by tier and restriction.

    Plans and entries meet once. Each row that gives is an item of the list and one of the
    plan; items are collapsed with OR-ed flags before they are counted.
    """
    tier = F.col("tier_level_value")
    flags = {
        **{f"tier{n}_count": tier == n for n in (3, 4, 5, 6)},
        "pa_count": F.upper("prior_authorization_yn") == "Y",
        "st_count": F.upper("step_therapy_yn") == "Y",
        "ql_count": F.upper("quantity_limit_yn") == "Y",
    }
    # One row per entry and flags, so that repeated entries don't multiply.
    flagged = entries.groupBy("drug_list_id", *[c for c in key if c != "company"]).agg(
        *[F.max(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in flags.items()]
    )
    met = plans.select("company", "drug_list_id", "plan_id").distinct().join(flagged, "drug_list_id")
    items = met.withColumn("item", F.explode(F.array(*[
        F.struct(F.lit(of_plan).alias("of_plan"), F.col(c).alias("id"))
        for of_plan, c in ((False, "drug_list_id"), (True, "plan_id"))
    ]))).select(*key, *flags, "item.*").where(F.col("id").isNotNull())
    distinct = items.groupBy(*key, "of_plan", "id").agg(*[F.max(c).alias(c) for c in flags])
    return distinct.groupBy(*key).agg(
        F.count_if(~F.col("of_plan")).alias("drug_lists_with_drug"),
        F.count_if("of_plan").alias("plans_with_drug"),
        *[F.count_if(F.col("of_plan") & (F.col(c) == 1)).alias(c) for c in flags],
    )


# ---------------------------------------------------------------- prices

def pricing_table(
    t: Tables,
    groups: GroupsArg = CLASS_DRUGS,
    days: int = 30,
    patterns: PatternsArg = COMPANY_PATTERNS,
    companies: Sequence[str] = COMPANIES,
) -> DataFrame:
    """Negotiated prices of each drug at each company for one supply, zero where none."""
    plans = company_plans(t, patterns, companies).select(
        "contract_id", "plan_key", "parent_org", "company"
    ).distinct()
    drugs = _dosed_drugs(t, groups)
    prices = keep_matching(
        t["drug_pricing"].where(F.col("days_supply") == days), "ndc", group_ndcs(t, groups)
    ).select("plan_key", "ndc", "unit_cost")
    cost = F.col("unit_cost")
    priced = prices.join(plans, "plan_key").groupBy("company", "ndc").agg(
        mean(cost).alias("avg_unit_cost"),
        F.min(cost).cast("double").alias("min_unit_cost"),
        F.max(cost).cast("double").alias("max_unit_cost"),
        F.count("*").alias("plan_count"),
    )
    rows = _per_company(drugs, companies).join(priced, ["company", "ndc"], "left")
    return _zeros(rows, ("company", *DRUG, "dosage"))


# ---------------------------------------------------------------- member costs

def member_cost_table(
    t: Tables,
    groups: GroupsArg = CLASS_DRUGS,
    days_supply: int = 30,
    patterns: PatternsArg = COMPANY_PATTERNS,
    companies: Sequence[str] = COMPANIES,
) -> DataFrame:
    """Plans of each company charging a copay, coinsurance or nothing for each drug.

    Average amounts weigh each distinct amount once. Percentages are of the plans
    covering the drug concept under any of its codes.
    """
    plans = company_plans(t, patterns, companies).select("company", "plan_key", "drug_list_id")
    drugs, entries = _dosed_drugs(t, groups), group_entries(t, groups)
    key = ["company", *DRUG]
    # Repeated rows are harmless here: plans are counted distinct.
    placed = plans.join(
        entries.where(F.col("tier_level_value").isNotNull()).select(
            *DRUG, "drug_list_id", F.col("tier_level_value").alias("tier")
        ),
        "drug_list_id",
    ).select(*key, "plan_key", "tier")
    rules = t["beneficiary_costs"].where(
        (F.col("coverage_level") == 1) & (F.col("days_supply") == days_supply)
    ).select("plan_key", "tier", "cost_type_pref", "cost_amt_pref")
    amounts = placed.join(rules, ["plan_key", "tier"]).groupBy(
        *key, "cost_type_pref", "cost_amt_pref"
    ).agg(F.countDistinct("plan_key").alias("n"))
    kinds = {S.COPAY: "copay", S.COINSURANCE: "coinsurance", S.NO_CHARGE: "no_charge"}
    of = {k: F.col("cost_type_pref") == k for k in kinds}
    counted = amounts.groupBy(*key).agg(
        *[F.sum(F.when(of[k], F.col("n"))).alias(f"{name}_plans") for k, name in kinds.items()],
        mean(F.when(of[S.COPAY], F.col("cost_amt_pref"))).alias("mean_copay"),
        mean(F.when(of[S.COINSURANCE], F.col("cost_amt_pref"))).alias("mean_coinsurance"),
    )
    covering = plans.join(
        entries.select("rxcui", "drug_list_id").distinct(), "drug_list_id"
    ).groupBy("company", "rxcui").agg(F.countDistinct("plan_key").alias("covering_plans"))
    rows = _per_company(drugs, companies).join(counted, key, "left").join(
        covering, ["company", "rxcui"], "left"
    )
    rows = _zeros(rows, (*key, "dosage"))

    def share(name: str) -> Column:
        part = F.try_divide(F.col(f"{name}_plans") * F.lit(100.0), F.col("covering_plans"))
        return F.coalesce(rounded_even(part, 1), F.lit(0.0)).alias(f"{name}_pct")

    return rows.select(
        *key, "dosage",
        "copay_plans", share("copay"), rounded_even(F.col("mean_copay"), 2).alias("avg_copay"),
        "coinsurance_plans", share("coinsurance"),
        rounded_even(F.col("mean_coinsurance"), 1).alias("avg_coinsurance"),
        "no_charge_plans", share("no_charge"),
    )


# ---------------------------------------------------------------- companies and layout

def company_totals(t: Tables, companies: Sequence[str] = COMPANIES) -> DataFrame:
    """Drug lists and plan ids per contract name containing a company's name."""
    return (
        t["plan_information"].where(_names_any(F.col("contract_name"), companies))
        .groupBy("contract_name")
        .agg(
            F.countDistinct("drug_list_id").alias("total_drug_lists"),
            F.countDistinct("plan_id").alias("total_plans"),
        )
        .orderBy("contract_name")
    )


def _metric_structs(df: DataFrame, keys: Sequence[str], companies: Sequence[str]):
    """Metric columns, and per company an aggregate giving its metrics or zeros.

    The state per group is one struct per company, whatever the number of rows.
    """
    metrics = [f for f in df.schema.fields if f.name not in keys and f.name != "company"]
    numeric = (T.NumericType,)
    packed = F.struct(*[F.col(f.name) for f in metrics])
    zeros = F.struct(*[
        (F.lit(0) if isinstance(f.dataType, numeric) else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in metrics
    ])
    filled = [
        F.coalesce(F.max(F.when(F.col("company") == c, packed)), zeros).alias(c) for c in companies
    ]
    return metrics, filled


def fill_companies(
    df: DataFrame, keys: Sequence[str], companies: Sequence[str] = COMPANIES
) -> DataFrame:
    """A row for every key and company, with zero metrics where the input had none."""
    metrics, filled = _metric_structs(df, keys, companies)
    rows = df.groupBy(*keys).agg(F.array(*[
        F.struct(F.lit(c).alias("company"), cell.alias("m")) for c, cell in zip(companies, filled)
    ]).alias("cells"))
    return rows.select(*keys, F.explode("cells").alias("cell")).select(
        *keys, "cell.company", *[F.col(f"cell.m.{f.name}").alias(f.name) for f in metrics]
    )


def pivot_companies(
    df: DataFrame, keys: Sequence[str], companies: Sequence[str] = COMPANIES
) -> DataFrame:
    """One row per key with columns `<company>_<metric>`; absent companies read zero."""
    metrics, filled = _metric_structs(df, keys, companies)
    wide = df.groupBy(*keys).agg(*filled)
    return wide.select(*keys, *[
        F.col(f"{c}.{f.name}").alias(f"{c}_{f.name}") for c in companies for f in metrics
    ])


def nest_companies(
    df: DataFrame, keys: Sequence[str], companies: Sequence[str] = COMPANIES
) -> DataFrame:
    """One row per key with a map `companies`: name to metrics."""
    _, filled = _metric_structs(df, keys, companies)
    pairs = [x for c, cell in zip(companies, filled) for x in (F.lit(c), cell)]
    return df.groupBy(*keys).agg(F.create_map(*pairs).alias("companies"))
