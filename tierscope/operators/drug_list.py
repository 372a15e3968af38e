"""Drug lists: who uses them, what they list and how they restrict it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.aggregates import count_items
from tierscope.functions.expr import (
    count_if,
    label,
    mean,
    percent,
    percent_or_zero,
    restriction_label,
    restriction_codes,
    tier_name,
    yes,
)
from tierscope.functions.params import one_row
from tierscope.operators.normalize import Tables, collapse_rows

SPECIALTY_TIERS = (5, 6)


def _plans_of(t: Tables, drug_list_id: str) -> DataFrame:
    return t["plan_information"].where(F.col("drug_list_id") == drug_list_id)


def _drugs_of(t: Tables, drug_list_id: str) -> DataFrame:
    return t["drug_list_drugs"].where(F.col("drug_list_id") == drug_list_id)


def _tier() -> Column:
    return F.col("tier_level_value").alias("tier")


def _first(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


# ---------------------------------------------------------------- lists

def drug_list_list(t: Tables, org: str | None = None) -> DataFrame:
    """Drug lists by plan x county rows, optionally of contract names containing org."""
    rows = t["plan_information"].where(F.col("drug_list_id").isNotNull())
    if org:
        rows = rows.where(F.col("contract_name").contains(org))
    names = collapse_rows(rows, "drug_list_id", "contract_name", "state")
    return names.groupBy("drug_list_id").agg(
        F.countDistinct("contract_name").alias("org_count"),
        F.max("contract_name").alias("parent_org"),
        F.sum("n").alias("plan_count"),
        F.countDistinct("state").alias("state_count"),
    ).orderBy(F.desc("plan_count"), "drug_list_id")


def _shown(name: str, chars: int | None) -> Column:
    """A name for display, cut to a number of characters if one is given."""
    return F.col(name) if chars is None else F.left(F.col(name), F.lit(chars))


def drug_list_orgs(t: Tables, chars: int | None = None) -> DataFrame:
    """Drug lists with their organization names as one text, for display maybe cut.

    Names are made distinct per drug list before they are gathered, so a gathered
    list is as long as the text it becomes, whatever the number of plan rows.
    """
    rows = t["plan_information"].where(F.col("drug_list_id").isNotNull())
    per_name = rows.groupBy("drug_list_id", "contract_name").agg(F.count("*").alias("n"))
    return (
        per_name.groupBy("drug_list_id").agg(
            F.count("contract_name").alias("org_count"),
            F.concat_ws(", ", F.array_sort(F.collect_set(_shown("contract_name", chars)))).alias("organizations"),
            F.sum("n").alias("plan_count"),
        )
        .orderBy(F.desc("plan_count"), "drug_list_id")
    )


def org_prefixes(t: Tables, chars: int | None = None) -> DataFrame:
    """Organization names, each with the text to display, which may be cut."""
    return (
        t["plan_information"].where(F.col("contract_name").isNotNull())
        .select("contract_name").distinct()
        .select(F.col("contract_name").alias("org"), _shown("contract_name", chars).alias("shown"))
        .orderBy("org")
    )


def drug_lists_of_org(t: Tables, org: str) -> DataFrame:
    """Drug lists used by the organization of this name."""
    return (
        t["plan_information"].where(F.col("contract_name") == org)
        .select("drug_list_id").distinct()
    )


# ---------------------------------------------------------------- summary of one drug list

def drug_list_parent(t: Tables, drug_list_id: str) -> DataFrame:
    """Contract and parent organization with the most plan x county rows."""
    enrolled = t["plan_enrollment"].select(
        F.col("contract_number").alias("contract_id"), "plan_id", "parent_organization"
    )
    return (
        _plans_of(t, drug_list_id).join(enrolled, ["contract_id", "plan_id"], "left")
        .groupBy("contract_id", "parent_organization", "contract_name")
        .agg(F.count("*").alias("n"), F.countDistinct("contract_name").alias("entity_count"))
        .withColumn("parent_org", F.coalesce("parent_organization", "contract_name"))
        .orderBy(F.desc("n"), F.asc_nulls_last("contract_id"), F.asc_nulls_last("parent_org"))
        .limit(1)
        .select("contract_id", "parent_org", "entity_count")
    )


def tier_drug_counts(t: Tables, drug_list_id: str) -> DataFrame:
    """Distinct drug concepts per tier."""
    return (
        _drugs_of(t, drug_list_id).groupBy(_tier())
        .agg(F.countDistinct("rxcui").alias("drug_count"))
        .orderBy(F.asc_nulls_last("tier"))
    )


def restriction_counts(t: Tables, drug_list_id: str) -> DataFrame:
    """Rows under each restriction, next to the number of distinct drug concepts."""
    return _drugs_of(t, drug_list_id).agg(
        count_if(yes("prior_authorization_yn")).alias("prior_auth_count"),
        count_if(yes("step_therapy_yn")).alias("step_therapy_count"),
        count_if(yes("quantity_limit_yn")).alias("quantity_limit_count"),
        F.countDistinct("rxcui").alias("total_drugs"),
    )


def drug_list_geography(t: Tables, drug_list_id: str) -> DataFrame:
    """Distinct plan ids, states and counties."""
    return _plans_of(t, drug_list_id).agg(
        F.countDistinct("plan_id").alias("plan_count"),
        F.countDistinct("state").alias("state_count"),
        F.countDistinct("county_code").alias("county_count"),
    )


def cost_sample(t: Tables, drug_list_id: str, limit: int | None = None) -> DataFrame:
    """Cost rules, at initial coverage, of the drug list's plan x county rows; the first few
    if there is a limit."""
    rules = (
        t["beneficiary_costs"].where(F.col("coverage_level") == 1)
        .join(_plans_of(t, drug_list_id).select("plan_key"), "plan_key")
        .orderBy("plan_key", "tier", "days_supply")
    )
    return _first(rules, limit).select(
        "tier",
        F.col("cost_type_pref").alias("retail_cost_type"),
        F.col("cost_amt_pref").alias("retail_cost_amt"),
        F.col("cost_type_mail_pref").alias("mail_cost_type"),
        F.col("cost_amt_mail_pref").alias("mail_cost_amt"),
        "tier_specialty_yn",
    )


def specialty_counts(t: Tables, drug_list_id: str) -> DataFrame:
    """Distinct specialty drug concepts (tiers 5-6) and their prior-authorization rows."""
    return (
        _drugs_of(t, drug_list_id).where(F.col("tier_level_value").isin(*SPECIALTY_TIERS))
        .agg(
            F.countDistinct("rxcui").alias("specialty_drug_count"),
            count_if(yes("prior_authorization_yn")).alias("specialty_pa_count"),
        )
    )


def tier_share(
    t: Tables, drug_list_id: str, names: Mapping[int, str] = S.TIER_NAMES_PAGE
) -> DataFrame:
    """Percent of the drug list's drug concepts in each tier.

    A concept in two tiers counts in both, in the total as well.
    """
    counts = tier_drug_counts(t, drug_list_id)
    total = counts.agg(F.sum("drug_count")).scalar()
    other = F.concat(F.lit("Tier "), F.col("tier").cast("string"))
    return counts.select(
        "tier",
        label(F.col("tier"), names, other).alias("tier_name"),
        "drug_count",
        percent_or_zero(F.col("drug_count"), total).alias("pct_of_drug_list"),
    )


def restriction_share(t: Tables, drug_list_id: str) -> DataFrame:
    """Restricted rows as percent of distinct drug concepts; may exceed 100."""
    names = {
        "prior_auth_count": "Prior Authorization",
        "step_therapy_count": "Step Therapy",
        "quantity_limit_count": "Quantity Limits",
    }
    counts = restriction_counts(t, drug_list_id)
    long = counts.unpivot("total_drugs", list(names), "measure", "drug_count")
    return long.select(
        label(F.col("measure"), names, "Other").alias("restriction"),
        F.coalesce("drug_count", F.lit(0)).alias("drug_count"),
        percent_or_zero(F.col("drug_count"), F.col("total_drugs")).alias("pct_of_drugs"),
    )


def specialty_pa_share(t: Tables, drug_list_id: str) -> DataFrame:
    """Percent of specialty drugs under prior authorization."""
    return specialty_counts(t, drug_list_id).withColumn(
        "pa_pct",
        percent_or_zero(F.col("specialty_pa_count"), F.col("specialty_drug_count")),
    )


def drug_list_states(t: Tables, drug_list_id: str) -> DataFrame:
    """Plans and average premium and deductible per state."""
    return _plans_of(t, drug_list_id).groupBy("state").agg(
        F.countDistinct("plan_id").alias("plan_count"),
        mean("premium").alias("avg_premium"),
        mean("deductible").alias("avg_deductible"),
    ).orderBy(F.desc("plan_count"), F.asc_nulls_last("state"))


def drug_list_overview(t: Tables, drug_list_id: str) -> DataFrame:
    """Plans, drugs, specialty drugs and states in one row."""
    drugs = one_row(
        count_items(
            _drugs_of(t, drug_list_id), [], "ndc", "total_drugs",
            {"specialty_drugs": F.col("tier_level_value") == S.SPECIALTY_TIER},
        )
    )
    used = F.col("plan_rows") > 0  # drugs count only for a drug list that some plan uses
    return _plans_of(t, drug_list_id).agg(
        F.count("*").alias("plan_rows"),
        F.countDistinct("plan_key").alias("plans_using"),
        F.countDistinct("state").alias("states_covered"),
    ).select(
        F.lit(drug_list_id).alias("drug_list_id"),
        "plans_using",
        F.when(used, drugs["total_drugs"]).otherwise(F.lit(0)).alias("total_drugs"),
        F.when(used, drugs["specialty_drugs"]).otherwise(F.lit(0)).alias("specialty_drugs"),
        "states_covered",
    )


# ---------------------------------------------------------------- plans of one drug list

def drug_list_plans(t: Tables, drug_list_id: str, limit: int | None = None) -> DataFrame:
    """Plans using a drug list with the counties they cover, cheapest first."""
    listed = _plans_of(t, drug_list_id).groupBy(
        "plan_key", "contract_id", "plan_id", "contract_name", "plan_name", "premium",
        "deductible", F.col("snp").alias("snp_type"),
    ).agg(F.countDistinct("county_code").alias("counties_covered")).orderBy(
        F.asc_nulls_last("premium"), F.asc_nulls_last("deductible"), "plan_key"
    ).drop("plan_key")
    return _first(listed, limit)


def drug_list_plan_rows(t: Tables, drug_list_id: str) -> DataFrame:
    """Plan x county rows of a drug list by organization and plan name."""
    return _plans_of(t, drug_list_id).orderBy(
        "contract_name", "plan_name", "plan_key", "county_code"
    ).select(
        F.col("contract_name").alias("parent_organization"), "contract_id", "plan_id",
        "plan_name", "premium", "deductible", "state", F.col("snp").alias("snp_type"),
    )


def drug_list_plan_metrics(t: Tables, drug_list_id: str) -> DataFrame:
    """Plan x county rows, average premium and deductible, distinct states."""
    return _plans_of(t, drug_list_id).agg(
        F.count("*").alias("plan_count"),
        mean("premium").alias("avg_premium"),
        mean("deductible").alias("avg_deductible"),
        F.countDistinct("state").alias("state_count"),
    )


def drug_list_parent_orgs(t: Tables, drug_list_id: str, limit: int | None = None) -> DataFrame:
    """Organizations using a drug list by plan x county rows."""
    counted = _plans_of(t, drug_list_id).groupBy("contract_name").agg(
        F.count("*").alias("plan_count")
    ).orderBy(F.desc("plan_count"), F.asc_nulls_last("contract_name"))
    return _first(counted, limit)


# ---------------------------------------------------------------- drugs of one drug list

def drug_list_drugs_list(
    t: Tables,
    drug_list_id: str,
    tier: int | None = None,
    specialty_only: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Drugs of a drug list by tier and concept; the first 1000 unless told otherwise."""
    rows = _drugs_of(t, drug_list_id)
    if tier is not None:
        rows = rows.where(F.col("tier_level_value") == tier)
    if specialty_only:
        rows = rows.where(F.col("tier_level_value").isin(*SPECIALTY_TIERS))
    listed = rows.select(
        "rxcui", "ndc", _tier(), "prior_authorization_yn", "step_therapy_yn", "quantity_limit_yn"
    ).orderBy(
        F.asc_nulls_last("tier"), F.asc_nulls_last("rxcui"), F.asc_nulls_last("ndc"),
        "prior_authorization_yn", "step_therapy_yn", "quantity_limit_yn",
    )
    return _first(listed, limit)


def tier_summary(
    t: Tables, drug_list_id: str, names: Mapping[int, str] = S.TIER_NAMES
) -> DataFrame:
    """Rows per tier, and how many of them are restricted."""
    return _drugs_of(t, drug_list_id).groupBy(_tier()).agg(
        F.count("*").alias("drug_count"),
        count_if(yes("prior_authorization_yn")).alias("with_prior_auth"),
        count_if(yes("quantity_limit_yn")).alias("with_qty_limits"),
        count_if(yes("step_therapy_yn")).alias("with_step_therapy"),
    ).select(
        "tier",
        tier_name(F.col("tier"), names).alias("tier_name"),
        "drug_count", "with_prior_auth", "with_qty_limits", "with_step_therapy",
    ).orderBy(F.asc_nulls_last("tier"))


def drug_list_drug_details(t: Tables, drug_list_id: str) -> DataFrame:
    """Distinct drug entries with the tier in words and the number of equal rows."""
    return _drugs_of(t, drug_list_id).groupBy(
        "ndc", "rxcui", _tier(), "quantity_limit_yn", "quantity_limit_amount",
        "quantity_limit_days", "prior_authorization_yn", "step_therapy_yn",
    ).agg(F.count("*").alias("drug_list_count")).withColumn(
        "tier_description", tier_name(F.col("tier"), S.TIER_NAMES_SHORT)
    ).orderBy(F.asc_nulls_last("tier"), F.asc_nulls_last("ndc"), F.asc_nulls_last("rxcui"))


def specialty_drugs(
    t: Tables,
    drug_list_id: str,
    tiers: Sequence[int] = (S.SPECIALTY_TIER,),
    limit: int | None = None,
) -> DataFrame:
    """Drug rows in the specialty tiers by NDC."""
    rows = _drugs_of(t, drug_list_id).where(F.col("tier_level_value").isin(*tiers)).select(
        "ndc", "rxcui", _tier(), "quantity_limit_yn", "quantity_limit_amount",
        "prior_authorization_yn", "step_therapy_yn",
    ).orderBy(F.asc_nulls_last("ndc"), F.asc_nulls_last("rxcui"), "tier")
    return _first(rows, limit)


def specialty_drug_groups(
    t: Tables, drug_list_id: str, tiers: Sequence[int] = SPECIALTY_TIERS
) -> DataFrame:
    """Distinct specialty drugs with their restrictions in words."""
    grouped = _drugs_of(t, drug_list_id).where(
        F.col("tier_level_value").isin(*tiers)
    ).groupBy(
        "rxcui", "ndc", _tier(), "quantity_limit_yn", "prior_authorization_yn", "step_therapy_yn"
    ).agg(F.countDistinct("ndc").alias("ndc_count"))
    return with_restriction_label(grouped).orderBy(
        F.asc_nulls_last("rxcui"), F.asc_nulls_last("ndc"), "tier"
    )


def specialty_drug_metrics(
    t: Tables, drug_list_id: str, tiers: Sequence[int] = SPECIALTY_TIERS
) -> DataFrame:
    """Number of distinct specialty drugs, and of those under prior authorization."""
    return specialty_drug_groups(t, drug_list_id, tiers).agg(
        F.count("*").alias("specialty_drugs"),
        F.coalesce(count_if(yes("prior_authorization_yn")), F.lit(0)).alias("requiring_prior_auth"),
    )


def with_restriction_label(df: DataFrame) -> DataFrame:
    """Adds `restrictions`, such as `Qty Limit, Prior Auth` or `None`."""
    return df.withColumn("restrictions", restriction_label())


def with_restriction_codes(df: DataFrame) -> DataFrame:
    """Adds `restrictions` in short form, such as `PA QL` or `-`."""
    return df.withColumn("restrictions", restriction_codes())


def drug_list_drugs_sample_plan(t: Tables, drug_list_id: str, days: int = 30) -> DataFrame:
    """Drugs of a drug list with price and cost share in one of its plans.

    The plan is the first by key, found by a scalar subquery; both lookups are then
    filtered to that plan before they join.
    """
    plan = _plans_of(t, drug_list_id).agg(F.min("plan_key")).scalar()
    prices = t["drug_pricing"].where(
        (F.col("plan_key") == plan) & (F.col("days_supply") == days)
    ).select("ndc", "unit_cost")
    costs = t["beneficiary_costs"].where(
        (F.col("plan_key") == plan) & (F.col("coverage_level") == 1) & (F.col("days_supply") == 1)
    ).select("tier", "cost_type_pref", "cost_amt_pref", "cost_max_amt_pref")
    return (
        _drugs_of(t, drug_list_id).where(plan.isNotNull())
        .select(
            "ndc", "rxcui", _tier(), "quantity_limit_yn", "prior_authorization_yn",
            "step_therapy_yn",
        )
        .join(prices, "ndc", "left")
        .join(costs, "tier", "left")
        .orderBy(F.asc_nulls_last("tier"), F.asc_nulls_last("ndc"))
    )


# ---------------------------------------------------------------- across drug lists

def drug_list_sizes(t: Tables, limit: int | None = None) -> DataFrame:
    """Largest drug lists with their share of specialty drugs."""
    sized = count_items(
        t["drug_list_drugs"], ["drug_list_id"], "ndc", "total_drugs",
        {"specialty_drugs": F.col("tier_level_value") == S.SPECIALTY_TIER},
    ).withColumn("pct_specialty", percent(F.col("specialty_drugs"), F.col("total_drugs")))
    return _first(sized.orderBy(F.desc("total_drugs"), F.asc_nulls_last("drug_list_id")), limit)


def restrictiveness(t: Tables) -> DataFrame:
    """Percent of each drug list's drugs under prior authorization, step therapy and limits.

    Any authorization code other than N counts, numbers of days included.
    """
    used = t["plan_information"].select("drug_list_id").distinct()
    counted = count_items(
        t["drug_list_drugs"], ["drug_list_id"], "ndc", "total_drugs",
        {
            "specialty_drugs": F.col("tier_level_value") == S.SPECIALTY_TIER,
            "with_pa": F.col("prior_authorization_yn") != "N",
            "with_st": yes("step_therapy_yn"),
            "with_ql": yes("quantity_limit_yn"),
        },
    )
    total = F.col("total_drugs")
    # Joined after counting: one row per drug list instead of every drug row.
    return counted.join(used, "drug_list_id", "left_semi").select(
        "drug_list_id", "total_drugs", "specialty_drugs",
        percent(F.col("with_pa"), total).alias("pct_with_pa"),
        percent(F.col("with_st"), total).alias("pct_with_step_therapy"),
        percent(F.col("with_ql"), total).alias("pct_with_qty_limits"),
    ).orderBy(F.desc("pct_with_pa"), "drug_list_id")


def restrictiveness_rows(t: Tables) -> DataFrame:
    """The same share of prior authorization by rows instead of distinct drugs."""
    return t["drug_list_drugs"].groupBy("drug_list_id").agg(
        F.count("*").alias("total_drugs"),
        count_if(F.col("prior_authorization_yn") != "N").alias("drugs_with_pa"),
    ).withColumn(
        "pct_with_pa", percent(F.col("drugs_with_pa"), F.col("total_drugs"))
    ).orderBy(F.desc("pct_with_pa"), F.asc_nulls_last("drug_list_id"))
