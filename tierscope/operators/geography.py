"""Plans and competition in counties and states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.expr import label, mean2, rounded
from tierscope.operators.normalize import Tables
from tierscope.operators.summaries import county_plan_summary, drug_counts


def plans_in_area(t: Tables, term: str) -> DataFrame:
    """Plan x county rows of a county (five digits) or of a state (anything else)."""
    is_county = len(term) == 5 and term.isdigit()
    area = F.col("county_code") == term if is_county else F.col("state") == term.upper()
    return t["plan_information"].where(area)


def county_name(t: Tables, county_code: str) -> DataFrame:
    """State and county name of a county code."""
    return (
        t["geographic_locator"].where(F.col("county_code") == county_code)
        .orderBy("state_name", "county_name").limit(1).select("state_name", "county_name")
    )


def area_plan_count(t: Tables, term: str) -> DataFrame:
    """Distinct plans in an area."""
    return plans_in_area(t, term).agg(F.countDistinct("plan_key").alias("plans"))


def area_plans(t: Tables, term: str, limit: int | None = None) -> DataFrame:
    """Plans of an area, cheapest first."""
    listed = plans_in_area(t, term).select(
        "contract_id", "plan_id", "plan_name", "premium", "deductible", "drug_list_id",
        F.col("snp").alias("snp_type"),
    ).distinct().orderBy(
        F.asc_nulls_last("premium"), F.asc_nulls_last("deductible"), "contract_id", "plan_id",
        "plan_name", F.asc_nulls_last("drug_list_id"), F.asc_nulls_last("snp_type"),
    )
    return listed if limit is None else listed.limit(limit)


def area_premium_stats(t: Tables, term: str) -> DataFrame:
    """Premium and deductible statistics, each plan once."""
    return plans_in_area(t, term).select("plan_key", "premium", "deductible").distinct().agg(
        F.countDistinct("plan_key").alias("total_plans"),
        mean2("premium").alias("avg_premium"),
        F.min("premium").alias("min_premium"),
        F.max("premium").alias("max_premium"),
        mean2("deductible").alias("avg_deductible"),
    )


def area_drug_lists(t: Tables, term: str, limit: int | None = None) -> DataFrame:
    """Drug lists by plans in an area, with their drugs.

    The ranking needs plans only, so it is cut to the leaders before the drug table is
    read, and drugs are counted for those alone.
    """
    ranked = plans_in_area(t, term).groupBy("drug_list_id").agg(
        F.countDistinct("plan_key").alias("plans_in_area")
    ).orderBy(F.desc("plans_in_area"), F.asc_nulls_last("drug_list_id"))
    if limit is not None:
        ranked = ranked.limit(limit)
    drugs = drug_counts(
        t["drug_list_drugs"].join(ranked.select("drug_list_id"), "drug_list_id", "left_semi")
    )
    return ranked.join(drugs, "drug_list_id", "left").select(
        "drug_list_id", "plans_in_area",
        F.coalesce("total_drugs", F.lit(0)).alias("total_drugs"),
        F.coalesce("specialty_drugs", F.lit(0)).alias("specialty_drugs"),
    ).orderBy(F.desc("plans_in_area"), F.asc_nulls_last("drug_list_id"))


def area_snp(t: Tables, term: str) -> DataFrame:
    """Plans of an area per special-needs code, with the code in words."""
    return (
        plans_in_area(t, term).groupBy("snp")
        .agg(F.countDistinct("plan_key").alias("plan_count"))
        .select(label(F.col("snp"), S.SNP_NAMES, "Other").alias("plan_type"), "plan_count")
        .orderBy(F.desc("plan_count"), "plan_type")
    )


def county_plans(t: Tables, county_code: str) -> DataFrame:
    """Plan rows of a county with the specialty drugs of their drug list.

    The count is NULL for plans without a drug list, and 0 for an unlisted one. Only
    drug lists of this county are counted.
    """
    rows = t["plan_information"].where(
        (F.col("county_code") == county_code) & F.col("plan_key").isNotNull()
    )
    used = rows.where(F.col("drug_list_id").isNotNull()).select("drug_list_id").distinct()
    specialty = used.join(
        drug_counts(t["drug_list_drugs"].join(used, "drug_list_id", "left_semi")),
        "drug_list_id", "left",
    ).select("drug_list_id", F.coalesce("specialty_drugs", F.lit(0)).alias("specialty_drugs"))
    return rows.join(specialty, "drug_list_id", "left").select(
        "contract_id", "contract_name", "plan_id", "plan_name", "premium", "deductible",
        F.col("snp").alias("snp_type"), "drug_list_id", "specialty_drugs",
    ).orderBy(
        F.asc_nulls_last("premium"), F.asc_nulls_last("deductible"), "contract_id", "plan_id"
    )


def county_summary(t: Tables, county_code: str) -> DataFrame:
    """Plans and rounded premiums of one county."""
    return county_plan_summary(t).where(F.col("county_code") == county_code).select(
        "county_code", "state_name", "county_name", "plan_count",
        rounded(F.col("avg_premium"), 2).alias("avg_premium"),
        F.round("min_premium", 2).alias("min_premium"),
        F.round("max_premium", 2).alias("max_premium"),
    )


def county_competition(
    t: Tables, state_name: str | None = None, limit: int | None = None
) -> DataFrame:
    """Counties, of one state if given, with the most plans."""
    counties = county_plan_summary(t)
    if state_name is not None:
        counties = counties.where(F.col("state_name") == state_name)
    ranked = counties.select(
        "state_name", "county_name", "county_code", "plan_count",
        rounded(F.col("avg_premium"), 2).alias("avg_premium"),
    ).orderBy(F.desc("plan_count"), "county_code")
    return ranked if limit is None else ranked.limit(limit)
