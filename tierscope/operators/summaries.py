"""Summary tables kept next to the base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.aggregates import count_items
from tierscope.functions.expr import mean
from tierscope.operators.normalize import Tables


def drug_counts(drugs: DataFrame) -> DataFrame:
    """Distinct drugs and specialty drugs per drug list."""
    return count_items(
        drugs, ["drug_list_id"], "ndc", "total_drugs",
        {"specialty_drugs": F.col("tier_level_value") == S.SPECIALTY_TIER},
    )


def drug_list_summary(t: Tables) -> DataFrame:
    """Drugs, specialty drugs and plans of every drug list named by a plan.

    Both sides are counted before they meet, so no drug list is expanded into
    drugs x plans rows.
    """
    used = (
        t["plan_information"].where(F.col("drug_list_id").isNotNull())
        .groupBy("drug_list_id").agg(F.countDistinct("plan_key").alias("plans_using"))
    )
    return used.join(drug_counts(t["drug_list_drugs"]), "drug_list_id", "left").select(
        "drug_list_id",
        F.lit(None).cast("string").alias("drug_list_version"),
        F.coalesce("total_drugs", F.lit(0)).alias("total_drugs"),
        F.coalesce("specialty_drugs", F.lit(0)).alias("specialty_drugs"),
        "plans_using",
    )


def county_plan_summary(t: Tables) -> DataFrame:
    """Plans and premiums per known county; the average weighs plan x county rows.

    Counties are aggregated before the geography join, which then handles one row
    per county.
    """
    per_county = t["plan_information"].where(F.col("plan_key").isNotNull()).groupBy(
        "county_code"
    ).agg(
        F.countDistinct("plan_key").alias("plan_count"),
        mean("premium").alias("avg_premium"),
        F.min("premium").alias("min_premium"),
        F.max("premium").alias("max_premium"),
    )
    places = t["geographic_locator"].select("county_code", "state_name", "county_name")
    return per_county.join(places, "county_code").select(
        "county_code", "state_name", "county_name", "plan_count", "avg_premium",
        "min_premium", "max_premium",
    )


SUMMARIES = {
    "drug_list_summary": drug_list_summary,
    "county_plan_summary": county_plan_summary,
}


def refresh(t: Tables, directory: str) -> dict[str, DataFrame]:
    """Rewrites the summary tables under a directory and returns them as read back."""
    spark = t["plan_information"].sparkSession
    refreshed = {}
    for name, build in SUMMARIES.items():
        path = f"{directory.rstrip('/')}/{name}"
        build(t).write.mode("overwrite").parquet(path)
        refreshed[name] = spark.read.parquet(path)
    return refreshed
