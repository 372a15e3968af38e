"""Contracts, organizations and enrollment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.operators.geography import plans_in_area
from tierscope.operators.normalize import Tables, collapse_rows, collapsed_mean_premium


def organizations(t: Tables) -> DataFrame:
    """Organizations with their drug lists and plan x county rows."""
    return (
        t["plan_information"].where(F.col("contract_name").isNotNull())
        .groupBy(F.col("contract_name").alias("organization"))
        .agg(
            F.countDistinct("drug_list_id").alias("drug_list_count"),
            F.count("*").alias("plan_count"),
        )
        .orderBy(F.desc("plan_count"), "organization")
    )


def contract_list(t: Tables) -> DataFrame:
    """Contracts with organization names falling back to the contract name.

    Plans are counted per contract first, so the organization join sees one row per
    contract.
    """
    offered = collapse_rows(
        t["plan_information"].where(F.col("contract_id").isNotNull()),
        "contract_id", "contract_name", "drug_list_id", "plan_id", "state",
    )
    counted = offered.groupBy("contract_id").agg(
        F.max("contract_name").alias("contract_name"),
        F.countDistinct("drug_list_id").alias("drug_list_count"),
        F.countDistinct("plan_id").alias("plan_count"),
        F.countDistinct("state").alias("state_count"),
    )
    owners = t["contract_organizations"].withColumnRenamed(
        "contract_number", "contract_id"
    ).distinct()
    return counted.join(owners, "contract_id", "left").select(
        "contract_id",
        F.coalesce("parent_organization", "contract_name").alias("parent_organization"),
        F.coalesce("organization_marketing_name", "contract_name").alias("marketing_name"),
        "enrollment", "drug_list_count", "plan_count", "state_count",
    ).orderBy(F.desc("plan_count"), "contract_id")


def _enrolled_drug_list_plans(enrollment: DataFrame, t: Tables, *columns: str) -> DataFrame:
    """Enrollment rows matched to plan x county rows that have a drug list."""
    offered = t["plan_information"].where(F.col("drug_list_id").isNotNull()).select(
        F.col("contract_id").alias("contract_number"), "plan_id", "drug_list_id", *columns
    )
    if not columns:
        offered = offered.distinct()  # drops the county factor before the join
    return enrollment.where(F.col("contract_number").startswith("H")).join(
        offered, ["contract_number", "plan_id"]
    )


def orgs_by_enrollment(t: Tables, limit: int | None = None) -> DataFrame:
    """Parent organizations of H contracts by members in plans with a drug list.

    A plan with two drug lists counts its members twice.
    """
    enrolled = t["plan_enrollment"].where(
        F.col("enrollment").isNotNull() & F.col("parent_organization").isNotNull()
    )
    rows = _enrolled_drug_list_plans(enrolled, t).select(
        "parent_organization", "organization_marketing_name", "contract_number", "plan_id",
        "enrollment", "drug_list_id",
    ).distinct()
    ranked = rows.groupBy("parent_organization").agg(
        F.max("organization_marketing_name").alias("organization_marketing_name"),
        F.sum("enrollment").alias("total_enrollment"),
        F.countDistinct(F.concat("contract_number", F.lit("-"), "plan_id")).alias("plan_count"),
        F.countDistinct("contract_number").alias("contract_count"),
        F.countDistinct("drug_list_id").alias("drug_list_count"),
    ).orderBy(F.desc("total_enrollment"), "parent_organization")
    return ranked if limit is None else ranked.limit(limit)


def organization_plans(t: Tables, org: str) -> DataFrame:
    """H-contract plans of one parent organization, largest first."""
    enrolled = t["plan_enrollment"].where(F.col("parent_organization") == org)
    return (
        _enrolled_drug_list_plans(enrolled, t, "state")
        .groupBy(
            "contract_number", "plan_id", "parent_organization", "organization_marketing_name",
            "plan_name", "enrollment", "drug_list_id",
        )
        .agg(F.countDistinct("state").alias("state_count"))
        .select(
            "contract_number", "plan_id",
            F.concat("contract_number", F.lit("-"), "plan_id").alias("plan_full_id"),
            "parent_organization", "organization_marketing_name", "plan_name",
            F.coalesce("enrollment", F.lit(0)).alias("enrollment"),
            "drug_list_id", "state_count",
        )
        .orderBy(F.desc("enrollment"), "contract_number", "plan_id", "drug_list_id")
    )


def contract_drug_lists(t: Tables, contract_id: str) -> DataFrame:
    """Drug lists of a contract with plans, states and counties."""
    return (
        t["plan_information"].where(F.col("contract_id") == contract_id)
        .groupBy("drug_list_id")
        .agg(
            F.max("contract_name").alias("contract_name"),
            F.countDistinct("plan_id").alias("plan_count"),
            F.countDistinct("state").alias("state_count"),
            F.countDistinct("county_code").alias("county_count"),
        )
        .orderBy(F.desc("plan_count"), F.asc_nulls_last("drug_list_id"))
    )


def org_totals(t: Tables) -> DataFrame:
    """Totals over orgs_by_enrollment()."""
    return orgs_by_enrollment(t).agg(
        F.count("*").alias("organizations"),
        _total("total_enrollment").alias("total_enrollment"),
        _total("plan_count").alias("total_plans"),
        _total("contract_count").alias("total_contracts"),
    )


def search_orgs(t: Tables, term: str) -> DataFrame:
    """Organizations whose parent or marketing name contains a term, in any case."""
    term = term.lower()
    return orgs_by_enrollment(t).where(
        F.lower("parent_organization").contains(term)
        | F.lower("organization_marketing_name").contains(term)
    )


def organization_totals(t: Tables, org: str) -> DataFrame:
    """Totals over organization_plans()."""
    return organization_plans(t, org).agg(
        _total("enrollment").alias("total_enrollment"),
        F.count("*").alias("total_plans"),
        F.countDistinct("contract_number").alias("total_contracts"),
        F.countDistinct("drug_list_id").alias("total_drug_lists"),
    )


def contract_totals(t: Tables, contract_id: str) -> DataFrame:
    """Sum of plans, and the widest reach of any one drug list of the contract."""
    return contract_drug_lists(t, contract_id).agg(
        _total("plan_count").alias("total_plans"),
        F.coalesce(F.max("state_count"), F.lit(0)).alias("total_states"),
        F.coalesce(F.max("county_count"), F.lit(0)).alias("total_counties"),
    )


def _total(column: str):
    return F.coalesce(F.sum(column), F.lit(0))


def global_stats(t: Tables) -> DataFrame:
    """Distinct drug lists, plan ids, drug concepts and organizations."""
    drugs = t["drug_list_drugs"].agg(F.countDistinct("rxcui")).scalar()
    # Without the county factor, before rows are copied once per count.
    offered = t["plan_information"].select("drug_list_id", "plan_id", "contract_name").distinct()
    return offered.agg(
        F.countDistinct("drug_list_id").alias("total_drug_lists"),
        F.countDistinct("plan_id").alias("total_plans"),
        F.countDistinct("contract_name").alias("total_organizations"),
    ).withColumn("total_drugs", drugs)


def top_contracts(t: Tables, limit: int | None = None, area: str | None = None) -> DataFrame:
    """Contracts with the most plans, in a county or state if given."""
    rows = t["plan_information"] if area is None else plans_in_area(t, area)
    offered = collapse_rows(
        rows, "contract_id", "contract_name", "plan_key", "drug_list_id", "state"
    )
    counted = offered.groupBy("contract_id", "contract_name").agg(
        F.countDistinct("plan_key").alias("plans"),
        F.countDistinct("drug_list_id").alias("drug_lists"),
        collapsed_mean_premium().alias("avg_premium"),
        F.countDistinct("state").alias("states"),
    ).orderBy(F.desc("plans"), "contract_id", "contract_name")
    return counted if limit is None else counted.limit(limit)


def contract_comparison(t: Tables, limit: int | None = None) -> DataFrame:
    """Contracts by distinct plan ids, one name per contract."""
    offered = collapse_rows(
        t["plan_information"], "contract_id", "contract_name", "plan_id", "drug_list_id", "state"
    )
    counted = offered.groupBy("contract_id").agg(
        F.min("contract_name").alias("contract_name"),
        F.countDistinct("plan_id").alias("plans"),
        F.countDistinct("drug_list_id").alias("drug_lists"),
        collapsed_mean_premium().alias("avg_premium"),
        F.countDistinct("state").alias("states"),
    ).orderBy(F.desc("plans"), "contract_id")
    return counted if limit is None else counted.limit(limit)


def contract_types(t: Tables) -> DataFrame:
    """Contracts per type letter."""
    return (
        t["plan_information"].groupBy(F.substring("contract_id", 1, 1).alias("contract_type"))
        .agg(F.countDistinct("contract_id").alias("contracts"))
    )


def contract_offerings(t: Tables, limit: int | None = None) -> DataFrame:
    """Contracts by plan x county rows."""
    counted = t["plan_information"].groupBy("contract_id").agg(
        F.count("*").alias("plan_count")
    ).orderBy(F.desc("plan_count"), "contract_id")
    return counted if limit is None else counted.limit(limit)
