"""Entity tables split from the plan x county table, and key checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.bitmaps import key_bitmap, maybe_in
from tierscope.functions.expr import label, rounded

Tables = Mapping[str, DataFrame]


def contracts(t: Tables) -> DataFrame:
    """Distinct contracts; the type is the first letter of the id."""
    return (
        t["plan_information"].select("contract_id", "contract_name").distinct()
        .withColumn("contract_type", F.substring("contract_id", 1, 1))
    )


def contract_type_name(contract_type):
    return label(contract_type, S.CONTRACT_TYPES, "Other")


def drug_lists(t: Tables, year: int = 2025) -> DataFrame:
    """Distinct drug lists. NULL is not an entity (the id is a primary key)."""
    return (
        t["plan_information"].where(F.col("drug_list_id").isNotNull())
        .select("drug_list_id").distinct()
        .withColumns({
            "drug_list_version": F.lit(None).cast("string"),
            "contract_year": F.lit(year),
        })
    )


def plans(t: Tables) -> DataFrame:
    """One row per distinct set of plan attributes, key first."""
    return t["plan_information"].select(
        "plan_key", "contract_id", "plan_id", "segment_id", "plan_name", "drug_list_id",
        "premium", "deductible", F.col("snp").alias("snp_type"), "plan_suppressed_yn",
    ).distinct()


def plan_columns(t: Tables, *columns: str) -> DataFrame:
    """One row per plan with only the named attributes.

    Plan attributes, contract name included, depend on plan_key alone, so narrowing
    before the distinct gives the rows of plans() joined to contracts() with a
    smaller shuffle and no join. Spark cannot prune columns below a distinct itself.
    """
    return t["plan_information"].where(F.col("plan_key").isNotNull()).select(
        "plan_key", *columns
    ).distinct()


def collapse_rows(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct values of some columns with `n` rows, `premiums` of them and `premium_sum`.

    Plan x county rows shrink by the number of counties here, in one hash aggregate,
    before an aggregate with several distinct counts copies each row per count, or one
    with a text maximum has to sort them.
    """
    return rows.groupBy(*columns).agg(
        F.count("*").alias("n"),
        F.count("premium").alias("premiums"),
        F.sum("premium").alias("premium_sum"),
    )


def collapsed_mean_premium() -> Column:
    """Average premium over the rows collapsed by collapse_rows()."""
    total = F.sum("premium_sum").cast("double")
    return rounded(F.try_divide(total, F.sum("premiums")), 2)


def plan_geography(t: Tables) -> DataFrame:
    """Plan x county rows, duplicates kept."""
    return t["plan_information"].select(
        "plan_key", F.col("state").alias("state_code"), "county_code", "ma_region_code",
        "pdp_region_code",
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values held by more than one row, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where(F.col("count") > 1)


def orphans(child: DataFrame, parent: DataFrame, on: Mapping[str, str]) -> DataFrame:
    """Child rows whose non-NULL key has no parent; `on` maps child to parent columns.

    The distinct keys of the child, combined in each task first, meet the parents; rows don't. Of
    the rows only those are shuffled that a bitmap of the keys without a parent leaves in, so
    what moves follows the orphans and not the child. A key is compared in the child's type.
    """
    parent_keys = parent.select(
        *[F.col(p).cast(child.schema[c].dataType).alias(f"parent_{c}") for c, p in on.items()]
    ).distinct()
    rows, keys = child, list(on)
    for column in on:
        rows = rows.where(F.col(column).isNotNull())
    lost = rows.select(*keys).distinct().join(
        parent_keys, [F.col(c) == F.col(f"parent_{c}") for c in on], "left_anti"
    )
    suspects = maybe_in(rows, keys, key_bitmap(lost, keys))
    # The keys are distinct. A semi join would be moved below the bitmap, and shuffle all rows.
    named = lost.select(*[F.col(c).alias(f"lost_{c}") for c in keys])
    same = [F.col(c) == F.col(f"lost_{c}") for c in keys]
    return suspects.join(named, same).select(*child.columns)


def declared_keys(t: Tables) -> DataFrame:
    """Of each declared key: how many of its values are held by more than one row."""
    checks = [
        duplicate_keys(t[table], keys).agg(F.count("*").alias("repeated")).select(
            F.lit(table).alias("table_name"), "repeated"
        )
        for table, keys in S.UNIQUE_KEYS.items()
    ]
    return reduce(DataFrame.unionByName, checks)


def declared_references(t: Tables) -> DataFrame:
    """Of each declared reference: how many rows name something that doesn't exist."""
    checks = [
        orphans(t[child], t[parent], {column: key}).agg(F.count("*").alias("orphans")).select(
            F.lit(f"{child}.{column}").alias("reference"), "orphans"
        )
        for child, column, parent, key in S.REFERENCES
    ]
    return reduce(DataFrame.unionByName, checks)
