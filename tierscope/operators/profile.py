"""Profiling of delivered tables, over all their rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.functions.expr import as_column, mean, percent
from tierscope.functions.params import one_row
from tierscope.operators.normalize import Tables

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
BRACKET = 2e-4  # a sketch narrows each quartile to ranks within this share of the rows
BINS, ROUNDS = 65_536, 2  # ranges that a bracket is cut into, and how often
SKETCH_ACCURACY = 20_000  # its rank error, 5e-5 of the rows, lies well inside the bracket


def plan_profile(t: Tables) -> DataFrame:
    """Rows and distinct contracts, plans and drug lists of the plan table."""
    # Without the county factor, before rows are copied once per count.
    offered = t["plan_information"].groupBy("contract_id", "plan_id", "drug_list_id").agg(
        F.count("*").alias("n")
    )
    return offered.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.countDistinct("contract_id").alias("contracts"),
        F.countDistinct(F.struct("contract_id", "plan_id")).alias("plans"),
        F.countDistinct("drug_list_id").alias("drug_lists"),
    )


def plan_sample(t: Tables, limit: int = 5) -> DataFrame:
    """The first plan x county rows by key."""
    return t["plan_information"].orderBy(
        "plan_key", "county_code", "contract_id", "plan_id"
    ).limit(limit).select(
        "contract_id", "plan_id", "contract_name", "premium", "deductible", "drug_list_id"
    )


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, deviation, range and exact quartiles of a numeric column.

    Quartiles interpolate linearly. A quantile sketch gives two values around each
    quartile. What lies between them is counted in BINS ranges of equal width, of which that with
    the wanted rank is taken; that is done ROUNDS times. A last pass over (value, count) rows adds
    up what lies below and keeps the values between, BINS ** ROUNDS times fewer than the sketch
    leaves if they are spread evenly. No task orders the column or holds more than the bins.
    """
    value = F.col(column).cast("double")
    edges = [q + side for q in QUARTILES.values() for side in (-BRACKET, BRACKET)]
    basics = df.agg(
        mean(F.col(column)).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.percentile_approx(value, edges, SKETCH_ACCURACY).alias("edges"),
    )
    row = one_row(basics)
    counts = df.where(F.col(column).isNotNull()).groupBy(value.alias("v")).agg(
        F.count("*").alias("n")
    )
    edges = row["edges"]
    for _ in range(ROUNDS):
        edges = narrowed(counts, edges).scalar()
    edge = F.col("edges")
    brackets = counts.withColumn("edges", edges).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), *[
        _bracket(edge[2 * i], edge[2 * i + 1]).alias(name)
        for i, name in enumerate(QUARTILES)
    ])
    quartiles = [
        _quantile(F.col(name), F.col("count"), q).alias(name) for name, q in QUARTILES.items()
    ]
    return brackets.select(
        "count",
        *[row[name].alias(name) for name in ("mean", "std", "min")],
        *quartiles,
        row["max"].alias("max"),
    )


def narrowed(counts: DataFrame, edges: Column) -> DataFrame:
    """One row `edges`: two values around each quartile, no further apart than those given.

    `counts` has distinct values v and their numbers of rows n.
    """
    edge, v = F.col("edges"), F.col("v")

    def place(low: Column, high: Column) -> Column:
        """The bin of a value; -1 below the two edges, BINS + 1 above them."""
        share = F.try_divide(v - low, high - low)
        inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BINS).cast("int"), F.lit(BINS))
        return F.when(v < low, -1).when(v > high, BINS + 1).otherwise(inside)

    places = F.array(*[
        F.struct(F.lit(i).alias("i"), place(edge[2 * i], edge[2 * i + 1]).alias("bin"))
        for i in range(len(QUARTILES))
    ])
    bins = counts.withColumn("edges", edges).select("v", "n", F.explode(places).alias("p")).groupBy(
        "p.i", "p.bin"
    ).agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = Window.partitionBy("i")  # as many rows as bins
    quartile = F.element_at(F.array(*[F.lit(q) for q in QUARTILES.values()]), F.col("i") + 1)
    ranked = bins.select(
        "i", "bin", "low", "high", F.sum("n").over(each.orderBy("bin")).alias("upto"),
        F.floor((F.sum("n").over(each) - 1) * quartile).alias("rank"),
        F.sum("n").over(each).alias("total"),
    )
    upper = F.least(F.col("rank") + 1, F.col("total") - 1)
    found = ranked.groupBy("i").agg(
        F.min(F.when(F.col("upto") > F.col("rank"), F.struct("bin", "low")))["low"].alias("low"),
        F.min(F.when(F.col("upto") > upper, F.struct("bin", "high")))["high"].alias("high"),
    )
    return found.agg(F.array(*[
        F.max(F.when(F.col("i") == i, F.col(side)))
        for i in range(len(QUARTILES)) for side in ("low", "high")
    ]).alias("edges"))


def _bracket(low: Column, high: Column) -> Column:
    """Aggregate: rows below low, and the (value, count) pairs from low to high.

    One neighbour on each side is included: the next rank may lie outside.
    """
    v, pair = F.col("v"), F.struct("v", "n")
    return F.struct(
        F.coalesce(F.sum(F.when(v < low, F.col("n"))), F.lit(0)).alias("below"),
        F.max(F.when(v < low, pair)).alias("left"),
        F.collect_list(F.when(v.between(low, high), pair)).alias("inside"),
        F.min(F.when(v > high, pair)).alias("right"),
    )


def _quantile(bracket: Column, total: Column, q: float) -> Column:
    """Exact quantile from a bracket known to enclose it."""
    left, right = bracket["left"], bracket["right"]
    pairs = F.array_compact(
        F.concat(F.array(left), F.array_sort(bracket["inside"]), F.array(right))
    )
    start = bracket["below"] - F.coalesce(left["n"], F.lit(0))
    none = F.lit(None).cast("double")

    def at(rank: Column) -> Column:
        """First value whose running count exceeds the rank (from 0)."""
        def step(seen, pair):
            upto = seen["upto"] + pair["n"]
            return F.struct(
                upto.alias("upto"),
                F.coalesce(seen["v"], F.when(upto > rank, pair["v"])).alias("v"),
            )

        return F.aggregate(pairs, F.struct(start.alias("upto"), none.alias("v")), step)["v"]

    position = (total - 1) * F.lit(q)
    floor = F.floor(position)
    lower, upper = at(floor), at(F.least(floor + 1, total - 1))
    return lower + (upper - lower) * (position - floor)


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, NULL included, with their percent of all rows, commonest first."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    ranked = counts.withColumn("pct", percent(F.col("count"), total, 2)).orderBy(
        F.desc("count"), F.asc_nulls_last("value")
    )
    return ranked if limit is None else ranked.limit(limit)


def specialty_example(t: Tables) -> DataFrame:
    """The first specialty drug listed, by drug list and code, with its restrictions."""
    return (
        t["drug_list_drugs"].where(F.col("tier_level_value") == S.SPECIALTY_TIER)
        .orderBy("drug_list_id", "ndc", "rxcui").limit(1)
        .select(
            "ndc", "drug_list_id", F.col("tier_level_value").alias("tier"),
            "prior_authorization_yn", "quantity_limit_yn",
        )
    )


def drug_price_range(t: Tables, ndc: str | Column) -> DataFrame:
    """Prices of a drug over plans and supplies: number, range and average."""
    return t["drug_pricing"].where(F.col("ndc") == as_column(ndc)).agg(
        F.count("*").alias("price_rows"),
        F.min("unit_cost").alias("min_cost"),
        F.max("unit_cost").alias("max_cost"),
        mean("unit_cost").alias("avg_cost"),
    )
