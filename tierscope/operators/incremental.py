"""Summary tables refreshed from new parts of the base tables only.

A part is a year or a delivery. Its state is small and can be merged: for each drug list and
county the distinct items as bits of 64-bit words, and sums, counts, least and largest of
premiums. A summary is the merge of the states of all parts; counts of distinct items stay
exact, because bits are OR-ed. An item's bit is its code in a dictionary that only grows.

State and dictionary are directories behind a log (`sources.manifest`): a refresh becomes visible
in one step, and a part given again takes the place of its former state.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.operators.normalize import Tables
from tierscope.sources import tables
from tierscope.sources.manifest import Manifest

BUCKETS = 256  # of the dictionary; codes are given in each on its own
WORD_BITS = 64
STATES = {
    "drugs": "drug_list_id string, bucket int, word bigint, items bigint, specialty bigint",
    "users": "drug_list_id string, bucket int, word bigint, items bigint",
    "county_plans": "county_code string, bucket int, word bigint, items bigint",
    "premiums": "county_code string, total decimal(28,2), n bigint, least decimal(10,2), "
    "largest decimal(10,2)",
}
CODES = {"ndc": "drugs", "plan_key": "plans"}  # item column, name of its dictionary
CODE_SCHEMA = "value string, bucket int, seq bigint"


class State:
    """The stored state of summaries below a directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.path = spark, f"{directory.rstrip('/')}/state"
        self.log = Manifest(spark, self.path)
        _, self.live = self.log.read()
        self.added: set[str] = set()

    def parts(self) -> set[str]:
        """Names of the parts that the state holds."""
        return {d.split("/")[1].rsplit("-", 1)[0] for d in self.live if d.startswith("premiums/")}

    def read(self, name: str, schema: str) -> DataFrame:
        """A state or dictionary, of live directories and those added by this refresh."""
        paths = sorted(
            f"{self.path}/{d}" for d in self.live | self.added if d.startswith(f"{name}/")
        )
        return self.spark.read.schema(schema).parquet(*paths) if paths else (
            self.spark.createDataFrame([], schema)
        )

    def add(self, name: str, part: str, rows: DataFrame) -> None:
        place = f"{name}/{part}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{place}")
        self.added.add(place)

    def commit(self, parts: Iterable[str]) -> None:
        """Makes what was added live, in place of the parts' former states."""
        again, read, added = set(parts), self.live, self.added

        def change(live: set[str]) -> set[str]:
            if live != read:  # codes might be given twice
                raise RuntimeError(f"{self.path}: another refresh came first; run this one again")
            kept = {
                d for d in live
                if d.split("/")[0] not in STATES or d.split("/")[1].rsplit("-", 1)[0] not in again
            }
            return kept | added

        self.live, self.added = self.log.commit(change), set()


def _coded(state: State, part: str, rows: DataFrame, item: str) -> DataFrame:
    """The rows with `bucket`, `word` and `bit` of an item; new items get codes first.

    A missing item is bit 0, which sets nothing.
    """
    name = f"codes_{CODES[item]}"
    known = state.read(name, CODE_SCHEMA)
    bucket = F.pmod(F.xxhash64("value"), F.lit(BUCKETS)).cast("int")
    new = (
        rows.where(F.col(item).isNotNull()).select(F.col(item).alias("value")).distinct()
        .join(known, "value", "left_anti").withColumn("bucket", bucket)
    )
    used = known.groupBy("bucket").agg(F.max("seq").alias("used"))  # BUCKETS rows at most
    order = Window.partitionBy("bucket").orderBy("value")
    state.add(name, part, new.withColumn("rank", F.row_number().over(order)).join(
        used, "bucket", "left"
    ).select("value", "bucket", (F.coalesce("used", F.lit(-1)) + F.col("rank")).alias("seq")))
    codes = state.read(name, CODE_SCHEMA).withColumnRenamed("value", item)
    shifted = F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), (F.col("seq") % WORD_BITS).cast("int")
    )
    return rows.join(codes, item, "left").withColumns({
        "bucket": F.coalesce("bucket", F.lit(0)),
        "word": F.coalesce(F.floor(F.col("seq") / WORD_BITS), F.lit(0)).cast("bigint"),
        "bit": F.coalesce(shifted, F.lit(0).cast("bigint")),
    })


def _add_part(state: State, part: str, t: Tables) -> None:
    drugs = _coded(state, part, t["drug_list_drugs"].select(
        "drug_list_id", "ndc", "tier_level_value"
    ), "ndc")
    special = F.when(F.col("tier_level_value") == S.SPECIALTY_TIER, F.col("bit"))
    state.add("drugs", part, drugs.groupBy("drug_list_id", "bucket", "word").agg(
        F.bit_or("bit").alias("items"),
        F.coalesce(F.bit_or(special), F.lit(0).cast("bigint")).alias("specialty"),
    ))
    plans = _coded(state, part, t["plan_information"].select(
        "plan_key", "drug_list_id", "county_code", "premium"
    ), "plan_key")
    state.add("users", part, plans.where(F.col("drug_list_id").isNotNull()).groupBy(
        "drug_list_id", "bucket", "word"
    ).agg(F.bit_or("bit").alias("items")))
    named = plans.where(F.col("plan_key").isNotNull())
    state.add("county_plans", part, named.groupBy("county_code", "bucket", "word").agg(
        F.bit_or("bit").alias("items")
    ))
    state.add("premiums", part, t["plan_information"].where(F.col("plan_key").isNotNull()).groupBy(
        "county_code"
    ).agg(
        F.sum("premium").cast("decimal(28,2)").alias("total"), F.count("premium").alias("n"),
        F.min("premium").alias("least"), F.max("premium").alias("largest"),
    ))


def _items(state: State, name: str, key: str, **columns: str) -> DataFrame:
    """Distinct items by key, from the bits of all parts."""
    merged = state.read(name, STATES[name]).groupBy(key, "bucket", "word").agg(
        *[F.bit_or(c).alias(c) for c in columns.values()]
    )
    return merged.groupBy(key).agg(*[
        F.sum(F.bit_count(c)).cast("bigint").alias(alias) for alias, c in columns.items()
    ])


def summaries_of(state: State, places: DataFrame) -> dict[str, DataFrame]:
    """The summary tables as `operators.summaries` has them, merged from a state."""
    drugs = _items(state, "drugs", "drug_list_id", total_drugs="items", specialty_drugs="specialty")
    lists = _items(state, "users", "drug_list_id", plans_using="items").join(
        drugs, "drug_list_id", "left"
    ).select(
        "drug_list_id", F.lit(None).cast("string").alias("drug_list_version"),
        F.coalesce("total_drugs", F.lit(0).cast("bigint")).alias("total_drugs"),
        F.coalesce("specialty_drugs", F.lit(0).cast("bigint")).alias("specialty_drugs"),
        "plans_using",
    )
    premiums = state.read("premiums", STATES["premiums"]).groupBy("county_code").agg(
        _mean(F.sum("total"), F.sum("n")).alias("avg_premium"),
        F.min("least").alias("min_premium"), F.max("largest").alias("max_premium"),
    )
    counties = _items(state, "county_plans", "county_code", plan_count="items").join(
        premiums, "county_code"
    ).join(places.select("county_code", "state_name", "county_name"), "county_code").select(
        "county_code", "state_name", "county_name", "plan_count", "avg_premium", "min_premium",
        "max_premium",
    )
    return {"drug_list_summary": lists, "county_plan_summary": counties}


def _mean(total: Column, n: Column) -> Column:
    return F.try_divide(total.cast("double"), n)


def refresh_parts(
    spark: SparkSession, parts: Mapping[str, Tables], places: DataFrame, directory: str
) -> dict[str, DataFrame]:
    """Adds parts, or puts them in place of what they were, and returns all summaries.

    `parts` maps names without `/` to the rows of plan_information and drug_list_drugs that are
    new; rows of parts that are not given are not read. `places` is geographic_locator. The
    result equals `summaries.drug_list_summary` and `county_plan_summary` over the rows of all
    parts together. With two refreshes at a time, the later one fails and changes nothing.
    """
    state = State(spark, directory)
    for part, t in parts.items():
        _add_part(state, part, t)
    state.commit(parts)
    return summaries_of(state, places)


def refresh_years(
    spark: SparkSession, root: str, directory: str, again: Iterable[int] = ()
) -> dict[str, DataFrame]:
    """As `refresh_parts`, for the years below root that the state doesn't hold, and those of
    `again`. Only their partitions are read. Places are those of the last year."""
    loaded = tables.load_tables(spark, root)
    years = {r[0] for r in loaded["plan_information"].select("year").distinct().collect()}
    new = {year for year in years if str(year) not in State(spark, directory).parts()}
    parts = {
        str(year): tables.snapshot(loaded, year) for year in sorted(new | set(again) & years)
    }
    places = tables.snapshot(loaded, max(years, default=0))["geographic_locator"]
    return refresh_parts(spark, parts, places, directory)
