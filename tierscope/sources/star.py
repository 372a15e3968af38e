"""Drug-plan tables derived from the star-schema test tables (no plan data ships here)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope import schemas as S
from tierscope.functions.expr import label, plan_key

# Parent organization by contract number modulo 8.
PARENTS = {
    0: "Elevance Health", 1: "UnitedHealth Group", 2: "Humana Inc.", 3: "CVS Health",
    4: "Molina Healthcare", 5: "Centene Corp", 6: "Alignment Health",
}


# Columns used of each test table. With a schema given, opening a file costs no job.
STAR = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_nationkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey long, o_custkey long",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, "
    "l_extendedprice double",
}


class DerivedTables(Mapping):
    """The drug-plan tables by name; each is defined when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self._spark.read.schema(STAR[name]).parquet(f"{self._dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = _with_schema_columns(BUILDERS[name](self), S.SCHEMAS[name])
        return self._made[name]

    def __iter__(self):
        return iter(BUILDERS)

    def __len__(self) -> int:
        return len(BUILDERS)


@lru_cache(maxsize=8)
def derive_tables(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All drug-plan tables as lazy DataFrames over the Parquet files in sf_dir.

    The definitions, not the data, are kept for the session.
    """
    return DerivedTables(spark, sf_dir)


def _with_schema_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Adds the schema columns that the test tables cannot supply, as NULL."""
    absent = [f for f in schema.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent}) if absent else df


def _digits(value: Column, width: int) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _contract_id(plan_no: Column) -> Column:
    number = plan_no % 25
    letter = F.when(number % 5 == 3, "S").when(number % 5 == 4, "R").otherwise("H")
    return F.concat(letter, _digits(number, 4))


def _plan_no(key: str) -> Column:
    return F.floor(F.col(key) / 10).cast("long")


def _county_code(nation_key: str) -> Column:
    return F.concat(F.lit("29"), _digits(F.col(nation_key), 3))


def _plan_information(t: DerivedTables) -> DataFrame:
    nation = t.raw("nation")
    homes = nation.join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"),
        F.substring("r_name", 1, 2).alias("state"),
        _county_code("n_nationkey").alias("county_code"),
    )
    names = nation.select(
        F.col("n_nationkey").cast("long").alias("contract_no"), F.col("n_name").alias("nation_name")
    )
    no = F.col("plan_no")
    return (
        t.raw("customer")
        .select(_plan_no("c_custkey").alias("plan_no"), "c_nationkey")
        .withColumn("contract_no", no % 25)
        .join(names, "contract_no")
        .join(homes, "c_nationkey")
        .select(
            _contract_id(no).alias("contract_id"),
            _digits(no, 5).alias("plan_id"),
            F.lit("000").alias("segment_id"),
            F.when(F.col("contract_no") == 11, "Aetna Health")
            .otherwise(F.col("nation_name")).alias("contract_name"),
            F.concat(F.lit("Plan "), no.cast("string")).alias("plan_name"),
            F.when(no % 17 != 16, _digits(no % 20, 8)).alias("drug_list_id"),
            F.when(no % 13 != 12, (((no * 37) % 1909).cast("double") / 10.0).cast(S.MONEY))
            .alias("premium"),
            ((no * 59) % 591).cast(S.MONEY).alias("deductible"),
            (no % 5).cast("int").alias("snp"),
            "state",
            "county_code",
        )
        .withColumn("plan_key", plan_key())
    )


def _geographic_locator(t: DerivedTables) -> DataFrame:
    region = F.col("r_regionkey")
    return t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == region).select(
        _county_code("n_nationkey").alias("county_code"),
        F.col("r_name").alias("state_name"),
        F.col("n_name").alias("county_name"),
        _digits(region, 2).alias("ma_region_code"),
        F.concat(F.lit("MA "), "r_name").alias("ma_region_name"),
        _digits(region + 10, 2).alias("pdp_region_code"),
        F.concat(F.lit("PDP "), "r_name").alias("pdp_region_name"),
    )


def _drug_list_drugs(t: DerivedTables) -> DataFrame:
    listed = t.raw("lineitem").select(
        (F.col("l_suppkey") % 20).alias("drug_list_no"), F.col("l_partkey").alias("p_partkey")
    ).distinct()
    size, no = F.col("p_size"), F.col("drug_list_no")
    limited = size % 3 == 0
    return listed.join(t.raw("part"), "p_partkey").select(
        _digits(no, 8).alias("drug_list_id"),
        F.floor(F.col("p_partkey") / 2).cast("long").alias("rxcui"),
        _digits(F.col("p_partkey"), 11).alias("ndc"),
        ((F.col("p_partkey") + no) % 7 + 1).cast("int").alias("tier_level_value"),
        F.when(limited, "Y").otherwise("N").alias("quantity_limit_yn"),
        F.when(limited, size).alias("quantity_limit_amount"),
        F.when(limited, 30).alias("quantity_limit_days"),
        F.when((size + no) % 4 == 0, "Y").when((size + no) % 11 == 0, "365").otherwise("N")
        .alias("prior_authorization_yn"),
        F.when(F.col("p_type") == "ECONOMY", "Y").otherwise("N").alias("step_therapy_yn"),
    )


def _drug_pricing(t: DerivedTables) -> DataFrame:
    no = _plan_no("o_custkey")
    return (
        t.raw("lineitem")
        .join(t.raw("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            no.alias("plan_no"),
            "l_partkey",
            ((F.col("l_linenumber") % 3 + 1) * 30).cast("int").alias("days_supply"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("cost"),
        )
        .groupBy("plan_no", "l_partkey", "days_supply")
        .agg(F.min("cost").alias("unit_cost"))
        .select(
            F.concat(
                _contract_id(F.col("plan_no")), F.lit("|"), _digits(F.col("plan_no"), 5),
                F.lit("|000"),
            ).alias("plan_key"),
            _digits(F.col("l_partkey"), 11).alias("ndc"),
            "days_supply",
            "unit_cost",
        )
    )


def _beneficiary_costs(t: DerivedTables) -> DataFrame:
    """Tiers 1-7 by supply codes 1-3 for each plan."""
    tier, no = F.col("tier"), F.col("plan_id").cast("int")
    kind = (no + tier) % 3
    amount = F.when(kind == 0, (tier * 10).cast(S.RATE)).when(kind == 1, F.lit(0.25).cast(S.RATE))
    return (
        t["plan_information"].select("plan_key", "plan_id").distinct()
        .withColumn("tier", F.explode(F.sequence(F.lit(1), F.lit(7))))
        .withColumn("days_supply", F.explode(F.sequence(F.lit(1), F.lit(3))))
        .select(
            "plan_key",
            F.lit(1).alias("coverage_level"),
            "tier",
            "days_supply",
            kind.cast("int").alias("cost_type_pref"),
            F.coalesce(amount, F.lit(0).cast(S.RATE)).alias("cost_amt_pref"),
            F.when((no + tier) % 2 == 0, F.lit(300).cast(S.MONEY)).alias("cost_max_amt_pref"),
            F.when(tier == S.SPECIALTY_TIER, "Y").otherwise("N").alias("tier_specialty_yn"),
        )
    )


def _plan_enrollment(t: DerivedTables) -> DataFrame:
    members = t.raw("orders").groupBy(_plan_no("o_custkey").alias("plan_no")).agg(
        F.count("*").alias("enrollment")
    )
    no = F.col("plan_id").cast("long")
    return (
        t["plan_information"].select("contract_id", "plan_id", "plan_name", "contract_name").distinct()
        .where(no % 9 != 7)
        .withColumn("plan_no", no)
        .join(members, "plan_no")
        .select(
            F.col("contract_id").alias("contract_number"),
            "plan_id",
            "plan_name",
            label(F.col("plan_no") % 25 % 8, PARENTS, "Other Org").alias("parent_organization"),
            F.col("contract_name").alias("organization_marketing_name"),
            "enrollment",
        )
    )


def _contract_organizations(t: DerivedTables) -> DataFrame:
    return t["plan_enrollment"].groupBy("contract_number").agg(
        F.max("parent_organization").alias("parent_organization"),
        F.max("organization_marketing_name").alias("organization_marketing_name"),
        F.sum("enrollment").alias("enrollment"),
    )


def _drug_names(t: DerivedTables) -> DataFrame:
    form = F.when(F.col("p_partkey") % 4 < 2, " MG/ML Auto-Injector [").otherwise(" MG Oral Tablet [")
    text = F.concat(
        F.lit("0.5 ML "), "p_name", F.lit(" "), F.col("p_size").cast("string"), form, "p_brand",
        F.lit("]"),
    )
    return t.raw("part").groupBy(F.floor(F.col("p_partkey") / 2).cast("long").alias("rxcui")).agg(
        F.max(text).alias("description")
    )


BUILDERS = {
    "plan_information": _plan_information,
    "geographic_locator": _geographic_locator,
    "drug_list_drugs": _drug_list_drugs,
    "drug_pricing": _drug_pricing,
    "beneficiary_costs": _beneficiary_costs,
    "plan_enrollment": _plan_enrollment,
    "contract_organizations": _contract_organizations,
    "drug_names": _drug_names,
}
