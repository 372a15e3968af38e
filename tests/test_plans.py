"""Plan shapes: pushdown, pruning, no cross products, skewed joins split."""

import pytest
from pyspark.sql import functions as F

from tierscope.operators import costs, drug_list
from tierscope.plans.registry import QUERIES
from tierscope.sources.star import derive_tables
from tierscope.sources.tables import load_tables
from tierscope.sources.text import conform
from tierscope import schemas as S


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tables"))
    for name, df in derive_tables(spark, "/root/testdata/sf0.001").items():
        conform(df, S.SCHEMAS[name]).write.parquet(f"{root}/{name}/year=2025")
    return load_tables(spark, root, 2025)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(stored):
    plan = plan_of(drug_list.tier_drug_counts(stored, "00000005"))
    assert "EqualTo(drug_list_id,00000005)" in plan
    assert "ReadSchema: struct<drug_list_id:string,rxcui:bigint,tier_level_value:int>" in plan
    plan = plan_of(costs.member_annual_cost(stored, ["00000000028"]))
    assert "In(ndc, [00000000028])" in plan or "EqualTo(ndc,00000000028)" in plan
    assert "EqualTo(days_supply,30)" in plan


NO_PLANS = {  # queries that read back files they wrote
    "read_pipe", "read_pipe_latin1", "write_table", "write_pricing", "append_pricing",
    "load_tables", "load_tables_costs", "read_drug_names", "read_drug_dictionary", "export_csv", "refresh_drug_list_summary",
    "refresh_county_plan_summary", "read_pipe_zip", "read_zip_members",
    "load_tables_plans", "load_tables_places", "export_csv_table",
    "refresh_parts_drug_list_summary", "refresh_parts_county_plan_summary",
    "compact_pricing", "ingest_counts", "rejected_values",
    "colocated_specialty_margin", "colocated_contract_specialty_cost", "colocated_pricing_table",
}


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - NO_PLANS))
def test_defining_a_query_starts_no_job(spark, stored, name):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    QUERIES[name](stored)
    assert set(tracker.getJobIdsForGroup(None)) == before


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - NO_PLANS))
def test_no_cross_products(stored, name):
    plan = plan_of(QUERIES[name](stored))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan  # no row-at-a-time Python


def test_a_plan_with_a_third_of_the_prices_is_split(spark, tables):
    """One plan holds half of the prices: its join partition is split, rows stay whole."""
    t = tables(
        plan_information=[
            {"plan_key": f"P{i}", "contract_id": f"H{i % 3}", "drug_list_id": "F"}
            for i in range(40)
        ],
    )
    n = 60_000
    prices = spark.range(n, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, "P0")
        .otherwise(F.concat(F.lit("P"), (F.col("id") % 40).cast("string"))).alias("plan_key"),
        F.col("id").cast("string").alias("ndc"),
        F.lit(30).alias("days_supply"),
        (F.col("id") % 100).cast("decimal(10,4)").alias("unit_cost"),
    )
    listed = spark.range(n).select(
        F.lit("F").alias("drug_list_id"), F.col("id").cast("string").alias("ndc"),
        F.lit(5).alias("tier_level_value"),
    )
    t = {**t, "drug_pricing": prices, "drug_list_drugs": listed}
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = costs.contract_specialty_cost(t)
        got = {r["contract_id"]: r["avg_cost"] for r in df.collect()}
        assert "skew=true" in plan_of(df)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    want = {
        r[0]: r[1] for r in prices.select(
            F.concat(
                F.lit("H"), (F.substring("plan_key", 2, 9).cast("int") % 3).cast("string")
            ).alias("c"), F.col("unit_cost").cast("double").alias("u"),
        ).groupBy("c").agg(F.avg("u")).collect()
    }
    assert got == pytest.approx(want)
