"""Times ingest and the headline queries at one scale.

The drug-plan tables are derived from the star-schema files and written as the
pipe-delimited text they are delivered as (not timed). Timed are: ingest of that text
into typed Parquet, and each query on those tables, from its definition to its last row
(noop sink).

Prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS (timed runs after one
warm-up; the median counts) may be set.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from tierscope import schemas
from tierscope.functions.params import scratch_path
from tierscope.plans.registry import QUERIES
from tierscope.session import build_session
from tierscope.sources.sinks import ingest, write_table
from tierscope.sources.star import derive_tables
from tierscope.sources.tables import load_tables
from tierscope.sources.text import conform

YEAR = 2025
DELIVERED = (
    "plan_information", "geographic_locator", "drug_list_drugs", "beneficiary_costs",
    "drug_pricing",
)
HEADLINE = (
    "specialty_margin", "contract_specialty_cost", "member_annual_cost", "tier_drugs_priced",
    "tier_page_summary", "county_specialty_costs", "contract_drug_costs", "specialty_pricing",
    "coverage_table", "pricing_table", "member_cost_table", "drug_list_summary",
    "county_plan_summary", "restrictiveness", "drug_list_sizes", "drug_list_overview",
    "drug_list_drugs_sample_plan", "specialty_coverage", "orgs_by_enrollment", "contract_list",
    "area_drug_lists", "county_plans", "drug_plans", "drug_dosages", "describe_unit_cost",
    "write_pricing",
)


def deliver(spark, sf_dir: str, root: str) -> dict[str, str]:
    """Writes the source text files, and as Parquet the tables that do not come as text."""
    sources = {}
    for name, df in derive_tables(spark, sf_dir).items():
        table = conform(df, schemas.SCHEMAS[name])
        if name not in DELIVERED:
            write_table(table, f"{root}/tables/{name}/year={YEAR}")
            continue
        if "plan_key" in table.columns and "segment_id" not in table.columns:
            parts = F.split("plan_key", r"\|")
            table = table.drop("contract_id", "plan_id").select(
                *[parts[i].alias(c) for i, c in enumerate(schemas.PLAN_KEY_PARTS)], "*"
            )
        sources[name] = f"{root}/text/{name}"
        table.drop("plan_key").repartition(8).write.option("sep", "|").option(
            "header", True
        ).csv(sources[name])
    return sources


def timed(action, runs: int) -> float:
    """Median seconds after one warm-up."""
    times = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        action()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", 8, **{
        "spark.driver.memory": "16g", "spark.ui.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    root = scratch_path(spark, "bench")
    sources = deliver(spark, sf_dir, root)
    pricing = {"drug_pricing": sources["drug_pricing"]}
    seconds = {
        "ingest_pricing": timed(lambda: ingest(spark, pricing, f"{root}/tables", YEAR), runs),
        "ingest_all": timed(lambda: ingest(spark, sources, f"{root}/tables", YEAR), runs),
    }
    tables = load_tables(spark, f"{root}/tables", YEAR)
    rows = tables["drug_pricing"].count()
    for name in HEADLINE:
        seconds[name] = timed(
            lambda: QUERIES[name](tables).write.format("noop").mode("overwrite").save(), runs
        )
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
        "pricing_rows": rows,
        "ingest_pricing_rows_per_sec": round(rows / seconds["ingest_pricing"]),
    }))


if __name__ == "__main__":
    main()
