"""Every operator as a query over a star-schema directory.

Each query derives the drug-plan tables lazily from that directory and applies one
operator with the sample parameters. Queries about reading and writing go through files
in the scratch folder and return what was read back.
"""

from __future__ import annotations

import io
import itertools
import re
import sys
import zipfile
from collections.abc import Callable, Mapping

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope import schemas as S
from tierscope.functions.expr import rounded
from tierscope.functions.params import scratch_path
from tierscope.operators import changes, costs, drugs, drug_list, geography, incremental, landscape
from tierscope.operators import normalize
from tierscope.operators import organizations as orgs
from tierscope.operators import profile, summaries
from tierscope.plans import samples as P
from tierscope.sources import archives, colocated, dictionaries, sinks, tables, text
from tierscope.sources.star import derive_tables
from tierscope.streaming.append import append_pricing

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # for _zip_batches in tasks

Tables = Mapping[str, DataFrame]
Build = Callable[[Tables], DataFrame]


def portable(df: DataFrame) -> DataFrame:
    """Decimals as DOUBLE, so results compare across engines."""
    decimals = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)]
    return df.withColumns({c: F.col(c).cast("double") for c in decimals}) if decimals else df


def query(build: Build) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return portable(build(derive_tables(spark, sf_dir)))

    return run


# ---------------------------------------------------------------- file round trips

def _spark(t: Tables) -> SparkSession:
    return t["plan_information"].sparkSession


def _deliver(df: DataFrame, path: str, encoding: str = "UTF-8") -> str:
    """Writes a table the way source files come: pipes, upper-case header."""
    named = df.toDF(*[c.upper() for c in df.columns])
    named.write.option("sep", "|").option("header", True).option("encoding", encoding).csv(path)
    return path


def _read_pipe(t: Tables) -> DataFrame:
    path = _deliver(t["plan_information"], scratch_path(_spark(t), "pipe"))
    return text.prepare(text.read_pipe(_spark(t), path), "plan_information")


def _read_pipe_latin1(t: Tables) -> DataFrame:
    named = t["plan_information"].select(
        "plan_key", F.concat("plan_name", F.lit(" é")).alias("plan_name")
    ).distinct()
    path = _deliver(named, scratch_path(_spark(t), "latin1"), text.LATIN1)
    return text.clean_columns(text.read_pipe(_spark(t), path, encoding=text.LATIN1))


def _zip_batches(batches):
    """One archive per batch of lines: a header and the rows."""
    for batch in batches:
        lines = "\n".join(["DRUG_LIST_ID|NDC|TIER_LEVEL_VALUE", *batch.column(0).to_pylist()])
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("part.txt", lines + "\n")
        yield pa.RecordBatch.from_arrays([pa.array([packed.getvalue()])], names=["content"])


def _unzip_pipe(t: Tables) -> DataFrame:
    lines = t["drug_list_drugs"].select(
        F.concat_ws("|", "drug_list_id", "ndc", "tier_level_value").alias("line")
    )
    archives = lines.mapInArrow(_zip_batches, "content binary")
    rows = text.unzip_pipe(archives, ["ndc", "tier_level_value", "drug_list_id"])
    return text.coerce(rows, {"tier_level_value": S.INT})


MEMBER_LINES = 500


def _write_archives(t: Tables) -> str:
    """The drug lists as archives in a folder, one a task, each with members of some lines.

    Their number follows the size of the lists.
    """
    folder = scratch_path(_spark(t), "archives")
    columns = ("drug_list_id", "ndc", "tier_level_value")
    lines = t["drug_list_drugs"].select(F.concat_ws("|", *columns).alias("line"), *columns)
    dealt = lines.repartition(*columns).sortWithinPartitions("line").select("line")
    names = dealt.mapInArrow(_archive_writer(folder, "|".join(columns).upper()), "name string")
    names.write.format("noop").mode("overwrite").save()
    return folder


def _archive_writer(folder: str, header: str):
    def write(batches):
        lines = (line for batch in batches for line in batch.column(0).to_pylist())
        part = list(itertools.islice(lines, MEMBER_LINES))
        if not part:
            return
        start, name = 0, f"{TaskContext.get().partitionId()}.zip"
        store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        store.create_dir(place)
        with store.open_output_stream(f"{place}/{name}") as out:
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                while part:
                    archive.writestr(f"part-{start}.txt", "\n".join([header, *part]) + "\n")
                    start += len(part)
                    part = list(itertools.islice(lines, MEMBER_LINES))
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

    return write


def _from_archives(read: Callable[[SparkSession, str], DataFrame]) -> Build:
    def run(t: Tables) -> DataFrame:
        rows = read(_spark(t), _write_archives(t))
        return text.coerce(rows, {"tier_level_value": S.INT}).select(
            "drug_list_id", "ndc", "tier_level_value"
        )

    return run


def _clean_columns(t: Tables) -> DataFrame:
    df = t["drug_list_drugs"].select("drug_list_id", "ndc", "tier_level_value")
    return text.clean_columns(df.toDF("DRUG_LIST ID", "Ndc", "Tier_Level Value"))


def _rename_positional(t: Tables) -> DataFrame:
    names = S.POSITIONAL["geographic_locator"]
    unnamed = t["geographic_locator"].select(*names).toDF(*[f"_c{i}" for i in range(len(names))])
    return text.rename_positional(unnamed, names)


def _coerce(t: Tables) -> DataFrame:
    shown = F.when(F.col("snp") == 4, "abc").otherwise(F.col("premium").cast("string"))
    rows = t["plan_information"].select(
        "plan_key", "county_code", shown.alias("premium"),
        F.concat(F.col("snp").cast("string"), F.lit(".0")).alias("snp"),
    )
    return text.coerce(rows, {"premium": S.MONEY, "snp": S.INT})


def _with_plan_key(t: Tables) -> DataFrame:
    return text.with_plan_key(t["plan_information"].select(
        "contract_id", "plan_id", F.when(F.col("snp") != 0, F.col("segment_id")).alias("segment_id")
    ).distinct())


def _null_tokens(t: Tables) -> DataFrame:
    state = (
        F.when(F.col("snp") == 1, "NA").when(F.col("snp") == 2, "").otherwise(F.col("state"))
    )
    return text.null_tokens(t["plan_information"].select("plan_key", state.alias("state")))


def _write_table(t: Tables) -> DataFrame:
    return sinks.write_table(t["drug_list_drugs"], scratch_path(_spark(t), "drugs"))


def _write_pricing(t: Tables) -> DataFrame:
    return sinks.write_pricing(t["drug_pricing"], scratch_path(_spark(t), "pricing"))


def _delivered_prices(t: Tables) -> DataFrame:
    parts = F.split("plan_key", r"\|")
    return t["drug_pricing"].select(
        *[parts[i].alias(name) for i, name in enumerate(S.PLAN_KEY_PARTS)],
        "ndc", "days_supply", "unit_cost",
    )


def _append_pricing(t: Tables) -> DataFrame:
    """One supply ingested, the others appended in two deliveries and three runs, all loaded."""
    spark, root = _spark(t), scratch_path(_spark(t), "append")
    delivered = _delivered_prices(t)
    first = _deliver(delivered.where(F.col("days_supply") == 30), f"{root}/first")
    sinks.ingest(spark, {"drug_pricing": first}, f"{root}/tables", 2025)
    args = (spark, f"{root}/in/*", f"{root}/tables", 2025, f"{root}/checkpoint")
    _deliver(delivered.where(F.col("days_supply") == 60), f"{root}/in/second")
    append_pricing(*args)
    append_pricing(*args)
    _deliver(delivered.where(~F.col("days_supply").isin(30, 60)), f"{root}/in/third")
    return append_pricing(*args)


def _compact_pricing(t: Tables) -> DataFrame:
    """One supply ingested, the other prices appended in eight batches, small ones made one."""
    spark, root = _spark(t), scratch_path(_spark(t), "compact")
    delivered = _delivered_prices(t)
    first = _deliver(delivered.where(F.col("days_supply") == 30), f"{root}/first")
    sinks.ingest(spark, {"drug_pricing": first}, f"{root}/tables", 2025)
    rest = delivered.where(F.col("days_supply") != 30).repartition(8, "ndc")
    args = (spark, f"{root}/in", f"{root}/tables", 2025, f"{root}/checkpoint")
    _deliver(rest, f"{root}/in")
    return append_pricing(*args, files_per_batch=1, most_batches=3)


def _ingest_counts(t: Tables) -> DataFrame:
    """Rows of each table as counted while they were written."""
    spark, root = _spark(t), scratch_path(_spark(t), "counts")
    sources = {
        table: _deliver(t[table], f"{root}/text/{table}")
        for table in ("plan_information", "geographic_locator", "beneficiary_costs")
    } | {"drug_pricing": _deliver(_delivered_prices(t), f"{root}/text/drug_pricing")}
    return sinks.ingest(spark, sources, f"{root}/tables", 2025).report(spark)


def _rejected_values(t: Tables) -> DataFrame:
    """Plans with values that are not of their column's type, as ingest lists them."""
    spark, root = _spark(t), scratch_path(_spark(t), "rejected")
    snp, text_of = F.col("snp"), lambda c: F.col(c).cast("string")
    plans = t["plan_information"].select(
        "contract_id", "plan_id", "segment_id", "county_code",
        F.when(snp == 4, "abc").when(snp == 3, "123456789.5").otherwise(text_of("premium"))
        .alias("premium"),
        F.when(snp == 3, "N/A").otherwise(text_of("deductible")).alias("deductible"),
        F.when(snp == 4, "1.5").when(snp == 0, "0.0").otherwise(text_of("snp")).alias("snp"),
    )
    sources = {"plan_information": _deliver(plans, f"{root}/text")}
    sinks.ingest(spark, sources, f"{root}/tables", 2025)
    found = sinks.rejected_values(spark, f"{root}/tables")
    named = F.col("file").contains("/text/part-").alias("in_a_file")
    return found.select("table_name", "year", named, "row", "column", "text", "reason")


def _load_tables(name: str, *columns: str) -> Build:
    """A table's text to typed Parquet and back through the catalog."""

    def build(t: Tables) -> DataFrame:
        spark, root = _spark(t), scratch_path(_spark(t), "ingest")
        required = (
            "plan_information", "geographic_locator", "drug_list_drugs", "beneficiary_costs",
        )
        sources = {table: _deliver(t[table], f"{root}/text/{table}") for table in required}
        sinks.ingest(spark, sources, f"{root}/tables", 2025)
        loaded = tables.load_tables(spark, f"{root}/tables", 2025)
        return loaded[name].select(*columns)

    return build


def _snapshot(t: Tables) -> DataFrame:
    """Plans of two years, the second without a premium, as of the second."""
    plans = t["plan_information"].withColumn("year", F.explode(F.array(F.lit(2025), F.lit(2026))))
    later = F.when(F.col("year") == 2025, F.col("premium"))
    return tables.snapshot({"plan_information": plans.withColumn("premium", later)}, 2026)[
        "plan_information"
    ].select("plan_key", "county_code", "drug_list_id", "premium")


def _read_drug_names(t: Tables) -> DataFrame:
    """Drug names as JSON dictionaries of up to 1000 concepts, one per file."""
    path = scratch_path(_spark(t), "names")
    entry = F.struct(F.col("rxcui").cast("string"), "description")
    t["drug_names"].groupBy(F.floor(F.col("rxcui") / 1000).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    ).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return text.read_drug_names(_spark(t), path)


def _read_drug_dictionary(t: Tables) -> DataFrame:
    """Drug names as JSON dictionaries of many concepts each, read by ranges of 4 KB."""
    path = scratch_path(_spark(t), "dictionaries")
    entry = F.struct(F.col("rxcui").cast("string"), "description")
    t["drug_names"].groupBy(F.floor(F.col("rxcui") / 1000).alias("part")).agg(
        F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")
    ).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return dictionaries.read_drug_dictionary(_spark(t), path, 4096)


def _export_csv(t: Tables) -> DataFrame:
    path = scratch_path(_spark(t), "csv")
    sinks.export_csv(drug_list.specialty_drug_groups(t, P.DRUG_LIST), path)
    return _spark(t).read.option("header", True).schema(
        "rxcui long, ndc string, tier int, quantity_limit_yn string, "
        "prior_authorization_yn string, step_therapy_yn string, ndc_count long, "
        "restrictions string"
    ).csv(path)


def _to_records(t: Tables) -> DataFrame:
    rows = t["plan_information"].select("plan_key", "county_code", "drug_list_id", "snp")
    return sinks.to_records(rows, {"drug_list_id": "none"})


def _snapshot_of(name: str) -> Build:
    """A table of two years, as of the second."""

    def build(t: Tables) -> DataFrame:
        schema = T.StructType([*S.SCHEMAS[name].fields, tables.YEAR])
        earlier = text.conform(t[name].withColumn("year", F.lit(2025)), schema)
        later = text.conform(t[name].withColumn("year", F.lit(2026)), schema)
        return tables.snapshot({name: earlier.union(later)}, 2026)[name]

    return build


def _two_years(t: Tables) -> tuple[Tables, Tables]:
    """Plans and drug lists of a year and of the next, in which some changed, came and went."""
    no, drug = F.col("plan_id").cast("int"), F.col("ndc").cast("long")
    plans, drugs_ = t["plan_information"], t["drug_list_drugs"]
    later_plans = plans.where(no % 10 != 3).withColumns({
        "premium": F.when(no % 10 == 4, F.col("premium") + 1).otherwise(F.col("premium")).cast(S.MONEY),
        "drug_list_id": F.when(no % 15 == 4, F.lit(None)).otherwise(F.col("drug_list_id")),
    })
    later_drugs = drugs_.where(drug % 10 != 3).withColumn(
        "tier_level_value", F.when(drug % 10 == 4, 1).otherwise(F.col("tier_level_value"))
    )
    return (
        {"plan_information": plans.where(no % 10 != 5), "drug_list_drugs": drugs_.where(drug % 10 != 5)},
        {"plan_information": later_plans, "drug_list_drugs": later_drugs},
    )


def _export_csv_table(t: Tables) -> DataFrame:
    path, schema = scratch_path(_spark(t), "csv-table"), S.SCHEMAS["drug_list_drugs"]
    sinks.export_csv(t["drug_list_drugs"].select(*schema.names), path)
    return _spark(t).read.option("header", True).schema(schema).csv(path)


def _refresh_parts(name: str) -> Build:
    """Two parts of the base tables refreshed one after the other, then the first once more."""

    def build(t: Tables) -> DataFrame:
        spark, path = _spark(t), scratch_path(_spark(t), "incremental")
        first = {
            "plan_information": t["plan_information"].where("snp < 3"),
            "drug_list_drugs": t["drug_list_drugs"].where("tier_level_value % 2 = 0"),
        }
        second = {
            "plan_information": t["plan_information"].where("snp >= 3"),
            "drug_list_drugs": t["drug_list_drugs"].where("tier_level_value % 2 = 1"),
        }
        for parts in ({"first": second}, {"second": second}, {"first": first}):
            found = incremental.refresh_parts(spark, parts, t["geographic_locator"], path)
        return found[name]

    return build


def _refresh(name: str) -> Build:
    return lambda t: summaries.refresh(t, scratch_path(_spark(t), "summaries"))[name]


def _colocated(build: Build) -> Build:
    """The query over tables that were stored by plan, read back."""

    def run(t: Tables) -> DataFrame:
        spark, root = _spark(t), scratch_path(_spark(t), "by-plan")
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        colocated.write_colocated(t, root, 2025, buckets)
        return build(colocated.load_colocated(spark, t, root, 2025, buckets))

    return run


# ---------------------------------------------------------------- composed queries

def _nest_companies(t: Tables) -> DataFrame:
    """The nested table taken apart again: a row per map entry."""
    table = landscape.coverage_table(t, P.DRUG_GROUPS)
    nested = landscape.nest_companies(table, [*landscape.DRUG, "dosage"])
    rows = nested.select(
        *landscape.DRUG, "dosage", F.explode("companies").alias("company", "metrics")
    )
    return rows.select(*landscape.DRUG, "dosage", "company", "metrics.*")


def _fill_companies(t: Tables) -> DataFrame:
    """Plan counts per state of the companies present, filled to all companies."""
    present = landscape.company_plans(t).join(
        t["plan_information"].select("plan_key", "state").distinct(), "plan_key"
    ).groupBy("state", "company").agg(
        F.countDistinct("plan_key").alias("plans")
    )
    return landscape.fill_companies(present, ["state"])


def _pivot_companies(t: Tables) -> DataFrame:
    table = landscape.pricing_table(t, P.DRUG_GROUPS)
    return landscape.pivot_companies(table, [*landscape.DRUG, "dosage"])


def _format_money(t: Tables) -> DataFrame:
    rows = costs.contract_drug_costs(t, P.NDC).select("contract_id", "min_cost", "max_cost")
    return costs.format_money(rows, ["min_cost", "max_cost"])


def _priority_sort(t: Tables) -> DataFrame:
    ranked = drugs.priority_sort(costs.tier_drugs_priced(t, P.DRUG_LIST, P.TIER), P.PRIORITY)
    return ranked.select("rxcui", "ndc", "negotiated_cost")


def _with_drug_name(t: Tables) -> DataFrame:
    rows = t["drug_list_drugs"].select("rxcui", "ndc").distinct()
    return drugs.with_drug_name(rows, t["drug_names"])


def _describe(table: str, column: str) -> Build:
    def build(t: Tables) -> DataFrame:
        df = profile.describe_numeric(t[table], column)
        return df.withColumns({c: rounded(F.col(c), 6) for c in ("std", "p25", "p50", "p75")})

    return build


FID = P.DRUG_LIST

QUERIES: dict[str, Build] = {
    # sources and sinks
    "read_pipe": _read_pipe,
    "read_pipe_latin1": _read_pipe_latin1,
    "unzip_pipe": _unzip_pipe,
    "read_pipe_zip": _from_archives(text.read_pipe_zip),
    "read_zip_members": _from_archives(archives.read_zip_members),
    "clean_columns": _clean_columns,
    "rename_positional": _rename_positional,
    "coerce": _coerce,
    "with_plan_key": _with_plan_key,
    "null_tokens": _null_tokens,
    "write_table": _write_table,
    "write_pricing": _write_pricing,
    "append_pricing": _append_pricing,
    "compact_pricing": _compact_pricing,
    "ingest_counts": _ingest_counts,
    "rejected_values": _rejected_values,
    "ingest_report": lambda t: tables.ingest_report(t),
    "load_tables": _load_tables(
        "drug_list_drugs", "drug_list_id", "rxcui", "ndc", "tier_level_value", "quantity_limit_yn",
        "quantity_limit_amount", "quantity_limit_days", "prior_authorization_yn", "step_therapy_yn",
    ),
    "load_tables_costs": _load_tables(
        "beneficiary_costs", "plan_key", "coverage_level", "tier", "days_supply", "cost_type_pref",
        "cost_amt_pref", "cost_max_amt_pref", "tier_specialty_yn",
    ),
    "load_tables_plans": _load_tables("plan_information", *S.SCHEMAS["plan_information"].names),
    "load_tables_places": _load_tables(
        "geographic_locator", *S.SCHEMAS["geographic_locator"].names
    ),
    "snapshot": _snapshot,
    "plan_changes": lambda t: changes.plan_changes(*_two_years(t)),
    "drug_list_changes": lambda t: changes.drug_list_changes(*_two_years(t)),
    "snapshot_plans": _snapshot_of("plan_information"),
    "snapshot_drugs": _snapshot_of("drug_list_drugs"),
    "snapshot_prices": _snapshot_of("drug_pricing"),
    "snapshot_costs": _snapshot_of("beneficiary_costs"),
    "colocated_specialty_margin": _colocated(costs.specialty_margin),
    "colocated_contract_specialty_cost": _colocated(costs.contract_specialty_cost),
    "colocated_pricing_table": _colocated(
        lambda t: landscape.pricing_table(t, P.DRUG_GROUPS)
    ),
    "read_drug_names": _read_drug_names,
    "read_drug_dictionary": _read_drug_dictionary,
    "export_csv": _export_csv,
    "export_csv_table": _export_csv_table,
    "to_records": _to_records,
    # normalization
    "contracts": normalize.contracts,
    "drug_lists": normalize.drug_lists,
    "plans": normalize.plans,
    "plan_geography": normalize.plan_geography,
    "duplicate_keys": lambda t: normalize.duplicate_keys(
        normalize.plan_geography(t), ["plan_key", "county_code"]
    ),
    "orphans": lambda t: normalize.orphans(
        normalize.plans(t), t["plan_enrollment"],
        {"contract_id": "contract_number", "plan_id": "plan_id"},
    ),
    "declared_keys": normalize.declared_keys,
    "declared_references": normalize.declared_references,
    # summaries
    "drug_list_summary": summaries.drug_list_summary,
    "county_plan_summary": summaries.county_plan_summary,
    "refresh_drug_list_summary": _refresh("drug_list_summary"),
    "refresh_county_plan_summary": _refresh("county_plan_summary"),
    "refresh_parts_drug_list_summary": _refresh_parts("drug_list_summary"),
    "refresh_parts_county_plan_summary": _refresh_parts("county_plan_summary"),
    # drug lists
    "drug_list_list": drug_list.drug_list_list,
    "drug_list_list_of_org": lambda t: drug_list.drug_list_list(t, P.ORG_PART),
    "drug_list_orgs": drug_list.drug_list_orgs,
    "org_prefixes": drug_list.org_prefixes,
    "drug_lists_of_org": lambda t: drug_list.drug_lists_of_org(t, P.ORG_NAME),
    "drug_list_parent": lambda t: drug_list.drug_list_parent(t, FID),
    "tier_drug_counts": lambda t: drug_list.tier_drug_counts(t, FID),
    "restriction_counts": lambda t: drug_list.restriction_counts(t, FID),
    "drug_list_geography": lambda t: drug_list.drug_list_geography(t, FID),
    "cost_sample": lambda t: drug_list.cost_sample(t, FID),
    "specialty_counts": lambda t: drug_list.specialty_counts(t, FID),
    "tier_share": lambda t: drug_list.tier_share(t, FID),
    "restriction_share": lambda t: drug_list.restriction_share(t, FID),
    "specialty_pa_share": lambda t: drug_list.specialty_pa_share(t, FID),
    "drug_list_drugs_list": lambda t: drug_list.drug_list_drugs_list(t, FID),
    "drug_list_drugs_list_specialty": lambda t: drug_list.drug_list_drugs_list(
        t, FID, specialty_only=True
    ),
    "drug_list_drugs_list_tier": lambda t: drug_list.drug_list_drugs_list(t, FID, tier=P.TIER),
    "drug_list_states": lambda t: drug_list.drug_list_states(t, FID),
    "drug_list_overview": lambda t: drug_list.drug_list_overview(t, FID),
    "drug_list_plans": lambda t: drug_list.drug_list_plans(t, FID),
    "drug_list_plans_first": lambda t: drug_list.drug_list_plans(t, FID, 20),
    "drug_list_plan_rows": lambda t: drug_list.drug_list_plan_rows(t, FID),
    "drug_list_plan_metrics": lambda t: drug_list.drug_list_plan_metrics(t, FID),
    "drug_list_parent_orgs": lambda t: drug_list.drug_list_parent_orgs(t, FID),
    "tier_summary": lambda t: drug_list.tier_summary(t, FID),
    "drug_list_drug_details": lambda t: drug_list.drug_list_drug_details(t, FID),
    "specialty_drugs": lambda t: drug_list.specialty_drugs(t, FID),
    "specialty_drugs_first": lambda t: drug_list.specialty_drugs(t, FID, limit=25),
    "specialty_drug_groups": lambda t: drug_list.specialty_drug_groups(t, FID),
    "specialty_drug_metrics": lambda t: drug_list.specialty_drug_metrics(t, FID),
    "with_restriction_codes": lambda t: drug_list.with_restriction_codes(t["drug_list_drugs"])
    .select("drug_list_id", "ndc", "restrictions"),
    "drug_list_sizes": drug_list.drug_list_sizes,
    "restrictiveness": drug_list.restrictiveness,
    "restrictiveness_rows": drug_list.restrictiveness_rows,
    "drug_list_drugs_sample_plan": lambda t: drug_list.drug_list_drugs_sample_plan(t, FID),
    # organizations
    "organizations": orgs.organizations,
    "contract_list": orgs.contract_list,
    "orgs_by_enrollment": orgs.orgs_by_enrollment,
    "organization_plans": lambda t: orgs.organization_plans(t, P.ORGANIZATION),
    "contract_drug_lists": lambda t: orgs.contract_drug_lists(t, P.CONTRACT),
    "org_totals": orgs.org_totals,
    "search_orgs": lambda t: orgs.search_orgs(t, P.SEARCH),
    "organization_totals": lambda t: orgs.organization_totals(t, P.ORGANIZATION),
    "contract_totals": lambda t: orgs.contract_totals(t, P.CONTRACT),
    "global_stats": orgs.global_stats,
    "top_contracts": orgs.top_contracts,
    "top_contracts_in_area": lambda t: orgs.top_contracts(t, area=P.STATE),
    "contract_comparison": orgs.contract_comparison,
    "contract_types": orgs.contract_types,
    "contract_offerings": orgs.contract_offerings,
    # geography
    "plans_in_area_county": lambda t: geography.plans_in_area(t, P.COUNTY),
    "plans_in_area_state": lambda t: geography.plans_in_area(t, P.STATE.lower()),
    "county_name": lambda t: geography.county_name(t, P.COUNTY),
    "area_plan_count": lambda t: geography.area_plan_count(t, P.STATE),
    "area_plans": lambda t: geography.area_plans(t, P.COUNTY),
    "area_plans_first": lambda t: geography.area_plans(t, P.STATE, 10),
    "area_premium_stats": lambda t: geography.area_premium_stats(t, P.STATE),
    "area_drug_lists": lambda t: geography.area_drug_lists(t, P.STATE),
    "area_snp": lambda t: geography.area_snp(t, P.STATE),
    "county_plans": lambda t: geography.county_plans(t, P.COUNTY),
    "county_summary": lambda t: geography.county_summary(t, P.COUNTY),
    "county_competition": lambda t: geography.county_competition(t, P.STATE_NAME),
    "county_competition_all": geography.county_competition,
    # drugs
    "drug_overview": lambda t: drugs.drug_overview(t, P.NDC),
    "drug_tiers": lambda t: drugs.drug_tiers(t, P.NDC),
    "drug_restrictions": lambda t: drugs.drug_restrictions(t, P.NDC),
    "drug_plans": lambda t: drugs.drug_plans(t, P.NDC),
    "drug_cost_samples": lambda t: drugs.drug_cost_samples(t, P.NDC),
    "specialty_coverage_rows": drugs.specialty_coverage_rows,
    "specialty_coverage": drugs.specialty_coverage,
    "drug_dosages": lambda t: drugs.drug_dosages(t["drug_names"]),
    "group_ndcs": lambda t: drugs.group_ndcs(t, P.DRUG_GROUPS),
    "priority_sort": _priority_sort,
    "with_drug_name": _with_drug_name,
    # costs
    "county_drug_costs": lambda t: costs.county_drug_costs(t, P.COUNTY, P.NDC),
    "county_drug_costs_basic": lambda t: costs.county_drug_costs_basic(t, P.COUNTY, P.NDC),
    "specialty_costs": costs.specialty_costs,
    "specialty_margin": costs.specialty_margin,
    "tier_drugs_priced": lambda t: costs.tier_drugs_priced(t, FID, P.TIER),
    "county_specialty_costs": lambda t: costs.county_specialty_costs(t, P.COUNTY),
    "tier_page_summary": lambda t: costs.tier_page_summary(t, FID, P.TIER),
    "contract_drug_costs": lambda t: costs.contract_drug_costs(t, P.NDC),
    "contract_specialty_cost": costs.contract_specialty_cost,
    "member_annual_cost": lambda t: costs.member_annual_cost(t, P.MEMBER_NDCS),
    "member_annual_cost_of_contract": lambda t: costs.member_annual_cost(
        t, P.MEMBER_NDCS, contract=P.CONTRACT
    ),
    "plan_cost_structure": lambda t: costs.plan_cost_structure(t, costs.sample_plan(t, FID)),
    "plan_cost_display": lambda t: costs.plan_cost_display(t, costs.sample_plan(t, FID)),
    "plan_cost_display_all": lambda t: costs.plan_cost_display(
        t, costs.sample_plan(t, FID), None
    ),
    "specialty_pricing": lambda t: costs.specialty_pricing(t, FID),
    "format_money": _format_money,
    # drug classes
    "company_plans": landscape.company_plans,
    "coverage_table": lambda t: landscape.coverage_table(t, P.DRUG_GROUPS),
    "pricing_table": lambda t: landscape.pricing_table(t, P.DRUG_GROUPS),
    "member_cost_table": lambda t: landscape.member_cost_table(t, P.DRUG_GROUPS, 1),
    "company_totals": lambda t: landscape.company_totals(t, P.COMPANY_NAMES),
    "fill_companies": _fill_companies,
    "pivot_companies": _pivot_companies,
    "nest_companies": _nest_companies,
    # profiling
    "plan_profile": profile.plan_profile,
    "plan_sample": profile.plan_sample,
    "describe_premium": _describe("plan_information", "premium"),
    "describe_deductible": _describe("plan_information", "deductible"),
    "describe_unit_cost": _describe("drug_pricing", "unit_cost"),
    "value_counts_tier": lambda t: profile.value_counts(t["drug_list_drugs"], "tier_level_value"),
    "value_counts_prior_auth": lambda t: profile.value_counts(
        t["drug_list_drugs"], "prior_authorization_yn"
    ),
    "value_counts_quantity_limit": lambda t: profile.value_counts(
        t["drug_list_drugs"], "quantity_limit_yn"
    ),
    "value_counts_cost_type": lambda t: profile.value_counts(
        t["beneficiary_costs"], "cost_type_pref"
    ),
    "value_counts_specialty": lambda t: profile.value_counts(
        t["beneficiary_costs"], "tier_specialty_yn"
    ),
    "value_counts_days_supply": lambda t: profile.value_counts(t["drug_pricing"], "days_supply"),
    "value_counts_state": lambda t: profile.value_counts(t["plan_information"], "state"),
    "value_counts_snp": lambda t: profile.value_counts(t["plan_information"], "snp"),
    "value_counts_drug_list": lambda t: profile.value_counts(
        t["plan_information"], "drug_list_id"
    ),
    "specialty_example": profile.specialty_example,
    "drug_price_range": lambda t: profile.drug_price_range(t, P.NDC),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query(build) for name, build in QUERIES.items()}
