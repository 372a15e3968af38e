"""Price, plan and cost-rule tables stored by plan, so that they meet without a shuffle.

Each table is cut into the same number of buckets by plan key. A task reads bucket i of
every table, and joins by plan key need no exchange of prices. The number of buckets is part of
the path: files of another number can't be taken for these.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope import schemas as S
from tierscope.sources.sinks import MAX_RECORDS_PER_FILE
from tierscope.sources.text import conform

KEY = "plan_key"
#: Tables by plan, and what rows of a bucket are sorted by. Other tables stay as they are.
SORTED_BY = {
    "plan_information": [KEY, "county_code"],
    "beneficiary_costs": [KEY, "tier"],
    "drug_pricing": [KEY, "ndc"],
}
PARTITIONED_BY = {"drug_pricing": ["days_supply"]}
BUCKETS = 1024
# A bucket is one task, which Spark can't split. A table with a bucket of more bytes than this,
# and of more than so many times the mean, is read by files instead.
HOT_BYTES, HOT_TIMES = 4 << 30, 8


def _path(root: str, name: str, year: int, buckets: int) -> str:
    return f"{root.rstrip('/')}/by_plan_{buckets}/{name}/year={year}"


def _catalog_name(path: str) -> str:
    return f"tierscope_{hashlib.md5(path.encode()).hexdigest()[:16]}"


def write_colocated(t: Mapping[str, DataFrame], root: str, year: int, buckets: int = BUCKETS) -> None:
    """Writes the tables of a year that are keyed by plan below root, in buckets by plan.

    Costs one shuffle of each table. The year is replaced. Take as many buckets as shuffle
    partitions at least: of fewer, Spark would rather shuffle again to have more tasks.
    """
    for name, order in SORTED_BY.items():
        path, parts = _path(root, name, year, buckets), PARTITIONED_BY.get(name, [])
        rows = conform(t[name], S.SCHEMAS[name]).repartition(buckets, KEY)
        writer = rows.write.mode("overwrite").format("parquet").options(
            compression="snappy", maxRecordsPerFile=MAX_RECORDS_PER_FILE, path=path
        ).bucketBy(buckets, KEY).sortBy(*order)
        writer = writer.partitionBy(*parts) if parts else writer
        rows.sparkSession.sql(f"DROP TABLE IF EXISTS {_catalog_name(path)}")
        writer.saveAsTable(_catalog_name(path))


def load_colocated(
    spark: SparkSession, t: Mapping[str, DataFrame], root: str, year: int, buckets: int = BUCKETS
) -> dict[str, DataFrame]:
    """The tables `t` of a year, with those that are stored by plan in place of their own.

    Any session may load what another has written. Operators take the result as they take
    any tables. A table with a hot bucket is read by files, which Spark splits: it then
    shuffles, and its skewed joins are split.
    """
    return {**t, **{name: _load(spark, root, name, year, buckets) for name in SORTED_BY}}


def _load(spark: SparkSession, root: str, name: str, year: int, buckets: int) -> DataFrame:
    path, schema = _path(root, name, year, buckets), S.SCHEMAS[name]
    largest, mean = bucket_sizes(spark, path).agg(F.max("bytes"), F.sum("bytes") / buckets).first()
    if largest is not None and largest > HOT_BYTES and largest > HOT_TIMES * mean:
        return spark.read.schema(schema).parquet(path)
    table, parts = _catalog_name(path), PARTITIONED_BY.get(name, [])
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external table: files stay
    spark.sql(
        f"CREATE TABLE {table} ({columns}) USING parquet "
        + (f"PARTITIONED BY ({', '.join(parts)}) " if parts else "")
        + f"CLUSTERED BY ({KEY}) SORTED BY ({', '.join(SORTED_BY[name])}) INTO {buckets} BUCKETS "
        f"LOCATION '{path}'"
    )
    if parts:
        spark.catalog.recoverPartitions(table)
    return spark.table(table).select(*schema.names)


def bucket_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Bytes of each bucket of a stored table, from the list of files; no file is read."""
    files = spark.read.format("binaryFile").options(
        pathGlobFilter="*.parquet", recursiveFileLookup=True
    ).load(path).select("path", "length")
    bucket = F.regexp_extract("path", r"_(\d+)(?:\.c\d+)?\.[a-z.]*parquet$", 1).cast("int")
    return files.groupBy(bucket.alias("bucket")).agg(F.sum("length").alias("bytes"))
