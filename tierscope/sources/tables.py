"""The table catalog: typed Parquet tables, one directory each, partitioned by year."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from tierscope import schemas as S
from tierscope.sources.sinks import live_prices

YEAR = T.StructField("year", T.IntegerType())


def load_tables(
    spark: SparkSession, root: str, year: int | None = None, register: bool = False
) -> dict[str, DataFrame]:
    """All tables under a root directory, of one year if given.

    Optional tables that were not delivered are empty. With `register`, the tables are
    also temporary views, for spark.sql.
    """
    names = [*S.SCHEMAS, *S.TEXT_TABLES]
    tables = {name: load_table(spark, root, name) for name in names}
    tables = {name: df for name, df in tables.items() if df is not None}
    if year is not None:
        tables = snapshot(tables, year)
    if register:
        register_views(tables)
    return tables


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """One table of all years; one without a fixed schema is None where not delivered."""
    path, schema = f"{root.rstrip('/')}/{name}", S.SCHEMAS.get(name)
    if name == "drug_pricing" and (live := live_prices(spark, root)) is not None:
        return live
    try:
        if schema is None:
            return spark.read.parquet(path)
        # A fixed schema needs no job to look into the files. `year` is the partition.
        found = spark.read.schema(T.StructType([*schema.fields, YEAR])).parquet(path)
        return found.select(*schema.names, "year")  # without further directory levels
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        if name in S.OPTIONAL_TABLES:
            return spark.createDataFrame([], T.StructType([*schema.fields, YEAR]))
        if name in S.TEXT_TABLES:
            return None
        raise


def snapshot(t: Mapping[str, DataFrame], year: int) -> dict[str, DataFrame]:
    """The tables as of one year; partitions of other years are not read.

    Enrollment comes from its one published year. A table without rows of the year,
    such as pricing before its first delivery, is empty.
    """
    taken = {}
    for name, df in t.items():
        wanted = S.ENROLLMENT_YEAR if name in S.ENROLLMENT_TABLES else year
        taken[name] = df.where(F.col("year") == wanted).drop("year") if "year" in df.columns else df
    return taken


def register_views(t: Mapping[str, DataFrame]) -> None:
    """The tables as temporary views; `plans` and `geographic` name two of them again."""
    for name, df in t.items():
        df.createOrReplaceTempView(name)
    for alias, name in (("plans", "plan_information"), ("geographic", "geographic_locator")):
        if name in t:
            t[name].createOrReplaceTempView(alias)


def ingest_report(t: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in t.items()
    ]
    return reduce(DataFrame.unionByName, counts)
