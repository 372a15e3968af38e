"""Writing typed tables and results."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope import schemas as S
from tierscope.sources.archives import ORIGIN, can_open, read_zip_members
from tierscope.sources.manifest import Manifest, delete_folder
from tierscope.sources.text import LATIN1, REJECTED, prepare_checked, read_pipe, read_pipe_zip

MAX_RECORDS_PER_FILE = 20_000_000
BATCH = "batch"  # directory level of the price table that tells deliveries apart
STAGED = "_staged"  # folder of prices that are parsed but not laid out yet
REJECTED_TABLE = "rejected_values"
LARGE_BATCH = 64 << 30  # bytes of a batch that compaction leaves alone


def write_table(
    df: DataFrame, path: str, mode: str = "overwrite", partition_by=(), own_parts: bool = False
) -> DataFrame:
    """A table as snappy Parquet, read back lazily.

    With `own_parts`, overwriting replaces only the partitions that `df` has rows of.
    """
    writer = df.write.mode(mode).options(
        compression="snappy", maxRecordsPerFile=MAX_RECORDS_PER_FILE,
        partitionOverwriteMode="dynamic" if own_parts else "static",
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def write_pricing(df: DataFrame, path: str, batch: str | None = None) -> DataFrame:
    """Prices of a year laid out for queries: partitioned by supply, clustered by drug.

    Queries ask for one supply and few drugs: the first prunes directories, the second
    leaves few files with a given drug. Ranges include the plan, so a drug with very
    many prices is spread over several tasks. Costs a sampling pass and a shuffle, which
    pays for a table that is read often.

    Without a batch name the year is replaced. With one, only what that batch wrote before
    is, so a batch may be written again; the others stay.
    """
    named = df.withColumn(BATCH, F.lit(batch or "delivered"))
    keys = ["days_supply", "ndc", "plan_key"]
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = ["days_supply", BATCH]
    return write_table(ordered, path, "overwrite", parts, own_parts=batch is not None).drop(BATCH)


def _is_zip(spark: SparkSession, path: str) -> bool:
    """Whether a path holds ZIP archives; archives and other files together are refused."""
    files = spark.read.format("binaryFile").load(path).select(F.lower("path").alias("path"))
    zipped = F.col("path").endswith(".zip")
    kinds = {row[0] for row in files.select(zipped).distinct().collect()}
    if len(kinds) > 1:
        raise ValueError(f"{path} holds ZIP archives and other files")
    return kinds == {True}


class Ingested(dict):
    """The tables of an ingest by name; `counts` has (rows, rejected values) of each."""

    def __init__(self, tables: Mapping[str, DataFrame], counts: Mapping[str, tuple[int, int]]):
        super().__init__(tables)
        self.counts = dict(counts)

    def report(self, spark: SparkSession) -> DataFrame:
        """Rows and rejected values of each table, as counted while they were written."""
        rows = [(name, *counts) for name, counts in self.counts.items()]
        return spark.createDataFrame(rows, "table_name string, rows bigint, rejected bigint")


def ingest(
    spark: SparkSession, sources: Mapping[str, str], root: str, year: int,
    renames: Mapping[str, str] | None = None,
) -> Ingested:
    """Reads delivered files and writes the typed table of each under root.

    `sources` maps table names to paths of text, or of ZIP archives of text (files or folders).
    Text becomes a table in one job without a shuffle: every task turns its split into Parquet.
    Prices are parsed once, too; what that gives is then laid out as `write_pricing` does and
    made live in one step. The year is a partition directory; a second year adds to the first,
    the same year again replaces it, appended prices included. `renames` is as for `prepare`.

    Rows, and values that are not of their column's type, are counted by the job that writes.
    The latter go to `rejected_values` with file, row and reason, whose text is read from
    what was just written.
    """
    root, written, counts = root.rstrip("/"), {}, {}
    for name, path in sources.items():
        encoding = LATIN1 if name == "drug_pricing" else "UTF-8"
        table = _checked(spark, path, name, encoding, renames)
        if name == "drug_pricing":
            typed, counts[name] = _write_counted(table, f"{root}/{name}/{STAGED}/{uuid.uuid4().hex}")
            replace_prices(spark, typed.drop(REJECTED), root, year)
        else:
            typed, counts[name] = _write_counted(table, f"{root}/{name}/year={year}")
        _write_rejected(typed, f"{root}/{REJECTED_TABLE}/table_name={name}/year={year}")
        if name == "drug_pricing":
            delete_folder(spark, f"{root}/{name}/{STAGED}")
            written[name] = live_prices(spark, root).where(F.col("year") == year).drop("year")
        else:
            written[name] = typed.drop(REJECTED)
    return Ingested(written, counts)


def _checked(spark: SparkSession, path: str, name: str, encoding: str, renames) -> DataFrame:
    """A delivered table with what could not be typed."""
    origin = None
    if not _is_zip(spark, path):
        rows = read_pipe(spark, path, encoding=encoding)
    elif can_open(path):
        rows, origin = read_zip_members(spark, path, encoding=encoding, origin=True), ORIGIN
    else:
        rows = read_pipe_zip(spark, path, encoding=encoding)
    return prepare_checked(rows, name, origin, renames)


def _write_counted(table: DataFrame, path: str) -> tuple[DataFrame, tuple[int, int]]:
    """Writes a table; its rows and rejected values are counted by the same job."""
    seen = Observation()
    has = REJECTED in table.columns
    rejected = F.coalesce(F.sum(F.size(f"{REJECTED}.values")), F.lit(0)) if has else F.lit(0)
    observed = table.observe(
        seen, F.count(F.lit(1)).alias("rows"), rejected.cast("bigint").alias("rejected")
    )
    typed = write_table(observed, path)
    return typed, (seen.get["rows"], seen.get["rejected"])


def _write_rejected(typed: DataFrame, path: str) -> None:
    """The rejected values of a table just written; only their column is read."""
    if REJECTED not in typed.columns:
        return
    rows = typed.where(F.col(REJECTED).isNotNull()).select(
        f"{REJECTED}.file", f"{REJECTED}.row", F.explode(f"{REJECTED}.values").alias("value")
    )
    write_table(rows.select("file", "row", "value.*"), path)


def rejected_values(spark: SparkSession, root: str) -> DataFrame:
    """What ingest could not type: table_name, year, file, row, column, text, reason."""
    schema = (
        "file string, row string, column string, text string, reason string, "
        "table_name string, year int"
    )
    try:
        found = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{REJECTED_TABLE}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], schema)
    return found.select("table_name", "year", "file", "row", "column", "text", "reason")


# ---------------------------------------------------------------- live prices

def _prices_path(root: str) -> str:
    return f"{root.rstrip('/')}/drug_pricing"


def live_prices(spark: SparkSession, root: str) -> DataFrame | None:
    """The live prices of all years with `year`; None where there is no log of them."""
    log = Manifest(spark, _prices_path(root))
    if not log.versions():
        return None
    columns = S.SCHEMAS["drug_pricing"]
    levels = [T.StructField("year", T.IntegerType()), T.StructField(BATCH, T.StringType())]
    return log.load(T.StructType([*columns.fields, *levels])).select(*columns.names, "year")


def live_batches(spark: SparkSession, root: str, year: int) -> set[str]:
    """Names of the batches that a year's live prices consist of."""
    _, live = Manifest(spark, _prices_path(root)).read()
    return {p.rsplit(f"/{BATCH}=")[-1] for p in live if p.startswith(f"year={year}/")}


def _add_prices(spark: SparkSession, df: DataFrame, root: str, year: int, batch: str, old) -> None:
    """Writes a batch and makes it live, in place of those live directories that `old` names."""
    log = Manifest(spark, _prices_path(root))
    before = [] if log.versions() else log.leaves("")  # written before there was a log
    write_pricing(df, f"{_prices_path(root)}/year={year}", batch)
    new = [part for part in log.leaves(f"year={year}") if part.endswith(f"/{BATCH}={batch}")]
    log.commit(lambda live: {p for p in live or set(before) if not old(p)} | set(new))


def replace_prices(spark: SparkSession, df: DataFrame, root: str, year: int) -> None:
    """A year's prices anew, in one step for readers."""
    batch = f"delivered-{uuid.uuid4().hex[:12]}"
    _add_prices(spark, df, root, year, batch, lambda part: part.startswith(f"year={year}/"))


def add_prices(spark: SparkSession, df: DataFrame, root: str, year: int, batch: str) -> None:
    """A batch of prices besides the live ones, once: a batch that is live is left as it is."""
    _, live = Manifest(spark, _prices_path(root)).read()
    if not any(p.startswith(f"year={year}/") and p.endswith(f"/{BATCH}={batch}") for p in live):
        _add_prices(spark, df, root, year, batch, lambda part: False)


def compact_prices(spark: SparkSession, root: str, year: int, large: int = LARGE_BATCH) -> int:
    """Writes the small batches of a year as one and makes it live in their place.

    Batches of `large` bytes or more stay as they are, so that a growing year isn't written
    again and again. Readers see the same rows throughout. Returns how many batches became one;
    0 if there was no more than one, or if another writer replaced one of them meanwhile.
    """
    log, sizes = Manifest(spark, _prices_path(root)), {}
    parts = [part for part in log.read()[1] if part.startswith(f"year={year}/")]
    for part in parts:
        batch = part.rsplit(f"/{BATCH}=")[-1]
        sizes[batch] = sizes.get(batch, 0) + log.size(part)
    small = {batch for batch, size in sizes.items() if size < large}
    if len(small) < 2:
        return 0
    taken = {part for part in parts if part.rsplit(f"/{BATCH}=")[-1] in small}
    rows = spark.read.schema(S.SCHEMAS["drug_pricing"]).option(
        "basePath", f"{_prices_path(root)}/year={year}"
    ).parquet(*[f"{_prices_path(root)}/{part}" for part in sorted(taken)])
    batch = f"compact-{uuid.uuid4().hex[:12]}"
    write_pricing(rows, f"{_prices_path(root)}/year={year}", batch)
    new = {part for part in log.leaves(f"year={year}") if part.endswith(f"/{BATCH}={batch}")}
    live = log.commit(lambda live: live - taken | new if taken <= live else live)
    return len(small) if new <= live else 0


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A result as CSV files with a header line."""
    df.write.mode(mode).option("header", True).csv(path)


def to_records(df: DataFrame, fills: Mapping[str, object] | None = None) -> DataFrame:
    """A result as JSON records in a column `record`, with NULL and NaN filled as told.

    Without a fill, NULL and NaN are both null in the record.
    """
    filled = df.na.fill(dict(fills)) if fills else df
    floats = [
        f.name for f in filled.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    ]
    clean = filled.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
    return clean.select(
        F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("record")
    )
