"""Appending newly delivered price files to the price table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tierscope import schemas as S
from tierscope.sources.sinks import add_prices, compact_prices, live_batches
from tierscope.sources.tables import load_table
from tierscope.sources.text import LATIN1, prepare, text_schema


def append_pricing(
    spark: SparkSession,
    source: str,
    root: str,
    year: int,
    checkpoint: str,
    encoding: str = LATIN1,
    files_per_batch: int = 1000,
    most_batches: int = 16,
) -> DataFrame:
    """Adds the price files not yet taken in, each once, and returns the year's prices.

    Files are added to the table that `ingest` writes below root, in the same layout. A run
    takes what has arrived and ends. The checkpoint remembers files; a batch has directories
    of its own, which it writes anew if a run was cut short, so that nothing comes twice.
    A batch becomes live in one step: a reader sees all of it or nothing. A file whose header
    has other columns, or in another order, is an error.

    Where a run leaves more than `most_batches` batches in the year, small ones are written as
    one; what they were stays until `Manifest.vacuum`, for readers that still use it.
    """
    label = hashlib.md5(checkpoint.encode()).hexdigest()[:8]

    def take(batch: DataFrame, number: int) -> None:
        add_prices(spark, prepare(batch, "drug_pricing"), root, year, f"{label}-{number}")

    files = (
        spark.readStream.schema(text_schema(S.POSITIONAL["drug_pricing"]))
        .options(sep="|", header=True, encoding=encoding, enforceSchema=False)
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source)
    )
    query = (
        files.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if len(live_batches(spark, root, year)) > most_batches:
        compact_prices(spark, root, year)
    return load_table(spark, root, "drug_pricing").where(f"year = {year}").drop("year")
