"""What the text operators share: reading tables, cutting lineage, per-document functions."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.functions.params import scratch_path

BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20  # of a batch that goes to a Python worker
CHUNK_BYTES = 1 << 20  # text that a per-document function works on at a time


_shipped: set[str] = set()


def ship() -> None:
    """Sends this package to the executors, once a session, as tasks import it by name.

    Also bounds the text that Arrow hands to a worker at a time, if the session's bound is
    wider.
    """
    session = SparkSession.getActiveSession()
    if int(re.sub(r"\D", "", session.conf.get(BATCH_SETTING))) > BATCH_BYTES:
        session.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    context = session.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/{root.name}-tasks.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in root.rglob("*.py"):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def map_batches(df: DataFrame, function: Callable, schema) -> DataFrame:
    """`mapInArrow` by a function of this package."""
    ship()
    return df.mapInArrow(function, schema)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes a table below spark.checkpoint.dir and reads it back.

    Cuts the lineage: lost executors cost only the tasks that were reading the table, and
    several readers don't compute it again.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def filled(texts: pa.Array) -> pa.Array:
    """Texts of a batch as large strings, null as empty."""
    return texts.cast(pa.large_string()).fill_null("")


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive texts of about `limit` bytes together; a longer text comes alone."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield texts.slice(start, stop - start)
        start = stop


def per_text(
    function: Callable[[pa.Array], pa.Array], returns: str, limit: int = CHUNK_BYTES
) -> Callable[[Column], Column]:
    """A column function from texts to one value each, run on chunks of Arrow batches.

    `function` gets a chunk of texts (large strings, null as empty) and returns an Arrow
    array of as many values. Other columns of the rows never leave the JVM.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gc.disable()  # large dicts are slow to visit
        try:
            for batch in batches:
                texts = filled(batch)
                parts = [function(part) for part in chunks(texts, limit)] or [function(texts)]
                yield pa.concat_arrays(parts)
        finally:  # a worker serves further tasks, and what this one unpickled is cyclic
            gc.enable()
            gc.collect()
            pa.default_memory_pool().release_unused()

    ship()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, returns)


def encoded(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text."""
    return texts.cast(pa.large_binary()).to_pylist()


def struct_array(**columns: Sequence) -> pa.StructArray:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.StructArray.from_arrays(arrays, names=list(columns))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def per_batch(function: Callable[..., pa.Array], returns: str) -> Callable[..., Column]:
    """A column function from one or more columns to one, on Arrow batches as they come."""

    def run(batches: Iterator) -> Iterator[pa.Array]:
        for batch in batches:
            yield function(*batch) if isinstance(batch, tuple) else function(batch)

    ship()
    run.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array],
    }
    return F.arrow_udf(run, returns)
