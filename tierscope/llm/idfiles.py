"""Token ids in ORC files, in the order of document ids.

ORC keeps integers run-length encoded in stripes, with indexes of their rows and Bloom filters
of document ids. Readers take stripes in parallel and skip what the metadata rules out.

Documents are dealt by ranges of their ids, so a file holds one range, and files follow each
other. Each row says which file it is in and where its ids begin there; one sum over the
files' totals gives the place in the whole.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.llm.common import chunks, filled, map_batches, text_or_empty
from tierscope.llm.words import encoder

CHUNK_BYTES = 2 << 20  # text encoded at a time
STRIPE_BYTES = 16 << 20
INDEX_ROWS = 1000  # rows that an entry of the row index stands for
FALSE_HITS = 0.01  # of the Bloom filters


def encode_sorted(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Rows (doc_id, file, file_start, n_tokens, ids), each task's in ascending doc_id order.

    What is shuffled is text, which is smaller than its ids. Rows of one doc_id may be in two
    tasks; equal ids follow each other by a hash of the text.
    """
    texts = docs.select("doc_id", text_or_empty().alias("text_")).withColumn(
        "tie_", F.xxhash64("text_")
    )
    keys = ["doc_id", "tie_"]
    dealt = texts.repartitionByRange(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, start = TaskContext.get().partitionId(), 0
        gc.disable()  # large dicts are slow to visit
        try:
            for batch in batches:
                ids, done = batch.column(0), 0
                for texts in chunks(filled(batch.column(1)), CHUNK_BYTES):
                    n = len(texts)
                    ends, tokens = encoder(vocabulary).encode(texts)
                    tokens = np.insert(tokens.astype(np.int32), ends[1:], end_id)
                    ends = ends + np.arange(n + 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            ids.slice(done, n), pa.array(np.full(n, file, np.int32)),
                            pa.array(start + ends[:-1]), pa.array(np.diff(ends)),
                            pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens)),
                        ],
                        names=["doc_id", "file", "file_start", "n_tokens", "ids"],
                    )
                    done, start = done + n, start + int(ends[-1])
        finally:
            gc.enable()
            pa.default_memory_pool().release_unused()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, file int, file_start bigint, n_tokens bigint, ids array<int>"
    return map_batches(dealt.select("doc_id", "text_"), run, schema)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2) -> None:
    """Writes all documents' ids, each document's followed by `end_id`.

    Needs doc_id and text; other columns are ignored. A null or empty text is the end id
    alone. Each row is written, also one that repeats a doc_id; a null doc_id comes first. No
    documents give files without rows.
    """
    rows = encode_sorted(docs, vocabulary, end_id)
    rows.write.options(**{
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(FALSE_HITS),
        "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(INDEX_ROWS),
        "compression": "zstd",
    }).orc(path)


def read_ids(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids), start counting all ids before; of all documents or
    of those asked for, whose stripes and row groups alone are then read."""
    rows = spark.read.orc(path)
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # As many rows as files: the one place where a table meets in one task.
    before = totals.select(
        F.col("file").alias("file_"),
        F.coalesce(
            F.expr("sum(total) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"),
            F.lit(0),
        ).alias("before"),
    )
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(list(doc_ids)))
    joined = rows.join(F.broadcast(before), F.col("file") == F.col("file_"))
    return joined.select(
        "doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids"
    )


def digests(rows: DataFrame) -> DataFrame:
    """Rows of `read_ids` with the CRC-32 of the ids as little-endian 32-bit in their place."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = lists.values.to_numpy().astype("<u4")
            ends = lists.offsets.to_numpy()
            yield pa.array(
                [zlib.crc32(values[s:e].tobytes()) for s, e in zip(ends[:-1], ends[1:])], pa.int64()
            )

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    crc = F.arrow_udf(run, "bigint")("ids").alias("ids_crc32")
    return rows.select("doc_id", "start", "n_tokens", crc)
