"""Exact duplicates by an exchange of compressed fingerprints.

Each task sends the sorted 64-bit fingerprints of its documents, Golomb-coded, to the owners
of their ranges. Owners return bitmaps of where in the hash space a fingerprint came more
than once. Only documents whose bit is set are suspects; only their texts are shuffled, and
equal bytes decide.

The bitmaps have a size fixed by a parameter, so sending them to all tasks is safe. A fuller
bitmap means more suspects, never other results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tierscope.llm.common import map_batches, saved, text_or_empty

SLOT_BITS = 27  # the bitmaps have 2**27 bits, 16 MB, at most
KEY = ["print_", "text_sha256"]
SENT_AT_ONCE = 1 << 20  # fingerprints that a task sorts and sends together
BLOB = pa.schema([
    ("owner", pa.int32()), ("n", pa.int32()), ("low_bits", pa.int32()),
    ("first", pa.binary()), ("high", pa.binary()), ("low", pa.binary()),
])


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Sorted unsigned 64-bit values as gaps: (low bits, first value, quotients, remainders).

    Golomb coding with a power of two near the mean gap: quotients in unary in one stream,
    remainders of fixed width in another.
    """
    gaps = np.diff(values)
    mean = float(values[-1] - values[0]) / max(len(gaps), 1)
    low_bits = max(0, int(np.log2(max(mean * 0.69, 1))))
    quotients = (gaps >> np.uint64(low_bits)).astype(np.int64)
    ones = np.cumsum(quotients + 1) - 1
    high = np.zeros(int(ones[-1]) + 1 if len(ones) else 0, np.uint8)
    high[ones] = 1
    shifts = np.arange(low_bits, dtype=np.uint64)
    low = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return low_bits, values[:1].tobytes(), np.packbits(high).tobytes(), np.packbits(low).tobytes()


def golomb_decode(n: int, low_bits: int, first: bytes, high: bytes, low: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(high, np.uint8)))[: n - 1]
    quotients = np.diff(ones, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(low, np.uint8))[: (n - 1) * low_bits]
    shifts = np.arange(low_bits, dtype=np.uint64)
    rest = (bits.reshape(n - 1, low_bits).astype(np.uint64) << shifts).sum(1, dtype=np.uint64)
    gaps = (quotients.astype(np.uint64) << np.uint64(low_bits)) + rest
    return np.cumsum(np.concatenate([np.frombuffer(first, np.uint64), gaps]), dtype=np.uint64)


def duplicate_bitmap(fingerprints: DataFrame, column: str, slot_bits: int) -> DataFrame:
    """Where fingerprints come more than once: rows (word, bits) for 64 slots each.

    A fingerprint's slot is its highest `slot_bits` bits, unsigned.
    """
    owners = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def coded() -> pa.RecordBatch:
            values = np.sort(np.concatenate(held).view(np.uint64))
            owner = ((values >> np.uint64(32)) * np.uint64(owners)) >> np.uint64(32)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            rows = [
                (int(own[0]), len(part), *golomb_encode(part))
                for own, part in zip(np.split(owner, cuts), np.split(values, cuts))
            ]
            return pa.RecordBatch.from_pydict(dict(zip(BLOB.names, zip(*rows))), BLOB)

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy())
            if sum(map(len, held)) >= SENT_AT_ONCE:
                yield coded()
                held.clear()
        if held:
            yield coded()

    def receive(blobs: pd.DataFrame) -> pd.DataFrame:
        parts = [golomb_decode(*row) for row in blobs.drop(columns="owner").itertuples(index=False)]
        values = np.sort(np.concatenate(parts))
        twice = np.unique(values[1:][values[1:] == values[:-1]])
        slots = np.unique(twice >> np.uint64(64 - slot_bits))
        words, starts = np.unique(slots >> np.uint64(6), return_index=True)
        one = np.uint64(1) << (slots & np.uint64(63))
        bits = np.bitwise_or.reduceat(one, starts) if len(slots) else one
        return pd.DataFrame({"word": words.astype(np.int64), "bits": bits.view(np.int64)})

    blobs = map_batches(fingerprints.select(column), send, from_arrow_schema(BLOB))
    # Two owners may share the word at their border.
    return (
        blobs.groupBy("owner").applyInPandas(receive, "word bigint, bits bigint")
        .groupBy("word").agg(F.bit_or("bits").alias("bits"))
    )


def bitmap(fingerprints: DataFrame, column: str, slot_bits: int) -> DataFrame:
    """Where fingerprints are, in the form of `duplicate_bitmap`."""
    word, place = _slot(column, slot_bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return fingerprints.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def _slot(column: str, slot_bits: int) -> tuple[Column, Column]:
    """The word of the bitmap that a fingerprint's slot is in, and the bit."""
    slot = F.shiftrightunsigned(column, 64 - slot_bits)
    return F.shiftrightunsigned(slot, 6), slot.bitwiseAND(F.lit(63)).cast("int")


def is_suspect(df: DataFrame, fingerprint: str, bitmap: DataFrame, slot_bits: int) -> DataFrame:
    """Adds the boolean column `suspect_`; `bitmap` goes to all tasks, its size is bounded."""
    word, place = _slot(fingerprint, slot_bits)
    hit = F.call_function("shiftrightunsigned", F.col("bits"), place).bitwiseAND(F.lit(1)) == 1
    joined = df.join(F.broadcast(bitmap), word == F.col("word"), "left")
    return joined.withColumn("suspect_", F.coalesce(hit, F.lit(False))).drop("word", "bits")


def _groups(docs: DataFrame, fingerprint: Column, slot_bits: int):
    """Stored small columns of all documents; groups of suspects; how to mark suspects.

    A group is a fingerprint and SHA-256 with the row that stays, and its size. That its texts
    are equal, byte by byte, is checked when it is read.
    """
    text, sha = text_or_empty(), F.sha2(text_or_empty(), 256).alias("text_sha256")
    row = F.monotonically_increasing_id().alias("row_")
    small = saved(docs.select("doc_id", fingerprint.alias("print_"), sha, row), "fingerprints")
    bits = min(slot_bits, max(12, small.count().bit_length() + 4))
    bitmap = saved(duplicate_bitmap(small, "print_", bits), "duplicate-bitmap")

    def marked(df: DataFrame) -> DataFrame:
        return is_suspect(df, "print_", bitmap, bits)

    best = F.max(F.struct("doc_id", "row_")).alias("best_")
    sizes = marked(small).where("suspect_").groupBy(*KEY).agg(best, F.count("*").alias("size_"))
    texts = docs.select(fingerprint.alias("print_"), sha, text.alias("text_"))
    checked = (
        marked(texts).where("suspect_")
        .groupBy(*KEY, "text_").agg(F.count("*").alias("copies_"))
        .groupBy(*KEY).agg(F.count("*").alias("texts_"), F.sum("copies_").alias("copies_"))
    )
    differ = F.raise_error(F.lit("texts of one SHA-256 differ, or the table changed meanwhile"))
    equal = (F.col("texts_") == 1) & (F.col("copies_") == F.col("size_"))
    size = F.when(equal, F.col("size_")).otherwise(differ.cast("bigint"))
    groups = sizes.join(checked, KEY, "left").select(
        *KEY, F.col("best_.doc_id").alias("keep_id"), F.col("best_.row_").alias("keep_row_"),
        size.alias("group_size"),
    )
    return small, groups, marked


def exact_groups(
    docs: DataFrame, fingerprint: Column | None = None, slot_bits: int = SLOT_BITS
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Needs doc_id and text; other columns are ignored. Null text counts as empty. Of equal
    texts the row with the largest doc_id stays (a null doc_id is the smallest); of rows that
    repeat both text and doc_id only one is kept. No documents give no rows. `fingerprint` is
    a 64-bit hash of the text; a poor one costs time only.
    """
    fingerprint = F.xxhash64(text_or_empty()) if fingerprint is None else fingerprint
    small, groups, marked = _groups(docs, fingerprint, slot_bits)
    rows = marked(small)
    found = rows.where("suspect_").join(groups, KEY, "left").select(
        "doc_id", "keep_id", "group_size", (F.col("keep_row_") == F.col("row_")).alias("kept"),
        "text_sha256",
    )
    single = rows.where("NOT suspect_").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return single.unionByName(found)


def drop_exact(
    docs: DataFrame, fingerprint: Column | None = None, slot_bits: int = SLOT_BITS
) -> DataFrame:
    """The documents that `exact_groups` keeps, with all their columns.

    Documents that are no suspects are neither shuffled nor joined. Suspects meet the rows
    that stay by doc_id and hash, so copies of one text don't meet in one task.
    """
    fingerprint = F.xxhash64(text_or_empty()) if fingerprint is None else fingerprint
    _, groups, marked = _groups(docs, fingerprint, slot_bits)
    rows = marked(docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_"), "doc_id",
        fingerprint.alias("print_"), F.sha2(text_or_empty(), 256).alias("text_sha256"),
    ))
    staying = groups.select(*KEY, "keep_id", F.col("group_size").alias("size_"))
    same = [F.col(f"rows.{c}") == F.col(f"staying.{c}") for c in KEY]
    suspects = rows.where("suspect_").alias("rows").join(
        staying.alias("staying"), [*same, F.col("doc_id").eqNullSafe(F.col("keep_id"))]
    )
    kept = suspects.select(
        "rows.*", F.when(F.col("size_") > 0, F.col("doc_id")).alias("id_")
    ).dropDuplicates([*KEY, "id_"])
    return rows.where("NOT suspect_").select("doc_.*").union(kept.select("doc_.*"))
