"""Best-fit packing of token sequences.

Bounded-space online best-fit: a fixed number of bins is open; a bitset keyed by free space
finds the open bin that a piece fills best. When a piece fits no open bin, a new one is
opened, and the fullest closes first if there are as many as allowed.

Packing sees lengths only, so what is shuffled is small. Pieces are dealt to tasks by a hash,
each task with enough of them that the bins left open at its end count for little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import map_batches, per_text, saved
from tierscope.llm.words import ENCODE_BYTES, encoder

OPEN_BINS = 1024
BINS_PER_TASK = 8192  # bins that a task fills; it leaves OPEN_BINS of them open at most
PIECE = "struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint,ids:array<int>>"


class Bins:
    """Open bins of one capacity; `place` returns a bin's number and the place in it."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used_free = 0  # bit f is set if an open bin has f places free
        self.open = self.count = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        number = bins.pop()
        if not bins:
            self.used_free ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.used_free >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.capacity, self.count
            self.count += 1
            if self.open == self.most and length < free:
                fullest = (self.used_free & -self.used_free).bit_length() - 1
                self._take(fullest)
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.used_free |= 1 << left
            self.open += 1
        return number, self.capacity - free


def token_pieces(
    text: Column, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False
) -> Column:
    """The pieces of a text as an array of structs: piece, start, length, ids_crc32, ids.

    A text's ids by the tokenizers library, then `end_id`; only what is longer than
    `capacity` is cut. An empty or null text is the end id alone. `ids` is null unless asked
    for.
    """

    def cut(texts: pa.Array) -> pa.Array:
        offsets, ids = encoder(vocabulary).encode(texts)
        rows = []
        for begin, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            whole = np.append(ids[begin:end], np.uint32(end_id))
            rows.append([
                (i, start, len(part), zlib.crc32(part.tobytes()), part if keep_ids else None)
                for i, start in enumerate(range(0, len(whole), capacity))
                for part in (whole[start : start + capacity],)
            ])
        kind = pa.struct([
            ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
            ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32())),
        ])
        fields = [f.name for f in kind]
        return pa.array([[dict(zip(fields, p)) for p in row] for row in rows], pa.list_(kind))

    return per_text(cut, f"array<{PIECE}>", ENCODE_BYTES)(text)


def pack(
    pieces: DataFrame,
    length: str,
    key: list[str],
    capacity: int = 4096,
    open_bins: int = OPEN_BINS,
    bins_per_task: int = BINS_PER_TASK,
) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a length from 1 to the capacity.

    `key` tells rows apart and sets the order they are packed in, by its hash; equal rows are
    placed one after another. No row of the result lacks a place: a null or impossible
    length raises. `pieces` is read twice (once for its total length), so it should be a
    stored table. The two new columns replace columns of the same names.
    """
    pieces = pieces.drop("sequence_id", "offset")
    total = pieces.agg(F.sum(length)).first()[0] or 0
    tasks = max(1, round(total / (capacity * bins_per_task)))
    fields = [(f.name, f.dataType.simpleString()) for f in pieces.schema.fields]
    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, first = Bins(capacity, open_bins), TaskContext.get().partitionId() << 33
        for batch in batches:
            lengths = batch.column(length).to_pylist()
            if any(n is None or not 0 < n <= capacity for n in lengths):
                raise ValueError(f"lengths must be from 1 to {capacity}")
            placed = np.array([bins.place(n) for n in lengths], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])],
                names=[*batch.schema.names, "sequence_id", "offset"],
            )

    order = F.xxhash64(*key)
    dealt = pieces.repartition(tasks, order).sortWithinPartitions(order, *key)
    return map_batches(dealt, place, schema)


def pack_documents(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 4096,
    end_id: int = 1,
    open_bins: int = OPEN_BINS,
    bins_per_task: int = BINS_PER_TASK,
    keep_ids: bool = False,
) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Needs doc_id and text; other columns are ignored. A null text counts as empty, which is
    one piece of the end id alone. Each row is packed, also one that repeats a doc_id or has
    none. No documents give no rows. `keep_ids` adds the ids themselves.
    """
    piece = token_pieces(F.col("text"), vocabulary, capacity, end_id, keep_ids)
    rows = docs.select("doc_id", F.explode(piece).alias("piece_")).select("doc_id", "piece_.*")
    rows = rows if keep_ids else rows.drop("ids")
    return pack(
        saved(rows, "pieces"), "length", ["doc_id", "piece", "ids_crc32", "length"],
        capacity, open_bins, bins_per_task,
    )
