"""Near duplicates by SimHash, compared exactly in tiles.

Fingerprints are grouped into tiles by the population counts of their parts. Two fingerprints
within a radius differ by no more than the radius in these counts, so tile pairs further
apart are skipped. The others are compared with exclusive-or and bit counts, all against all.
More parts make tiles finer: there are more pairs of tiles, but fewer comparisons.

Copies of a fingerprint are one node. A comparison of two tiles returns a spanning forest of
what it links, so a large group doesn't come out as all its pairs.

Where near is a Jaccard similarity, an exact check follows: of the pairs that fingerprints link,
those stay linked whose sets of shingles are similar. No pair is linked by its sets alone, and
documents of one fingerprint are one node only if their sets are equal.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm import exact
from tierscope.llm.common import encoded, map_batches, per_text, saved, struct_array, text_or_empty
from tierscope.llm.components import components

SEED = 42
TILE_ROWS = 4096
BLOCK = 1 << 20  # comparisons at a time
BASE = 256  # place value of a coordinate in a cell number
FIRST_WORDS = 5  # of a fingerprint that all pairs compare, of more only the pairs they leave
HASHES = 1 << 15  # hashes whose bits are counted at a time
SET_ROWS, SET_BYTES = 512, 4 << 20  # of sets of shingles in a tile
COLUMNS = 1 << 12  # shingles whose sets are multiplied at a time
MISSED = 1e-9  # chance at most that fingerprints of two sets at the limit are too far apart


@dataclass(frozen=True)
class Near:
    """What counts as near: shingles of `words` words, fingerprints of `width` 64-bit words
    that differ in `radius` bits at most, and, if `similarity` is given, numbers of shingles
    whose ratio doesn't rule out that Jaccard similarity. `repeats`: whether a shingle counts
    as often as it comes. `parts` and `step` shape the tiles: population counts are taken of
    so many parts, in steps.

    If `confirmed` is given, of the links of fingerprints those count whose sets have that Jaccard
    similarity at least. `reaches` then widens the radius, as small sets' fingerprints scatter
    more: by the step of the smaller set's size, the last for all larger ones.
    """

    words: int = 3
    width: int = 1
    radius: int = 2
    similarity: float | None = None
    repeats: bool = True
    parts: int = 4
    step: int = 1
    reaches: tuple[int, ...] = ()
    confirmed: float | None = None

    @property
    def reach(self) -> int:
        return max(self.reaches, default=self.radius)

    def reach_of(self, sizes: np.ndarray) -> np.ndarray:
        """In how many bits fingerprints may differ, by the number of shingles of the smaller set."""
        if not self.reaches:
            return np.full(len(sizes), self.radius)
        steps = size_steps(sizes, self.similarity)
        return np.array(self.reaches)[np.minimum(steps, len(self.reaches) - 1)]

    @classmethod
    def jaccard(cls, similarity: float = 0.8, words: int = 5, width: int = 8, slack: float = 0.02):
        """Near means a Jaccard similarity of sets of shingles, confirmed by the sets.

        The share of differing bits is about the angle between two sets as vectors, and more
        for small sets: at 0.8 at most 3/16, of 4 shingles of 5. Fingerprints link so far apart
        that a similar pair of any size is missed with the chance MISSED at most. `slack` is of
        the estimate, and of the ratio of sizes.
        """
        least = similarity - slack
        radius = round(64 * width * math.acos(2 * least / (1 + least)) / math.pi)
        shares = most_apart(similarity)
        steps = size_steps(np.arange(1, len(shares) + 1), least)
        reaches = [radius] * (1 + int(steps[-1]))
        for step, share in zip(steps, shares):  # no wider for larger sets
            reaches[: step + 1] = np.maximum(reaches[: step + 1], reach_for(64 * width, share)).tolist()
        return cls(
            words, width, radius, least, repeats=False, parts=1, step=max(reaches),
            reaches=tuple(reaches), confirmed=similarity,
        )

    def offsets(self) -> list[int]:
        """From a cell to those that may hold near fingerprints, each pair of cells once."""
        reach = range(-self.reach, self.reach + 1)

        def least(d: int) -> int:  # difference of counts that d steps imply
            return (abs(d) - 1) * self.step + 1 if d else 0

        shapes = [(0,)] if self.similarity is None else [(-1,), (0,), (1,)]
        moves = [
            shape + d for shape in shapes for d in itertools.product(reach, repeat=self.parts)
            if sum(map(least, d)) <= self.reach
        ]
        cells = (sum(d * BASE**i for i, d in enumerate(reversed(move))) for move in moves)
        return sorted({cell for cell in cells if cell >= 0})


@functools.cache
def most_apart(similarity: float, sizes: int = 40) -> tuple[float, ...]:
    """The largest share of bits that differ on average, of two unequal sets of that Jaccard
    similarity at least, by the size of the smaller: 1 up to `sizes`, then all larger ones.

    Exactly for small sets, from so many shingles in common, and so many that only the one or
    only the other has. It falls towards that of the angle, so larger sets have no more than the
    upper half of these sizes.
    """
    def ones(n: int, least: int) -> float:  # chance of so many among n
        return sum(math.comb(n, i) for i in range(max(least, 0), n + 1)) / 2**n

    most = [0.0] * (sizes + 1)
    for common in range(1, sizes + 1):
        for single in range(1, math.floor(common / similarity - common + 1e-9) + 1):
            for a in range(single // 2 + 1):
                b, apart = single - a, 0.0
                if common + a > sizes:
                    continue
                for x in range(common + 1):
                    in_a = ones(a, (common + a) // 2 + 1 - x)
                    in_b = ones(b, (common + b) // 2 + 1 - x)
                    share = math.comb(common, x) / 2**common
                    apart += share * (in_a * (1 - in_b) + in_b * (1 - in_a))
                most[common + a - 1] = max(most[common + a - 1], apart)
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    most[sizes] = max(angle, *most[sizes // 2 : sizes])
    return tuple(most)


def reach_for(bits: int, share: float) -> int:
    """The number of differing bits that is exceeded with the chance MISSED at most, if each bit
    differs with the chance `share`."""
    if not share:
        return 0
    beyond = 0.0
    for i in range(bits, 0, -1):
        ways = math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1)
        beyond += math.exp(ways + i * math.log(share) + (bits - i) * math.log1p(-share))
        if beyond > MISSED:
            return i
    return 0


def size_steps(sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Steps of the ratio of sizes that a Jaccard similarity allows; similar sets are in the same
    or in neighbouring steps."""
    return (np.log(np.maximum(sizes, 1)) / -np.log(similarity)).astype(np.int64)


def shingle_hashes(data: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of all words if there are fewer, if any."""
    found = data.lower().split()  # bytes: ASCII letters and white space only
    if not found:
        return np.zeros(0, np.uint64)
    rows = zip(*[found[i:] for i in range(words)]) if len(found) >= words else [found]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(b" ".join(row), SEED) for row in rows], np.uint64)


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """Further hashes made from 64-bit hashes; i = 0 gives themselves."""
    if i == 0:
        return hashes
    out = hashes + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out = (out ^ (out >> np.uint64(shift))) * np.uint64(factor)
    return out ^ (out >> np.uint64(31))


def simhash(hashes: np.ndarray) -> int:
    """64 bits, each set if set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), HASHES):
        bits = np.unpackbits(hashes[i : i + HASHES].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, 64).sum(0, dtype=np.uint32)
    set_bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def set_hash(hashes: np.ndarray) -> bytes:
    """Of shingles' hashes, in any order and number."""
    return xxhash.xxh3_128_digest(np.unique(hashes).tobytes())


def fingerprint(text: Column, near: Near) -> Column:
    """Of each text: `bits`, an array of 64-bit words, `cell`, the number of its tile cell, and
    `set`, a 128-bit hash of its shingles where links are confirmed by them, otherwise NULL."""
    per_part = 64 * near.width // near.parts

    def run(texts: pa.Array) -> pa.Array:
        prints, sizes, sets = [], [], []
        for data in encoded(texts):
            hashes = shingle_hashes(data, near.words)
            hashes = hashes if near.repeats else np.unique(hashes)
            prints.append([simhash(mixed(hashes, i)) for i in range(near.width)])
            sizes.append(len(hashes))
            sets.append(set_hash(hashes) if near.confirmed is not None else None)
        words = np.array(prints, "<u8").reshape(-1, near.width)
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        counts = bits.reshape(-1, near.parts, per_part).sum(2).astype(np.int64) // near.step
        cells = np.zeros(len(words), np.int64)
        if near.similarity is not None:
            cells += size_steps(np.array(sizes), near.similarity)
        for i in range(near.parts):
            cells = cells * BASE + counts[:, i]
        flat = pa.array(words.astype(np.int64).reshape(-1))
        ends = pa.array(np.arange(0, len(flat) + 1, near.width, dtype=np.int32))
        return struct_array(
            bits=pa.ListArray.from_arrays(ends, flat), cell=pa.array(cells),
            set=pa.array(sets, pa.binary()),
        )

    return per_text(run, "struct<bits:array<bigint>, cell:bigint, set:binary>")(text)


def forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links u - v."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, u, least)
        np.minimum.at(new, v, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def compare(a: np.ndarray, b: np.ndarray | None, radius: int) -> np.ndarray:
    """Root of each row of a, then of b, where rows within the radius are linked.

    Rows are fingerprints of one or more words. Without b, rows of a are compared.
    """
    same, b = b is None, a if b is None else b
    n = len(a) if same else len(a) + len(b)
    shift = 0 if same else len(a)
    root, rows = np.arange(n), max(1, BLOCK // max(len(b), 1))
    for start in range(0, len(a), rows):
        part = a[start : start + rows]
        apart = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        for w in range(1, min(a.shape[1], FIRST_WORDS)):
            apart += np.bitwise_count(part[:, None, w] ^ b[None, :, w])
        i, j = np.nonzero(apart <= radius)
        if a.shape[1] > 3:  # all words, where the first leave it open or overflow 8 bits
            near = np.bitwise_count(part[i] ^ b[j]).sum(1, dtype=np.int64) <= radius
            i, j = i[near], j[near]
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            moved = np.flatnonzero(root != np.arange(n))
            root = forest(n, np.append(i, moved), np.append(j + shift, root[moved]))
    return root


def link(nodes: DataFrame, near: Near, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs within the radius do.

    `nodes` has node (a unique number), bits and cell, and should be a stored table.
    """
    counts = nodes.groupBy("cell").agg(F.count("*").alias("n"))
    cells = saved(
        counts.select("cell", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts")), "cells"
    )
    tiles = saved(
        nodes.join(cells, "cell")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .groupBy("cell", "part")
        .agg(F.collect_list(F.struct("node", *[
            F.col("bits")[i].alias(f"w{i}") for i in range(near.width)
        ])).alias("rows")),
        "tiles",
    )
    offset = F.explode(F.array(*[F.lit(d).cast("bigint") for d in near.offsets()]))
    first = cells.select(F.col("cell").alias("cell_a"), F.col("parts").alias("parts_a"), offset.alias("d"))
    pairs = (
        first.join(
            cells.select(F.col("cell").alias("cell_b"), F.col("parts").alias("parts_b")),
            F.col("cell_a") + F.col("d") == F.col("cell_b"),
        )
        .withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts_a") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .where((F.col("cell_a") < F.col("cell_b")) | (F.col("part_a") <= F.col("part_b")))
        .select("cell_a", "part_a", "cell_b", "part_b")
    )
    sides = [
        tiles.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cell", "part", "rows")]) for s in "ab"
    ]
    reaches = near.reaches or (near.radius,)
    step = F.floor(F.col("cell_a") / BASE**near.parts)  # of size, not above that of cell_b
    reach = F.element_at(F.array(*map(F.lit, reaches)), F.least(step + 1, F.lit(len(reaches))).cast("int"))
    work = pairs.join(sides[0], ["cell_a", "part_a"]).join(sides[1], ["cell_b", "part_b"]).select(
        "rows_a", F.when(
            (F.col("cell_a") != F.col("cell_b")) | (F.col("part_a") != F.col("part_b")),
            F.col("rows_b"),
        ).alias("rows_b"), reach.alias("reach"),
    )
    width = near.width

    def unpack(column: pa.ListArray):
        """Nodes and fingerprints of each row's list; none for null."""
        values = column.values
        ids = values.field("node").to_numpy()
        words = np.stack(
            [values.field(f"w{i}").to_numpy().view(np.uint64) for i in range(width)], axis=1
        )
        ends, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        return [
            (ids[s:e], words[s:e]) if ok else (ids[:0], None)
            for s, e, ok in zip(ends[:-1], ends[1:], valid)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            sides, reach = batch.columns[:2], batch.column(2).to_pylist()
            for (ids_a, a), (ids_b, b), radius in zip(*map(unpack, sides), reach):
                root = compare(a, b, radius)
                moved = np.flatnonzero(root != np.arange(len(root)))
                if len(moved):
                    ids = np.append(ids_a, ids_b)
                    found.append(np.stack([ids[moved], ids[root[moved]]]))
            out = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return map_batches(work, run, "a bigint, b bigint")


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of sets of that Jaccard similarity at least; that of empty sets is 1."""
    sizes = np.array(list(map(len, sets)), np.int64)
    values, which, counts = np.unique(
        np.concatenate([*sets, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True
    )
    shared = np.cumsum(counts > 1) - 1
    row, hit = np.repeat(np.arange(len(sets)), sizes), counts[which] > 1
    row, column = row[hit], shared[which[hit]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for start in range(0, int((counts > 1).sum()), COLUMNS):
        s, e = np.searchsorted(column, [start, start + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[s:e], column[s:e] - start] = 1
        common += (held @ held.T).astype(np.int64)
    either = sizes[:, None] + sizes - common
    return np.nonzero(np.triu(common >= similarity * either - 1e-9, 1))


def confirm(docs: DataFrame, nodes: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs do that fingerprints link and whose
    sets are similar.

    `nodes` has node, bits, root (of what fingerprints link), doc_id and text_hash of one
    document of the node. Only these documents' texts are shuffled. A component of many sets
    is dealt to tiles, of which each pair is one task's row.
    """
    slot_bits = min(exact.SLOT_BITS, max(12, nodes.count().bit_length() + 8))
    bitmap = saved(exact.bitmap(nodes, "text_hash", slot_bits), "candidates-bitmap")
    texts = exact.is_suspect(
        docs.select("doc_id", F.xxhash64(text_or_empty()).alias("text_hash"), "text"),
        "text_hash", bitmap, slot_bits,
    ).where("suspect_").alias("t")
    words = near.words

    def hashed(texts: pa.Array) -> pa.Array:
        return pa.array(
            [np.unique(shingle_hashes(t, words)).tobytes() for t in encoded(texts)], pa.binary()
        )

    sets = saved(
        texts.join(nodes.alias("n"), [
            F.col("t.text_hash") == F.col("n.text_hash"),
            F.col("t.doc_id").eqNullSafe(F.col("n.doc_id")),
        ]).select(
            "node", "root", "bits", per_text(hashed, "binary")(F.col("text")).alias("shingles")
        )
        .dropDuplicates(["node"]),
        "shingles",
    )
    sizes = sets.groupBy("root").agg(
        F.count("*").alias("n"), F.sum(F.length("shingles")).alias("bytes")
    ).select("root", F.ceil(
        F.greatest(F.col("n") / SET_ROWS, F.col("bytes") / SET_BYTES, F.lit(1))
    ).cast("int").alias("parts"))
    sizes = saved(sizes, "candidates")
    tiles = saved(
        sets.join(sizes, "root")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .groupBy("root", "part").agg(F.collect_list(F.struct("node", "bits", "shingles")).alias("rows")),
        "set-tiles",
    )
    pairs = (
        sizes.withColumn("part_a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.col("part_a"), F.col("parts") - 1)))
        .select("root", "part_a", "part_b")
    )
    sides = [
        tiles.select("root", F.col("part").alias(f"part_{s}"), F.col("rows").alias(f"rows_{s}"))
        for s in "ab"
    ]
    work = pairs.join(sides[0], ["root", "part_a"]).join(sides[1], ["root", "part_b"]).select(
        "rows_a", F.when(F.col("part_a") != F.col("part_b"), F.col("rows_b")).alias("rows_b")
    )
    similarity, width = near.confirmed, near.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((2, 0), np.int64)]
            for row in range(batch.num_rows):
                held = [c[row].values for c in batch.columns if c[row].is_valid]
                ids = np.concatenate([h.field("node").to_numpy() for h in held])
                data = [v for h in held for v in h.field("shingles").to_pylist()]
                bits = np.concatenate([h.field("bits").flatten().to_numpy() for h in held])
                bits = bits.view(np.uint64).reshape(-1, width)
                i, j = similar([np.frombuffer(v, np.uint64) for v in data], similarity)
                sizes = np.array([len(v) // 8 for v in data], np.int64)
                reach = near.reach_of(np.minimum(sizes[i], sizes[j]))
                linked = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= reach
                i, j = i[linked], j[linked]
                root = forest(len(ids), i, j)
                moved = np.flatnonzero(root != np.arange(len(root)))
                found.append(np.stack([ids[moved], ids[root[moved]]]))
            out = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], names=["a", "b"])

    return map_batches(work, run, "a bigint, b bigint")


def keep_one(docs: DataFrame, near: Near | None = None) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id, all columns.

    By default near means fingerprints of 512 bits that differ in 152 bits at most for sets of up
    to 4 shingles, 136 up to 15 and 134 of more, confirmed by a Jaccard similarity of 0.8 on
    shingles of five words; links join groups, so two documents of one group may be less similar.
    Documents that no group drops are neither shuffled nor joined, but for those that share their
    place in a bitmap of bounded size. Just one row of a group stays: one without doc_id only if
    the group has no other, one of several texts with the smallest doc_id, and one of rows that
    repeat both text and doc_id.
    """
    groups = _rooted(docs, near or Near.jaccard()).where("group_size > 1")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = groups.groupBy("root").agg(F.min(key).alias("first"))
    marked = saved(
        groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
        .join(first, "root")
        .select("doc_id", "text_hash", "copies", key.eqNullSafe(F.col("first")).alias("first"))
        .where("NOT first OR copies > 1"),
        "marked",
    )
    slot_bits = min(exact.SLOT_BITS, max(12, marked.count().bit_length() + 8))
    bitmap = saved(exact.bitmap(marked, "text_hash", slot_bits), "marked-bitmap")
    rows = exact.is_suspect(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_"),
            "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"),
        ),
        "text_hash", bitmap, slot_bits,
    )
    suspects = rows.where("suspect_").alias("rows")

    def of(marks: DataFrame) -> list[Column]:
        return [
            F.col("rows.text_hash") == marks["text_hash"],
            F.col("rows.doc_id").eqNullSafe(marks["doc_id"]),
        ]

    repeated = marked.where("first")
    one = suspects.join(repeated, of(repeated), "left_semi").dropDuplicates(["doc_id", "text_hash"])
    parts = [rows.where("NOT suspect_"), suspects.join(marked, of(marked), "left_anti"), one]
    return functools.reduce(DataFrame.union, [part.select("doc_.*") for part in parts])


def grouped(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per document: doc_id, bits, text_hash, component_id, group_size.

    component_id is the smallest doc_id that links reach, its own included; group_size counts
    the documents of the component. Needs doc_id and text; other columns are ignored. Null
    text counts as empty; texts without words have the fingerprint zero and link like any
    other. Rows that repeat are rows of the result. A null doc_id is never the smallest
    unless the component has no other. No documents give no rows.
    """
    return _rooted(docs, near).drop("root")


def _rooted(docs: DataFrame, near: Near) -> DataFrame:
    """The rows of `grouped` with `root`, a number of the component."""
    confirmed = near.confirmed is not None
    same = ["bits", "cell", "set"] if confirmed else ["bits", "cell"]  # one node
    prints = saved(
        docs.select(
            "doc_id", F.xxhash64(text_or_empty()).alias("text_hash"),
            fingerprint(F.col("text"), near).alias("p"),
        ).select("doc_id", "text_hash", "p.bits", "p.cell", *(["p.set"] if confirmed else [])),
        "prints",
    )
    one = [F.min(F.struct("doc_id", "text_hash")).alias("one")] if confirmed else []
    nodes = saved(
        prints.groupBy(*same)
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), *one)
        .withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    roots = components(link(nodes, near))
    if confirmed:
        candidates = nodes.join(roots, "node").select(
            "node", "root", "bits", "one.doc_id", "one.text_hash"
        )
        roots = components(confirm(docs, saved(candidates, "maybe-near"), near))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("copies").alias("group_size")
    )
    of_print = rooted.join(least, "root").select(*same, "component_id", "group_size", "root")
    return prints.join(of_print, same, "left").select(
        "doc_id", "bits", "text_hash", "component_id", "group_size", "root"
    )
