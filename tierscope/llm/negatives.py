"""Hard negatives by rotated one-bit codes with error intervals.

Vectors, less their mean, are turned by one random rotation; a code keeps the sign of each
component, next to the vector's norm and its alignment, the cosine between code and vector.
An anchor's turned vector is cut to PLANES bits a component, so its product with a code is a
few popcounts. A vector is its code times norm and alignment, plus a rest at right angles to
the code, whose length is known too. By Cauchy-Schwarz the rest adds at most its length times
what of the anchor is at right angles to the code. That bounds each score from both sides,
surely and not just likely. The rest has a one-bit code and an alignment of its own, and so on:
each of LEVELS codes narrows the intervals to about 3/4 of their width, and further ones are
looked at only while too many pairs remain. Pairs whose interval may matter then get their exact
integer score.

Anchors are a stated set against all rows. Both are dealt to tiles of bounded size, and each
pair of tiles is one group; the smaller side, the anchors, is the one that is repeated. A pair of
tiles returns the best few rows of each anchor only, and these are cut once more before they are
shuffled, so neither a label nor a vector with very many rows gathers anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.llm.common import map_batches, saved, ship

SEED = 11
PLANES = 8  # bits of a component of an anchor
LEVELS = 6  # codes of a vector, each of what the ones before leave
FEW = 0.05  # share of pairs that is scored without looking at further codes
BLOCK = 1 << 20  # pairs at a time
LEAST_ROWS, MOST_ROWS = 1024, 32768  # of a tile
ANCHOR_ROWS = 8192  # of a tile of anchors
SLACK = 1e-9  # of an interval, for rounding
LARGEST = 2**63 - 1


def vectors_of(column: pa.Array, scale: float, width: int | None = None) -> np.ndarray:
    """Lists as rows of floor(scale * x), whole numbers; shorter ones are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width))
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(
        scale * values
    )
    return out


def rotation(width: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, width)))[0]


def packed(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    short = -bits.shape[-1] % 64
    bits = np.pad(bits, [(0, 0)] * (bits.ndim - 1) + [(0, short)])
    return np.packbits(bits, axis=-1, bitorder="little").view("<u8")


class Coder:
    """Codes of vectors, and intervals of their products with anchors."""

    def __init__(self, centre: np.ndarray, scale: float):
        self.centre, self.scale = centre, scale
        self.width, self.turn = len(centre), rotation(len(centre))

    def code(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector: sign bits of every level, norm, and alignment of every level."""
        rest = (vectors - self.centre) @ self.turn.T
        norm, codes, aligned = np.sqrt((rest**2).sum(1)), [], []
        for _ in range(LEVELS):
            along = np.abs(rest).sum(1) / math.sqrt(self.width)
            length = np.sqrt((rest**2).sum(1))
            aligned.append(np.divide(along, length, out=np.zeros_like(along), where=length > 0))
            codes.append(packed(rest > 0))
            rest = rest - np.where(rest > 0, 1, -1) * along[:, None] / math.sqrt(self.width)
        return np.stack(codes, 1), norm, np.minimum(np.stack(aligned, 1), 1)

    def anchors(self, vectors: np.ndarray) -> dict[str, np.ndarray]:
        """Of anchors: bit planes of their turned vectors, and what else intervals need."""
        turned = vectors @ self.turn.T
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / (2**PLANES - 1), 1e-300)
        level = np.clip(np.round((turned - low) / step), 0, 2**PLANES - 1)
        shown = low + step * level
        planes = (level.astype(np.int64)[:, None, :] >> np.arange(PLANES)[None, :, None]) & 1
        return {
            "planes": packed(planes.astype(bool)), "low": low[:, 0], "step": step[:, 0],
            "total": shown.sum(1), "square": (shown**2).sum(1),
            "off": np.sqrt(((turned - shown) ** 2).sum(1)), "norm": np.sqrt((turned**2).sum(1)),
            "centre": vectors @ self.centre,
        }

    def intervals(self, anchors: dict, part: slice | np.ndarray, codes, norm, aligned):
        """Bounds of the score of each anchor of a part with each coded vector, level by level."""
        a = {k: v[part] for k, v in anchors.items()}
        middle, rest = np.repeat(a["centre"][:, None], len(codes), 1), norm
        for level in range(codes.shape[1]):
            code = codes[:, level]
            ones = np.zeros(middle.shape, np.int64)
            for plane in range(PLANES):
                for word in range(code.shape[1]):
                    both = np.bitwise_count(a["planes"][:, None, plane, word] & code[None, :, word])
                    ones += both.astype(np.int64) << plane
            set_bits = np.bitwise_count(code).sum(1, dtype=np.int64)
            shown = a["low"][:, None] * set_bits + a["step"][:, None] * ones
            along = (2 * shown - a["total"][:, None]) / math.sqrt(self.width)
            middle = middle + rest * aligned[:, level] * along
            rest = rest * np.sqrt(np.maximum(1 - aligned[:, level] ** 2, 0))
            across = np.sqrt(np.maximum(a["square"][:, None] - along**2, 0))
            half = rest * across + norm * a["off"][:, None]
            half += SLACK * (norm * a["norm"][:, None] + np.abs(a["centre"])[:, None] + 1)
            low = np.clip(np.nan_to_num(middle - half, nan=-np.inf), -LARGEST, LARGEST)
            high = np.clip(np.nan_to_num(middle + half, nan=np.inf), -LARGEST, LARGEST)
            yield low, high


def scores(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows a[i] and b[j] of whole numbers; beyond a long they stay there."""
    if not len(i):
        return np.zeros(0, np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2**53:
        if len(i) > len(a) * len(b) // 8:
            return (a @ b.T)[i, j].astype(np.int64)
        return np.concatenate([
            np.einsum("ij,ij->i", a[i[s : s + BLOCK // 8]], b[j[s : s + BLOCK // 8]])
            for s in range(0, len(i), BLOCK // 8)
        ]).astype(np.int64)
    whole = [[int(x) for x in row] for row in a], [[int(x) for x in row] for row in b]
    exact = (sum(map(int.__mul__, whole[0][p], whole[1][q])) for p, q in zip(i, j))
    return np.array([max(-LARGEST, min(LARGEST, s)) for s in exact], np.int64)


def best(i: np.ndarray, score: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each i, smaller ties first."""
    order = np.lexsort((tie, -score, i))
    of = i[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return order[rank < k]


def kth(values: np.ndarray, k: int) -> np.ndarray:
    """The kth largest of each row; -inf where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def _tile(table: pa.Table, coder: Coder) -> dict[str, np.ndarray]:
    out = {c: table[c].to_numpy() for c in ("row_", "vec_id", "label")}
    return out | {"v": vectors_of(table["embedding"], coder.scale, coder.width)}


def _codes(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(table["code"].to_pylist()), "<u8")
    aligned = table["alignment"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    shape = (table.num_rows, LEVELS, -1)
    return codes.reshape(shape), table["norm"].to_numpy(), aligned.reshape(shape[:2])


def _blocks(anchors: dict, rows: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Anchors of one label, a block at a time, and the rows of the same label or of others."""
    for label in np.unique(anchors["label"]):
        among = np.flatnonzero((rows["label"] == label) == same)
        of = np.flatnonzero(anchors["label"] == label)
        step = max(1, BLOCK // max(len(among), 1))
        for start in range(0, len(of) if len(among) else 0, step):
            yield of[start : start + step], among


def best_same(coder: Coder, rows: dict, codes: tuple, anchors: dict, k: int):
    """Of a pair of tiles: anchor, row and score of each anchor's k best of its own label."""
    queries, found = coder.anchors(anchors["v"]), []
    for of, among in _blocks(anchors, rows, same=True):
        self_ = anchors["row_"][of][:, None] == rows["row_"][among]
        for low, high in coder.intervals(queries, of, *[c[among] for c in codes]):
            low[self_] = -np.inf
            wanted = (high >= kth(low, k)[:, None]) & ~self_
            if wanted.mean() < FEW:
                break
        i, j = np.nonzero(wanted)
        s = scores(anchors["v"][of], rows["v"][among], i, j)
        top = best(i, s, rows["vec_id"][among][j], k)
        found.append((of[i[top]], among[j[top]], s[top]))
    return found


def best_others(coder: Coder, rows: dict, codes: tuple, anchors: dict, floor, ceiling, k: int):
    """Of a pair of tiles: anchor, slot, row and score of the k best rows of other labels whose
    score lies between floor and ceiling, which each anchor has one of for each slot."""
    queries, found = coder.anchors(anchors["v"]), []
    for of, among in _blocks(anchors, rows, same=False):
        for low, high in coder.intervals(queries, of, *[c[among] for c in codes]):
            wanted = np.zeros(low.shape, bool)
            for slot in range(floor.shape[1]):
                least, most = (x[of, slot, None].astype(float) for x in (floor, ceiling))
                sure = np.where((low >= least) & (high <= most), low, -np.inf)
                wanted |= (high >= np.maximum(least, kth(sure, k)[:, None])) & (low <= most)
            if wanted.mean() < FEW:
                break
        i, j = np.nonzero(wanted)
        s = scores(anchors["v"][of], rows["v"][among], i, j)
        for slot in range(floor.shape[1]):
            fits = np.flatnonzero((s >= floor[of[i], slot]) & (s <= ceiling[of[i], slot]))
            top = fits[best(i[fits], s[fits], rows["vec_id"][among][j[fits]], k)]
            found.append((of[i[top]], np.full(len(top), slot), among[j[top]], s[top]))
    return found


def _joined(found: list, columns: int) -> list[np.ndarray]:
    parts = zip(*found) if found else [[]] * columns
    return [np.concatenate([*p, np.zeros(0, np.int64)]).astype(np.int64) for p in parts]


def coded(vectors: DataFrame, scale: float) -> tuple[DataFrame, Coder]:
    """The rows that take part, stored with a number each and their codes; and the coder."""
    rows = vectors.where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    ).where(F.forall("embedding", lambda x: (
        x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ))).select(
        F.monotonically_increasing_id().alias("row_"), F.col("vec_id").cast("bigint"),
        F.col("label").cast("bigint"), "embedding",
    )

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(0), 0
        for batch in batches:
            more = vectors_of(batch.column(0), scale)
            n += len(more)
            size = max(len(total), more.shape[1])
            total = np.pad(total, (0, size - len(total)))
            total[: more.shape[1]] += more.sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(total), pa.array([n] * len(total), pa.int64())],
            names=["place", "total", "n"],
        )

    sums = map_batches(rows.select("embedding"), totals, "place bigint, total double, n bigint")
    means = sorted(sums.groupBy("place").agg(F.sum("total") / F.sum("n")).collect())  # one a component
    centre = np.array([mean for _, mean in means] or [0.0])
    coder = Coder(np.where(np.isfinite(centre), centre, 0), scale)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, norm, aligned = coder.code(vectors_of(batch["embedding"], scale, coder.width))
            columns = [*batch.columns, pa.array([b.tobytes() for b in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(norm), pa.array(list(aligned), pa.list_(pa.float64()))],
                names=[*batch.schema.names, "code", "norm", "alignment"],
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    schema = (
        f"row_ bigint, vec_id bigint, label bigint, embedding {kind}, "
        "code binary, norm double, alignment array<double>"
    )
    return saved(map_batches(rows, code, schema), "codes"), coder


def _dealt(rows: DataFrame, anchors: DataFrame, function, schema: str) -> DataFrame:
    """Runs a function on each pair of tiles of rows and of anchors."""
    n, n_anchors = rows.count(), anchors.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = min(MOST_ROWS, max(LEAST_ROWS, n // (4 * cores)))
    tiles, blocks = max(1, math.ceil(n / size)), max(1, math.ceil(n_anchors / ANCHOR_ROWS))

    def own(parts: int) -> Column:
        return F.pmod(F.xxhash64("row_"), F.lit(parts)).cast("int")

    def all_of(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = rows.withColumn("tile", own(tiles)).withColumn("block", all_of(blocks))
    right = anchors.withColumn("block", own(blocks)).withColumn("tile", all_of(tiles))
    ship()
    keys = ["tile", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(function, schema)


def _first(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k highest scores of a key, smaller vec_id first, with their rank from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "other_row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """For each anchor and positive, the best rows of other labels that are near, but not too near.

    Components become floor(scale * x); a score is the integer inner product with the anchor.
    An anchor's positives are its first `positives` other rows of the same label; a negative's
    score, in percent of the positive's, lies between `low` and `high`. Returns anchor_id,
    positive_id, rank (from 1), negative_id, positive_score, negative_score; all if there are
    fewer than asked for, no rows where there are none.

    `vectors` has vec_id, label (whole numbers) and embedding (an array of float or double);
    `is_anchor` is a condition on them. Other columns are ignored. A row with a null in any of the
    three, or a null or non-finite component, takes no part. Higher scores come first, ties by
    vec_id. Rows that repeat are rows of their own: the copy of an anchor is another row, and
    which of two rows of one vec_id comes first makes no difference to what is returned. Vectors
    may differ in length: what is missing counts as 0. Scores beyond a long count as the largest.
    """
    rows, coder = coded(vectors, scale)
    columns = ["row_", "vec_id", "label", "embedding"]
    anchors = rows.where(is_anchor).select(*columns)

    def same_label(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _tile(right, coder), _tile(left, coder)
        found = best_same(coder, b, _codes(left), a, positives) if len(b["v"]) and len(a["v"]) else []
        i, j, score = _joined(found, 3)
        return pa.table({
            "row_": a["row_"][i], "other_row": b["row_"][j], "vec_id": b["vec_id"][j], "score": score,
        })

    near = _dealt(rows, anchors, same_label, "row_ bigint, other_row bigint, vec_id bigint, score bigint")
    slots = _first(near, ["row_"], positives).groupBy("row_").agg(
        F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("slots")
    ).select(
        "row_", F.col("slots.vec_id").alias("ids"), F.col("slots.score").alias("scores")
    )
    asked = saved(anchors.join(slots, "row_"), "positives")

    def other_label(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _tile(right, coder), _tile(left, coder)
        ids, given = right["ids"].to_pylist(), right["scores"].to_pylist()
        floor = np.full((len(ids), positives), LARGEST)
        ceiling = np.full((len(ids), positives), -LARGEST)
        for i, row in enumerate(given):
            floor[i, : len(row)] = [-(-low * s // 100) for s in row]
            ceiling[i, : len(row)] = [high * s // 100 for s in row]
        usable = len(b["v"]) and len(a["v"])
        found = best_others(coder, b, _codes(left), a, floor, ceiling, negatives) if usable else []
        i, slot, j, score = _joined(found, 4)
        return pa.table({
            "row_": a["row_"][i], "anchor_id": a["vec_id"][i], "slot": slot,
            "positive_id": pa.array([ids[x][y] for x, y in zip(i, slot)], pa.int64()),
            "positive_score": pa.array([given[x][y] for x, y in zip(i, slot)], pa.int64()),
            "other_row": b["row_"][j], "vec_id": b["vec_id"][j], "score": score,
        })

    schema = ", ".join(f"{c} bigint" for c in (
        "row_", "anchor_id", "slot", "positive_id", "positive_score", "other_row", "vec_id", "score"
    ))
    found = _dealt(rows, asked, other_label, schema)
    return _first(found, ["row_", "slot"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
