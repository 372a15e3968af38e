"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary and one on windows of toxic
text. A window of a text that shares substrings with toxic text gets shorter with the toxic
dictionary. How much shorter, over all windows of a text, is turned into a probability by
thresholds calibrated on labelled documents that the dictionaries were not trained on.

Toxic text is mostly ordinary, and most of what training picks is too. So windows are also
compressed with a third dictionary, whose difference from the ordinary one is nothing but
beginnings of words that set toxic text apart, as far as the sample tells; what that saves is
calibrated along with the rest.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import map_batches, per_text, saved

TOXIC_DOCS = 1500  # labelled documents to learn from, the first by a hash of the id
ORDINARY_DOCS = 4000
FOLDS = 5  # documents of fold 0 are held out
WINDOW = 20  # words
WINDOWS_PER_DOC = 8  # of an ordinary document, for the dictionary
TRAINED_BYTES = 16384  # of a trained dictionary
PARTS = 2  # of the sample: each calibrates with dictionaries trained on the others
BEGINNINGS = range(3, 9)  # letters
CANDIDATES = 2000
LEAST_Z, LEAST_DOCS, LEAST_NEW = 8.0, 5, 0.005
SURE_Z = 15.0
ALIKE, MOST_ALIKE = 0.6, 4  # parts that share this share of their texts: how many may be
REPEATS = 3  # of the toxic part, so that one is near any window
WORD = re.compile(r"[^\W\d_]+")


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def windows(text: str) -> list[bytes]:
    words = text.lower().encode().split()
    return [b" " + b" ".join(words[i : i + WINDOW]) + b" " for i in range(0, len(words), WINDOW)]


def beginnings(text: str) -> set[str]:
    """Beginnings of a text's words, and whole words, which end with a space."""
    out = set()
    for word in set(WORD.findall(text.lower())):
        out.update(word[:n] for n in BEGINNINGS if n <= len(word))
        if len(word) < 2 * BEGINNINGS[-1]:
            out.add(word + " ")
    return out


@functools.lru_cache(8)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    """Finds matches of three bytes; dictionaries as plain content, frames without headers."""
    parameters = zstandard.ZstdCompressionParameters.from_level(
        3, source_size=128, dict_size=len(dictionary), min_match=3,
        strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    content = zstandard.ZstdCompressionDict(
        dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT
    )
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=content)


def _saved(windows_: list[bytes], plain: bytes, other: bytes) -> list[float]:
    """Of the bytes saved in each window: the most, the mean, and shares of 2 and more."""
    a, b = compressor(plain).compress, compressor(other).compress
    less = np.array([len(a(w)) - len(b(w)) for w in windows_] or [0])
    return [float(less.max()), float(less.mean()), float((less >= 2).mean()),
            float((less >= 4).mean())]


N_FEATURES = 8


@dataclass(frozen=True)
class Model:
    """Dictionaries trained on ordinary and on toxic text; the ordinary one filled up, and
    with telling beginnings; and the calibration of what windows save."""

    ordinary: bytes
    toxic: bytes
    filled: bytes
    telling: bytes
    mean: tuple = (0.0,) * N_FEATURES
    scale: tuple = (1.0,) * N_FEATURES
    weights: tuple = (0.0,) * N_FEATURES
    bias: float = 0.0

    def features(self, text: str) -> list[float]:
        found = windows(text)
        return [
            *_saved(found, self.ordinary, self.toxic), *_saved(found, self.filled, self.telling)
        ]

    def score(self, text: str) -> float:
        x = (np.array(self.features(text)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-np.clip(x @ np.array(self.weights) + self.bias, -30, 30))))


def _learning_rows(docs: DataFrame, labels: DataFrame, toxic_docs: int, ordinary_docs: int):
    """Rows (text, toxic) of a bounded sample, equal texts once, and each class's weight."""
    known = labels.where(fold(F.col("doc_id")) != 0).where("toxic IN (0, 1)").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h_")
    )
    total = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    most = {1: toxic_docs, 0: ordinary_docs}
    parts = [known.where(F.col("toxic") == y).orderBy("h_", "doc_id").limit(n) for y, n in most.items()]
    chosen = parts[0].union(parts[1]).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    rows = saved(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-sample")
    # Between the sample's shares of the classes and those of all labels.
    weight = {y: max(total.get(y, 0) / n, 1.0) ** 0.5 for y, n in most.items()}
    return rows, weight


def _telling(rows: DataFrame) -> list[str]:
    """Beginnings of words that set toxic texts apart: by far, or in texts without others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = (Counter(), Counter()), [0, 0]
        for batch in batches:
            for text, y in zip(*(c.to_pylist() for c in batch.columns)):
                counts[y].update(beginnings(text))
                n[y] += 1
        keys = [*(counts[0].keys() | counts[1].keys()), ""]
        counts[0][""], counts[1][""] = n
        yield pa.RecordBatch.from_pydict({
            "part": keys, "toxic": [counts[1][k] for k in keys], "plain": [counts[0][k] for k in keys],
        })

    counted = map_batches(rows.select("text", "toxic"), count, "part string, toxic bigint, plain bigint")
    counted = counted.groupBy("part").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    counted = counted.where((F.col("toxic") >= LEAST_DOCS) | (F.col("part") == "")).collect()
    totals = next((r for r in counted if r.part == ""), None)
    if totals is None or not totals.toxic:
        return []

    def z(row) -> float:
        odds = (row.toxic + 0.5) / (totals.toxic + 1) / ((row.plain + 0.5) / (totals.plain + 1))
        return math.log(odds) * math.sqrt(row.toxic)

    ranked = sorted(
        ((z(r), r.part) for r in counted if r.part and z(r) >= LEAST_Z),
        key=lambda found: (-found[0], -len(found[1]), found[1]),
    )[:CANDIDATES]
    place = {part: i for i, (_, part) in enumerate(ranked)}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[p] for p in beginnings(t) if p in place] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32()))], names=["held"])

    held = map_batches(rows.where("toxic = 1").select("text"), holds, "held array<int>").collect()
    in_text = np.zeros((len(ranked), len(held)), np.float32)
    for i, row in enumerate(held):
        in_text[row.held, i] = 1
    copied = _of_copies(in_text, [part for _, part in ranked])
    with_part = [set(np.flatnonzero(row)) for row in in_text]
    chosen: list[str] = []
    covered: set[int] = set()
    for z_of, part in ranked:
        if copied[place[part]] or any(_related(part, c) for c in chosen):
            continue
        new = with_part[place[part]] - covered
        if z_of >= SURE_Z or len(new) >= max(LEAST_DOCS, LEAST_NEW * totals.toxic):
            chosen.append(part)
            covered |= new
    return chosen


def _related(a: str, b: str) -> bool:
    return a.startswith(b.strip()) or b.startswith(a.strip())


def _of_copies(in_text: np.ndarray, parts: list[str]) -> np.ndarray:
    """Which parts come from near copies of one text: many others are in the same texts."""
    both, each = in_text @ in_text.T, in_text.sum(1)
    alike = both >= ALIKE * np.maximum(each[:, None] + each - both, 1)
    return np.array([
        sum(not _related(part, parts[j]) for j in np.flatnonzero(row)) > MOST_ALIKE
        for part, row in zip(parts, alike)
    ], bool)


def _dictionary(rows: DataFrame) -> bytes:
    """A dictionary trained on windows of some texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = windows(text)
                step = max(1, len(found) // WINDOWS_PER_DOC)
                yield pa.RecordBatch.from_arrays([pa.array(found[::step], pa.binary())], names=["w"])

    found = map_batches(rows.select("text"), cut, "w binary").collect()
    samples = sorted(bytes(row.w) for row in found)
    try:
        return zstandard.train_dictionary(TRAINED_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: all of it
        return b"".join(samples)[-TRAINED_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3):
    """Weighted logistic regression by Newton's method; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        grad = x.T @ (w * (p - y)) + ridge * w.sum() * theta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * w.sum() * np.eye(len(theta))
        step = np.linalg.solve(hess, grad)
        theta -= step
        if abs(step).max() < 1e-8:
            break
    return theta


def trained(
    docs: DataFrame, labels: DataFrame,
    toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS,
) -> Model:
    """A model from at most so many labelled documents of each class, none held out."""
    rows, weight = _learning_rows(docs, labels, toxic_docs, ordinary_docs)
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS))
    telling = "".join(" " + p.strip() for p in _telling(rows)).encode() + b" "
    telling *= REPEATS

    def of(some: DataFrame) -> Model:
        """Not calibrated. Filled up with what no text has, so that matches in the common part of
        the last two dictionaries cost the same."""
        ordinary, toxic = (_dictionary(some.where(F.col("toxic") == y)) for y in (0, 1))
        return Model(ordinary, toxic, ordinary + bytes(len(telling)), ordinary + telling)

    def measured(some: DataFrame, model: Model) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [model.features(text) for text in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"]
                )

        return map_batches(some.select("text", "toxic"), run, "x array<double>, y int").collect()

    model, found = of(rows), []
    for i in range(PARTS):
        found += measured(rows.where(part == i), of(rows.where(part != i)))
    x = np.array([row.x for row in found]).reshape(-1, N_FEATURES)
    y = np.array([row.y for row in found], float)
    if not len(found) or y.min() == y.max():  # nothing to tell apart
        return replace(model, bias=-30.0 if not y.sum() else 30.0)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    theta = _logistic((x - mean) / scale, y, np.where(y == 1, weight[1], weight[0]))
    return replace(
        model, mean=tuple(mean), scale=tuple(scale), weights=tuple(theta[:-1]), bias=float(theta[-1])
    )


def score(text: Column, model: Model) -> Column:
    """The probability that a text is toxic; of null as of an empty text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(text) for text in texts.to_pylist()], pa.float64())

    return per_text(run, "double")(text)


def classified(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    `docs` needs doc_id and text, `labels` doc_id and toxic; other columns are ignored. Labels
    that are null or name no document are ignored; of labels that differ, toxic counts. Null
    text counts as empty, which has the score of a text that saves nothing. A null doc_id is
    not held out. Without labels of both kinds every score is 0 (or 1, if all are toxic).
    """
    value = score(F.col("text"), model or trained(docs, labels)).alias("score")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, value).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )
