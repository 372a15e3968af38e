"""Language of a text, word first.

Each word is scored by its log frequency in each language. A word that learning hasn't seen
falls back to its character n-grams, the longest first, ever shorter ones until some are
known. A text's scores are the sums over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import map_batches, per_text, struct_array

SAMPLE_DOCS = 6000  # documents with a language to learn from, the first by a hash of the id
FOLDS = 5  # documents of fold 0 are held out
WORDS_PER_LANGUAGE = 30_000
LONGEST_GRAM = 5
GRAMS = 60_000  # of each length
MEMORY = 100_000  # unseen words whose scores a worker remembers
CERTAIN = 20  # words after which more don't make a text's score surer
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _log_shares(counts: dict[str, np.ndarray], totals: np.ndarray):
    """Keys, and the log of each one's share in each language; none counts as half a time."""
    keys = list(counts)
    rows = np.stack([counts[key] for key in keys]) if keys else np.zeros((0, len(totals)))
    return keys, np.log(np.maximum(rows, 0.5)) - np.log(totals + 1)


class Model:
    def __init__(self, counts: list[tuple[str, str, int]], documents: dict[str, int]):
        """`counts` has (language, word, number), `documents` the number of each language."""
        self.languages = sorted(documents)
        place = {language: i for i, language in enumerate(self.languages)}
        k = len(place)
        all_docs = max(sum(documents.values()), 1)
        self.prior = np.log([documents[la] / all_docs for la in self.languages] or [1.0])
        by_word: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for language, word, number in counts:
            by_word[word][place[language]] += number
        total = sum(by_word.values(), np.zeros(k))
        known = {w: c for w, c in by_word.items() if c.sum() > 1}
        self.words = _log_shares(known, total)
        self.by_length = {}
        for n in range(LONGEST_GRAM, 0, -1):
            found: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
            for word, c in by_word.items():
                for gram in grams(word, n):
                    found[gram] += np.sqrt(c)  # so that a few frequent words don't make all
            total = sum(found.values(), np.zeros(k))
            most = sorted(found.items(), key=lambda item: (-item[1].sum(), item[0]))[:GRAMS]
            self.by_length[n] = _log_shares(dict(most), total)


class Detector:
    """A model with the scores of the words met so far, one row each."""

    def __init__(self, model: Model):
        self.model = model
        known, scores = model.words
        self.row = {word: i for i, word in enumerate(known)}
        self.scores = np.concatenate([scores, np.zeros((MEMORY + 1, scores.shape[1]))])
        self.free = len(known)
        self.grams = {
            n: ({gram: i for i, gram in enumerate(keys)}, rows)
            for n, (keys, rows) in model.by_length.items()
        }

    def unseen(self, word: str) -> np.ndarray:
        """Scores of a word that learning hasn't seen, by its longest known n-grams."""
        for n in range(min(LONGEST_GRAM, len(word) + 2), 0, -1):
            row, scores = self.grams[n]
            found = [row[gram] for gram in grams(word, n) if gram in row]
            if found:
                return scores[found].mean(0)
        return np.zeros(self.scores.shape[1])

    def detect(self, text: str) -> tuple[str, float]:
        """The likeliest language and its probability; of equal ones the first by name."""
        found = words(text)
        if not self.model.languages or not any(any(map(str.isalpha, word)) for word in found):
            return UNKNOWN, 0.0
        extra = np.zeros(self.scores.shape[1])
        rows = list(map(self.row.get, found))
        if None in rows:
            for i, word in enumerate(found):
                if rows[i] is None:
                    rows[i] = self.row.get(word)
                    if rows[i] is None:
                        rows[i] = self._learn(word, extra)
        total = self.scores[np.array(rows)].sum(0) + extra + self.model.prior
        scaled = total * min(1.0, CERTAIN / len(found))
        share = np.exp(scaled - scaled.max())
        best = int(total.argmax())
        return self.model.languages[best], float(share[best] / share.sum())

    def _learn(self, word: str, extra: np.ndarray) -> int:
        """The row of an unseen word; when memory is full, adds its scores to `extra`."""
        scores = self.unseen(word)
        if self.free < len(self.scores) - 1:
            self.scores[self.free] = scores
            self.row[word] = self.free
            self.free += 1
            return self.free - 1
        extra += scores
        return len(self.scores) - 1  # a row of zeros


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def trained(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """A model from at most `sample` documents with a language, none held out."""
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != 0)
    chosen = known.select("doc_id", F.xxhash64("doc_id").alias("h_")).orderBy("h_", "doc_id").limit(sample)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts[lang, ""] += 1  # the documents themselves
                counts.update((lang, word) for word in words(text))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({
                "lang": [k[0] for k in keys], "word": [k[1] for k in keys],
                "n": [counts[k] for k in keys],
            })

    counted = map_batches(rows.select("lang", "text"), count, "lang string, word string, n bigint")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    documents = {r.lang: r.n for r in counted.where("word = ''").collect()}
    most = [
        counted.where((F.col("lang") == lang) & (F.col("word") != ""))
        .orderBy(F.desc("n"), "word").limit(WORDS_PER_LANGUAGE)
        for lang in sorted(documents)
    ]
    found = [(r.lang, r.word, r.n) for part in most for r in part.collect()]
    return Model(found, documents)


def detect(text: Column, model: Model) -> Column:
    """A struct of lang_pred and score; `und` and 0 for null and for texts without letters."""
    held: list[Detector] = []

    def run(texts: pa.Array) -> pa.Array:
        if not held:
            held.append(Detector(model))
        found = [held[0].detect(t) for t in texts.to_pylist()]
        return struct_array(
            lang_pred=pa.array([f[0] for f in found], pa.string()),
            score=pa.array([f[1] for f in found], pa.float64()),
        )

    return per_text(run, "struct<lang_pred:string, score:double>")(text)


def detected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Needs doc_id and text, and lang to learn; other columns are ignored, and lang is no input
    of a prediction. Texts that are null or have no letter are `und` with score 0, as all are
    if there is nothing to learn from. A null doc_id is not held out. Rows that repeat get
    equal results.
    """
    found = detect(F.col("text"), model or trained(docs)).alias("d_")
    held_out = F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held_out, found).select("doc_id", "held_out", "d_.*")
