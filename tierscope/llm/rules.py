"""Quality rules as a short-circuit cascade.

Each rule rejects texts by a measure of its own. On a sample the cascade measures what each
rule costs and how many texts it rejects, and runs them by rejections per cost; a text that
one rule rejects is not looked at by later ones. The order changes the cost only, never which
texts are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import encoded, map_batches, per_text, struct_array

SAMPLE_DOCS = 400  # documents on which costs and rejections are measured
WINDOW = 8
SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = CAPITALS.lower()
LATER_BYTES = bytes(range(0x80, 0xC0))  # of a UTF-8 character, all but the first
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def count(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def repeated_words(words: Sequence[bytes], window: int = WINDOW) -> int:
    """Words in windows of `window` words that are found twice or more, first ones included.

    Windows are compared by a rolling hash; those with an equal are then compared in full.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    rolled = np.zeros(n, np.uint64)
    for i in range(window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    order = np.argsort(rolled, kind="stable")
    equal = rolled[order[1:]] == rolled[order[:-1]]
    if not equal.any():
        return 0
    alike = np.zeros(n, bool)
    alike[1:] = equal
    alike[:-1] |= equal
    seen: dict[tuple, int] = {}
    starts = []
    for at in order[alike].tolist():
        first = seen.setdefault(tuple(words[at : at + window]), at)
        if first != at:
            starts += [first, at]
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.unique(np.array(starts, np.int64))
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


class Text:
    """A text's UTF-8, and measures of it, each made when it is first asked for."""

    def __init__(self, data: bytes):
        self.data = data

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()  # at ASCII white space, as bytes are

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.data) - count(self.data, SPACE + LATER_BYTES)

    @cached_property
    def n_symbols(self) -> int:
        return count(self.data, SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip(SPACE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_capitals(self) -> int:
        return count(self.data, CAPITALS)

    @cached_property
    def n_small(self) -> int:
        return count(self.data, SMALL)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Text], bool]


#: A text with less than 20 words says little; one that repeats itself, less.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeats", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
)
#: Shares far from those of prose, so that prose with a table, code or a heading stays.
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.word_chars),
    Rule("dup_lines", lambda t: 10 * t.n_dup_lines > 3 * max(len(t.lines), 10)),
    Rule("capitals", lambda t: t.n_capitals > t.n_small),
    Rule("bars", lambda t: 100 * t.words.count(b"|") > 15 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
)


def measure(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE_DOCS):
    """Each rule's share of rejected texts and seconds a text, on a sample.

    The sample is the `sample` documents that come first by a hash of their id. Nothing but
    the order of the rules follows from it.
    """
    chosen = docs.select("doc_id", F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample)
    texts = docs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    names = [rule.name for rule in rules]

    def run(batches):
        rejected, seconds, n = np.zeros(len(rules)), np.zeros(len(rules)), 0
        for batch in batches:
            for data in encoded(batch.column(0).cast(pa.large_string()).fill_null("")):
                n += 1
                for i, rule in enumerate(rules):
                    text, start = Text(data), time.perf_counter()
                    rejected[i] += rule.rejects(text)
                    seconds[i] += time.perf_counter() - start
        yield pa.RecordBatch.from_pydict(
            {"rule": names, "n": [n] * len(rules), "rejected": rejected, "seconds": seconds}
        )

    parts = map_batches(texts.select("text"), run, "rule string, n bigint, rejected double, seconds double")
    return parts.groupBy("rule").agg(
        (F.sum("rejected") / F.sum("n")).alias("rejected"),
        (F.sum("seconds") / F.sum("n")).alias("seconds"),
    )


def ordered(docs: DataFrame, rules: Sequence[Rule], sample: int = SAMPLE_DOCS) -> list[Rule]:
    """The rules by rejections per second on a sample, best first; ties by name."""
    found = {row.rule: row for row in measure(docs, rules, sample).collect()}

    def worth(rule: Rule) -> float:
        row = found.get(rule.name)
        return (row.rejected or 0) / max(row.seconds or 0, 1e-9) if row else 0.0

    return sorted(rules, key=lambda rule: (-worth(rule), rule.name))


def verdict(text: Text, cascade: Sequence[Rule]) -> str | None:
    """The first rule that rejects, after which no other is asked."""
    return next((rule.name for rule in cascade if rule.rejects(text)), None)


def rejected_by(text: Column, cascade: Sequence[Rule]) -> Column:
    """The name of the first rule of a cascade that rejects a text; null if it is kept."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([verdict(Text(data), cascade) for data in encoded(texts)], pa.string())

    return per_text(run, "string")(text)


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row per document: doc_id, the five measures, base_failed, kept, rejected_by.

    Needs doc_id and text; other columns are ignored. A null or empty text has no words and
    fails. Rows that repeat are judged alike. The measures are of the whole text and are made
    for every document, as they are asked for; the cascade then stops at the first rule that
    rejects.
    """
    cascade = ordered(docs, rules, sample)

    def run(texts: pa.Array) -> pa.Array:
        rows = [Text(data) for data in encoded(texts)]
        base = [any(rule.rejects(text) for rule in BASE_RULES) for text in rows]
        by = [verdict(text, cascade) for text in rows]
        return struct_array(
            **{m: pa.array([getattr(t, m) for t in rows], pa.int64()) for m in MEASURES},
            base_failed=pa.array(base, pa.bool_()),
            kept=pa.array([not b and r is None for b, r in zip(base, by)], pa.bool_()),
            rejected_by=pa.array(by, pa.string()),
        )

    kind = ", ".join(f"{m}:bigint" for m in MEASURES)
    column = per_text(run, f"struct<{kind}, base_failed:boolean, kept:boolean, rejected_by:string>")
    return docs.select("doc_id", column(F.col("text")).alias("r_")).select("doc_id", "r_.*")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample: int = SAMPLE_DOCS) -> DataFrame:
    """The documents that no rule rejects, with all their columns; no shuffle."""
    return docs.where(rejected_by(F.col("text"), ordered(docs, rules, sample)).isNull())
