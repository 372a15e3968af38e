"""Periodic runs of words, found by recursive frequency splitting and a scan of lags.

A run is a stretch of consecutive words with smallest period q, of at least LEAST_WORDS words
and REPEATS periods, that can't be extended. Every word of a run comes at least REPEATS times
in it. So within a segment, a word that comes less often than that is in no run and splits
it. Parts are split again by their own counts until nothing changes. This is done for all
texts of a chunk at once.

What survives is scanned by lags. A stretch of REPEATS periods holds REPEATS multiples of its
period, wherever it lies, so for lag q only every q-th word is compared with the one q further:
n/1 + n/2 + ... comparisons in all. Where REPEATS samples in a row agree, the lag is looked at
word by word. A multiple of a period found before gives the same run and is passed over.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.llm.common import encoded, per_text, struct_array

LEAST_WORDS, REPEATS = 6, 4
SAMPLES = 1 << 22  # comparisons of a scan at a time
FOUND = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"

Run = tuple[int, int, int]  # start, length, period


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and where each text's words begin."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    values = lists.flatten()
    number = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.not_equal(values, "").to_numpy(zero_copy_only=False)  # an empty text has one empty word
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    return number[real], np.concatenate([[0], np.cumsum(real)])[ends]


def segments(number: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches within texts in which no word is too rare for a run."""
    place, part = np.arange(len(number)), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    while len(place):
        _, which, counts = np.unique(
            part * (number.max() + 1) + number, return_inverse=True, return_counts=True
        )
        often = counts[which] >= REPEATS
        place, part, number = place[often], part[often], number[often]
        if not len(place):
            break
        cut = (np.diff(place) != 1) | (np.diff(part) != 0)
        part = np.concatenate([[0], np.cumsum(cut)])
        long = np.bincount(part)[part] >= LEAST_WORDS
        place, part, number = place[long], part[long], number[long]
        if often.all() and long.all():
            break
    first = np.flatnonzero(np.diff(part, prepend=-1))  # of each part
    return place[first], place[np.append(first[1:], len(place))[: len(first)] - 1] + 1


def _hits(word: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags of low to high - 1 and places from which REPEATS samples, a lag apart, agree."""
    lags = np.arange(low, high)
    counts = (len(word) - 1) // lags
    lag = np.repeat(lags, counts)
    place = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * lag
    same = word[place] == word[place + lag]
    more = REPEATS - 2  # comparisons that must follow the first one
    if len(same) <= more:
        return lag[:0], place[:0]
    hit = lag[:-more] == lag[more:]
    for i in range(more + 1):
        hit &= same[i : len(same) - more + i]
    at = np.flatnonzero(hit)
    return lag[at], place[at]


def _passed(lag, place, period: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which hits lie in runs whose period divides their lag; runs of one period, in order."""
    run = np.searchsorted(starts, place, "right") - 1
    return (lag % period == 0) & (run >= 0) & (place + (REPEATS - 1) * lag < ends[run])


def scan(word: np.ndarray) -> list[Run]:
    """All runs of a segment."""
    n, found, known = len(word), [], set()
    low, most = 1, len(word) // REPEATS
    while low <= most:
        high = low + 1
        room = SAMPLES - n // low
        while high <= most and room >= n // high:
            step = min(most + 1 - high, max(1, room // max(n // high, 1)))
            room -= step * (n // high)
            high += step
        lag, place = _hits(word, low, high)
        for old in found:
            left = ~_passed(lag, place, *old)
            lag, place = lag[left], place[left]
        while len(lag):
            period = int(lag[0])
            lag, place = lag[lag > period], place[lag > period]
            same = np.concatenate([[False], word[:-period] == word[period:], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            starts, ends = edges[::2], edges[1::2] + period
            long = ends - starts >= max(LEAST_WORDS, REPEATS * period)
            starts, ends = starts[long], ends[long]
            if len(starts):
                left = ~_passed(lag, place, period, starts, ends)
                lag, place = lag[left], place[left]
                new = [pair not in known for pair in zip(starts.tolist(), ends.tolist())]
                known.update(zip(starts.tolist(), ends.tolist()))
                if any(new):
                    found.append((period, starts[new], ends[new]))
        low = high
    return [
        (s, e - s, period) for period, starts, ends in found
        for s, e in zip(starts.tolist(), ends.tolist())
    ]


def runs_of(texts: pa.Array) -> list[list[Run]]:
    """The runs of each text by start, then period; words are numbered from 0."""
    number, starts = numbered(texts)
    runs: list[list[Run]] = [[] for _ in range(len(texts))]
    for s, e in zip(*segments(number, starts)):
        text = int(np.searchsorted(starts, s, "right")) - 1
        shift = int(s - starts[text])
        runs[text] += [(shift + start, n, period) for start, n, period in scan(number[s:e])]
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in runs]


def collapsed(data: bytes, runs: list[Run]) -> bytes:
    """Words joined by one space, of each run the first period only."""
    words = data.split()  # bytes: ASCII white space only
    if runs:
        change = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
    return b" ".join(words)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, runs, collapsed.

    `runs` holds (start, length, period) of every run, by start, then period, in words
    numbered from 0; `collapsed` the words that stay, joined by one space. Words are parted by
    ASCII white space and compared as they are. A word stays unless a run holds it after that
    run's first period. Needs doc_id and text; other columns are ignored. Null, empty and blank
    texts have no runs and an empty `collapsed`. Rows that repeat are rows of the result; no
    documents give no rows. Texts are taken whole, one at a time within a task, without a shuffle.
    """

    def run(texts: pa.Array) -> pa.Array:
        runs = runs_of(texts)
        flat = np.array([r for text in runs for r in text], np.int64).reshape(-1, 3)
        ends = np.cumsum([0, *map(len, runs)], dtype=np.int32)
        kept = pa.array(list(map(collapsed, encoded(texts), runs)), pa.binary()).cast(pa.string())
        columns = struct_array(start=flat[:, 0], length=flat[:, 1], period=flat[:, 2])
        return struct_array(runs=pa.ListArray.from_arrays(pa.array(ends), columns), collapsed=kept)

    found = docs.select("doc_id", per_text(run, FOUND)(F.col("text")).alias("found"))
    return found.select("doc_id", "found.runs", "found.collapsed")


def digests(runs: DataFrame) -> DataFrame:
    """Of `periodic_runs`: the number of runs, the longest (then first, then of smallest period),
    and digests. Without runs the longest run's columns are null."""
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period")
    )))
    return runs.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("l"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", (-F.col("l.start")).alias("start"), "l.length",
        (-F.col("l.period")).alias("period"),
        F.expr("1000 * l.length div -l.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def with_repeated_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the texts, by the checksum of doc_id, end in repeats.

    With h = crc32(doc_id), g = h / 10 and n words, where h % 10 = 0 and n > 0: from word
    a = g % n on, the first p = 1 + (n - a) / (3 + g % 8) words are repeated, up to n words.
    A null doc_id changes nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return (
        docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.expr(
            "crc32(cast(doc_id as string)) div 10"
        ).alias("g"))
        .withColumn("n", F.size("w"))
        .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
        .withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
        .withColumn("tail", F.expr("flatten(array_repeat(slice(w, a + 1, p), int((n - a) div p + 1)))"))
        .select("doc_id", F.coalesce(
            F.expr("array_join(concat(slice(w, 1, a), slice(tail, 1, n - a)), ' ')"), "text"
        ).alias("text"))
    )
