"""Periodic runs against a plain search of every lag."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SF_DIR
from tierscope.llm import periodic, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


pieces = st.lists(
    st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 8)),
    max_size=6,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, max_size=4))
def test_runs_equal_brute_force(texts):
    texts = [" ".join(w for part, times in text for w in part * times) for text in texts]
    got = periodic.runs_of(pa.array(texts, pa.large_string()))
    assert got == [brute(words_of(text)) for text in texts]


@pytest.mark.parametrize("samples", [1, 50, 1000])
def test_scan_in_parts_gives_the_same(monkeypatch, samples):
    monkeypatch.setattr(periodic, "SAMPLES", samples)
    random.seed(samples)
    base = [str(random.randint(0, 9)) for _ in range(40)]
    text = " ".join(base * 6 + ["x"] * 30 + base[:7] * 9 + ["y", "z"] * 20)
    [got] = periodic.runs_of(pa.array([text], pa.large_string()))
    assert got == brute(text.split()) and len(got) == 4


def test_rare_words_split_until_stable():
    # b is rare once x and y have parted the text
    number = [0, 0, 0, 0, 0, 0, 9, 1, 0, 1, 0, 1, 0, 8, 1, 2, 2, 2, 2, 2, 2]
    text = " ".join(map(str, number))
    ids, starts = periodic.numbered(pa.array([text], pa.large_string()))
    found = list(zip(*map(list, periodic.segments(ids, starts))))
    assert found == [(0, 6), (15, 21)]


def test_odd_texts(odd, empty):
    rows = {r["doc_id"]: r for r in periodic.periodic_runs(odd).collect()}
    assert periodic.periodic_runs(odd).count() == odd.count()
    assert [tuple(r) for r in rows[9]["runs"]] == [(0, 90_000, 1)]
    assert rows[9]["collapsed"] == "la" and rows[0]["runs"] == [] and rows[0]["collapsed"] == ""
    assert rows[None]["collapsed"] == "no id" and rows[2]["collapsed"] == ""
    assert periodic.periodic_runs(empty).columns == ["doc_id", "runs", "collapsed"]
    assert periodic.digests(periodic.periodic_runs(empty)).count() == 0
    assert periodic.with_repeated_tails(odd).count() == odd.count()


def test_query_equals_brute_force(spark, table):
    got = {r["doc_id"]: r for r in queries.op12_periodic_runs(spark, SF_DIR).collect()}
    rows, some = table("documents"), 0
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        words = words_of(text)
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        row, some = got[doc_id], some + bool(runs)
        assert row["n_runs"] == len(runs)
        assert row["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        kept = brute_collapsed(words, runs)
        assert row["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        longest = (row["start"], row["length"], row["period"], row["exponent_milli"])
        assert longest == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert some > 10
