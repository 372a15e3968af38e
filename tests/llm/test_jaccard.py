"""The n-gram Jaccard join against all pairs of sets."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import ODD, SF_DIR
from tierscope.llm import jaccard, queries


def set_of(text, words=5):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not found:
        return frozenset()
    return frozenset(
        tuple(found[i : i + words]) for i in range(max(len(found) - words + 1, 1))
    )


def brute(rows, percent=80):
    """Rows (doc_id, n_shingles, component_id, n_links) by all pairs."""
    sets = [set_of(text) for _, text in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b, common = sets[j], 0
            if a and b and percent * max(len(a), len(b)) <= 100 * min(len(a), len(b)):
                common = len(a & b)
            if common and 100 * common >= percent * (len(a) + len(b) - common):
                links[i] += 1
                links[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return sorted(
        ((d, len(s), least.get(top(i)) if s else d, links[i])
         for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr,
    )


def got(df, **options):
    return sorted((tuple(r) for r in jaccard.joined(df, **options).collect()), key=repr)


def near_copies(seed, groups, copies, most_edits=12, vocabulary=400):
    """Texts with near copies about the limit, some with a passage that many share."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.choice([3, 5, 8, 30, 90, 200]))
        if rng.random() < 0.5:
            at = rng.randrange(len(base))
            base[at:at] = passage
        for _ in range(rng.randint(1, copies)):
            text = list(base)
            for _ in range(rng.randint(0, most_edits)):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
    return texts


def test_equals_brute_force(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_ROWS", 16)
    monkeypatch.setattr(jaccard, "SENT_AT_ONCE", 5000)
    monkeypatch.setattr(jaccard, "OWNED", 4000)
    monkeypatch.setattr(jaccard, "OFTEN", (2, 4, 16))
    texts = near_copies(1, 60, 9) + near_copies(2, 2, 70, 6)
    want = brute(list(enumerate(texts)))
    assert got(docs(texts)) == want
    assert len({c for _, _, c, _ in want}) < len(want) - 50
    assert any(c != d and n < 20 for d, _, c, n in want)
    # a bitmap that is full changes nothing
    monkeypatch.setattr(jaccard, "SLOT_BITS", 12)
    assert got(docs(texts)) == want


@pytest.mark.parametrize("percent", [50, 95])
def test_other_limits(docs, percent):
    texts = near_copies(3, 30, 6)
    assert got(docs(texts), percent=percent) == brute(list(enumerate(texts)), percent)


def test_just_at_the_limit(docs):
    """36 of 45 shingles is 0.8 exactly; 35 of 46 is less."""
    base = [f"a{i}" for i in range(44)]  # 40 shingles
    texts = [" ".join(base), " ".join([*base[:40], "x", "y", "z", "u", "v"]),
             " ".join([*base[:39], "x", "y", "z", "u", "v", "w"])]
    sets = list(map(set_of, texts))
    assert (len(sets[0] & sets[1]), len(sets[0] | sets[1])) == (36, 45)
    assert got(docs(texts)) == brute(list(enumerate(texts)))
    assert jaccard.joined(docs(texts[:2])).where("n_links = 1").count() == 2


def test_odd_texts(odd, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(odd) == brute(rows)
    same = docs(["", None, " ", *["one two"] * 5, *["One TWO"] * 3], [1, 1, 2, *[3] * 5, None, 4, 0])
    rows = [(r["doc_id"], r["text"]) for r in same.select("doc_id", "text").collect()]
    assert got(same) == brute(rows)
    assert got(empty) == []
    assert jaccard.joined(empty).columns == ["doc_id", "n_shingles", "component_id", "n_links"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40)), min_size=1, max_size=12))
def test_overlaps_equal_intersections(sets):
    held = [np.array(sorted(s), np.uint64) for s in sets]
    assert jaccard.overlaps(held).tolist() == [[len(a & b) for b in sets] for a in sets]


def test_overlaps_are_derived_from_a_similar_set(monkeypatch):
    base = np.arange(1000, dtype=np.uint64)
    sets = [np.append(base[i:], np.uint64(5000 + i)) for i in range(40)]
    looked = []
    bincount = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: looked.append(len(x)) or bincount(x, *a, **k))
    got = jaccard.overlaps(sets)
    assert got[0, 39] == 961 and got[5, 5] == 996
    assert sum(looked[1:]) < 40 * 1000 * 5  # all lists would be 40 times 1000 times 40


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.tuples(st.integers(0, 2), st.integers(4, 24), st.integers(0, 5)), min_size=1, max_size=40),
    st.sampled_from([60, 80, 90]),
)
def test_blocks_link_what_pairs_link(entries, percent):
    entries = sorted(set(entries))
    token, n, place = np.array(entries, np.int64).reshape(-1, 3).T
    a, b = jaccard.linked_blocks(token, n, place, percent)

    def parts(pairs):
        i, j = np.array(list(pairs), np.int64).reshape(-1, 2).T
        return jaccard.forest(len(entries), i, j).tolist()

    pairs = [
        (i, j) for i, (t, x, p) in enumerate(entries) for j, (u, y, q) in enumerate(entries[:i])
        if t == u and percent * max(x, y) <= 100 * min(x, y)
        and min(x - p, y - q) >= jaccard.least_common(x, y, percent)
    ]
    assert parts(zip(a, b)) == parts(pairs)


def test_shingles_of_texts_side_by_side_stay_apart():
    texts = ["a b c d e f", "", "a b", " A  b\tc d e f ", "f a b c d"]
    sets = jaccard.shingle_sets(pa.array([*texts, *ODD[6:8]], pa.large_string()), 5)
    assert list(map(len, sets[:5])) == [2, 0, 1, 2, 1]
    assert sets[0].tolist() == sets[3].tolist()
    assert [len(set_of(t)) for t in ODD[6:8]] == list(map(len, sets[5:]))


def test_query_equals_brute_force(spark, table):
    rows = [(r[0], r[1]) for r in table("documents")]
    rows_got = queries.op13_ngram_jaccard_join(spark, SF_DIR).collect()
    assert sorted(map(tuple, rows_got), key=repr) == brute(rows)
