import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tierscope.llm import exact, idfiles, packing
from tierscope.llm.queries import WORD_BPE
from tierscope.llm.words import WordEncoder
from tests.llm.conftest import ODD, SF_DIR


def ids_of(text):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    return tokenizer.encode(text or "", add_special_tokens=False).ids


# ---------------------------------------------------------------- word encoder

@pytest.mark.parametrize("text", [t for t in ODD if t is not None and len(t) < 1000] + [
    "İstanbul ΣΑΣ. don't I'LL x's'", "!!!<|endoftext|>!!! <|ENDOFTEXT|>", "12ab3.4 ²½ ªº ǅ ﬁ",
    "á ́b thė. e'́", "Ａ　Ｂ",
])
def test_words_are_encoded_as_texts_are(text):
    _, ids = WordEncoder(WORD_BPE).encode(pa.array([text], pa.large_string()))
    assert ids.tolist() == ids_of(text)


def test_marks_at_word_ends_are_encoded_as_the_library_does():
    ascii_marks = [c for c in map(chr, range(33, 127)) if not c.isalnum()]
    marks = [*ascii_marks, *"\u201c\u201d\u2018\u2019\u2013\u2014\u2026\u20ac\u00b0\u3002\u0301\u20dd\U0001f600"]
    texts = [f"{core}{a}{b}" for core in ("foo", "\u00e9", "7", "") for a in marks for b in marks]
    texts += [f"x{a}.{b}y{a}," for a in marks for b in marks]
    texts += ["foo().", "[1].", "foo-.", "end],", "};", "a/b/.", "<b>,", "`x`,", "_x_.", "don't'.", "\u00bd.", "\u65e5\u672c)."]
    encoder = WordEncoder(WORD_BPE)
    ends, ids = encoder.encode(pa.array(texts, pa.large_string()))
    want = Tokenizer.from_file(WORD_BPE).encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, s, e, w in zip(texts, ends, ends[1:], want) if ids[s:e].tolist() != w.ids]
    assert not wrong


def test_a_full_memory_changes_nothing(monkeypatch):
    from tierscope.llm import words

    monkeypatch.setattr(words, "MEMORY_WORDS", 3)
    encoder = WordEncoder(WORD_BPE)
    for text in ("one two three four", "five six. Seven one", "x" * 60 + " one"):
        ends, ids = encoder.encode(pa.array([text, "", text], pa.large_string()))
        assert ids.tolist() == ids_of(text) * 2
        assert ends.tolist() == [0, len(ids_of(text)), len(ids_of(text)), 2 * len(ids_of(text))]
    assert len(encoder.words) <= 3


# ---------------------------------------------------------------- packing

@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 8))
@settings(max_examples=60, deadline=None)
def test_bins_hold_what_fits_without_gaps(lengths, open_bins):
    bins, ends = packing.Bins(50, open_bins), {}
    for n in lengths:
        number, offset = bins.place(n)
        assert offset == ends.get(number, 0)
        ends[number] = offset + n
        assert ends[number] <= 50 and bins.open <= open_bins


def test_best_fit_takes_the_fullest_bin_that_fits():
    bins = packing.Bins(10, 4)
    places = [bins.place(n) for n in (6, 7, 3, 4, 9, 1)]
    assert places == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (2, 9)]


def test_the_fullest_closes_first():
    bins = packing.Bins(10, 2)
    assert [bins.place(n)[0] for n in (6, 8, 7, 4, 2)] == [0, 1, 2, 0, 2]


def test_packing_is_tight(spark):
    rng = random.Random(1)
    lengths = [min(4096, int(math.exp(rng.uniform(0, 8.4)))) for _ in range(20_000)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id int, length int")
    got = packing.pack(rows, "length", ["doc_id"]).select("sequence_id").distinct().count()
    assert got <= 1.01 * sum(lengths) / 4096 + 1


def test_packed_pieces(odd):
    rows = packing.pack_documents(odd, WORD_BPE, keep_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.piece), []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
    for i, text in enumerate(ODD):
        pieces = sorted((r for (d, _), found in by_doc.items() if d == i for r in found[:1]),
                        key=lambda r: r.piece)
        want = [*ids_of(text), 1]
        assert [x for r in pieces for x in r.ids] == want
        assert [r.start for r in pieces] == list(range(0, len(want), 4096))
    assert len(by_doc[4, 0]) == 2 and len(by_doc[None, 0]) == 1
    bins = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 4096


def test_packing_of_nothing(empty):
    assert packing.pack_documents(empty, WORD_BPE).count() == 0


def test_impossible_lengths_raise(spark):
    rows = spark.createDataFrame([(1, 5000)], "doc_id int, length int")
    with pytest.raises(Exception, match="from 1 to 4096"):
        packing.pack(rows, "length", ["doc_id"]).collect()


# ---------------------------------------------------------------- exact duplicates

@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=200))
@settings(max_examples=80, deadline=None)
def test_golomb_round_trip(values):
    values = np.sort(np.array(values, np.uint64))
    coded = exact.golomb_encode(values)
    assert (exact.golomb_decode(len(values), *coded) == values).all()


def test_golomb_is_smaller_than_plain():
    values = np.sort(np.random.default_rng(1).integers(0, 2**64, 100_000, dtype=np.uint64))
    _, first, high, low = exact.golomb_encode(values)
    assert len(first + high + low) < 0.85 * values.nbytes


@pytest.mark.parametrize("fingerprint", [None, "length", "constant"])
def test_exact_groups(odd, fingerprint):
    prints = {
        None: None, "constant": F.lit(-1).cast("bigint"),
        "length": F.coalesce(F.length("text"), F.lit(0)).cast("bigint"),
    }
    got = exact.exact_groups(odd, prints[fingerprint]).collect()
    texts = [(i, t or "") for i, t in enumerate(ODD)] + [(4, ODD[4]), (None, "no id")]
    assert len(got) == len(texts)
    for r in got:
        text = dict(texts)[r.doc_id]
        same = [i for i, t in texts if t == text]
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.group_size == len(same)
        assert r.keep_id == max((i for i in same if i is not None), default=None)
    assert sum(r.kept for r in got) == len({t for _, t in texts})


def test_drop_exact_keeps_rows_whole(odd):
    got = exact.drop_exact(odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert len(rows) == len({t or "" for t in ODD} | {"no id"})
    assert {(r.doc_id, r.text) for r in rows} >= {(2, ODD[2]), (5, ODD[5]), (None, "no id")}
    assert all(r.word == "word" and r.suspect_ == "suspect_" for r in rows)


def test_exact_groups_of_nothing(empty):
    assert exact.exact_groups(empty).count() == 0 and exact.drop_exact(empty).count() == 0


def test_texts_of_singles_are_not_shuffled(docs, spark):
    """Suspects are few where texts differ."""
    rows = docs([f"text {i}" for i in range(2000)] + ["twice", "twice"])
    small, _, marked = exact._groups(rows, F.xxhash64("text"), exact.SLOT_BITS)
    assert 2 <= marked(small).where("suspect_").count() < 40


# ---------------------------------------------------------------- ORC files

def test_ids_in_files(spark, odd, tmp_path):
    idfiles.write_ids(odd, str(tmp_path / "ids"), WORD_BPE)
    rows = idfiles.read_ids(spark, str(tmp_path / "ids")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([None, *range(len(ODD)), 4], key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        text = "no id" if r.doc_id is None else ODD[r.doc_id]
        assert r.ids == [*ids_of(text), 2] and (r.start, r.n_tokens) == (at, len(r.ids))
        at += len(r.ids)
    crc = {r.doc_id: r.ids_crc32 for r in idfiles.digests(idfiles.read_ids(spark, str(tmp_path / "ids"))).collect()}
    assert crc[3] == zlib.crc32(np.array([*ids_of("word"), 2], "<u4").tobytes())


def test_asking_for_documents_prunes(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    idfiles.write_ids(docs, str(tmp_path / "ids"), WORD_BPE)
    everything = {r.doc_id: r for r in idfiles.read_ids(spark, str(tmp_path / "ids")).collect()}
    some = idfiles.read_ids(spark, str(tmp_path / "ids"), [3, 150, 10**9])
    assert [tuple(r) for r in some.orderBy("doc_id").collect()] == [tuple(everything[i]) for i in (3, 150)]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString().replace("`", "") or (
        "In(doc_id" in some._jdf.queryExecution().toString())


def test_files_of_nothing(spark, empty, tmp_path):
    idfiles.write_ids(empty, str(tmp_path / "ids"), WORD_BPE)
    assert idfiles.read_ids(spark, str(tmp_path / "ids")).count() == 0
