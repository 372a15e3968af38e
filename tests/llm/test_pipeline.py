"""Queries and pipeline on the test tables, against brute force."""

import re

import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from compare import compare, connect
from tierscope.llm import near, queries as own
from tests.llm.conftest import SF_DIR
from tests.llm.test_text_operators import WORD, brute_base, brute_quality


@pytest.mark.parametrize("name", sorted(own.oracle_sql()))
def test_matches_sql(spark, name):
    assert compare(spark, connect(SF_DIR), SF_DIR, name)[0] == "ok"


def test_all_are_registered():
    names = queries().keys()
    assert "pipeline" in names and own.oracle_sql().keys() <= oracle_sql().keys()
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in names if n.startswith("op")} == set(range(1, 11))


def shingles(text, k=5):
    words = WORD.findall(text.lower())
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, left = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == columns
        before, left = left, {r.doc_id: r for r in docs.collect()}
        if name == "quality_rules":
            assert not any(brute_quality(r.text)[-1] for r in left.values())
            assert len(left) > 0.75 * len(before)
        if name == "exact_dedup":
            last = {r.text: r.doc_id for r in sorted(before.values(), key=lambda r: r.doc_id)}
            assert set(left) == set(last.values())
        if name == "simhash_near_dedup":
            sets = {i: shingles(r.text) for i, r in before.items()}

            def alike(i, j):
                return len(sets[i] & sets[j]) / len(sets[i] | sets[j])

            for i in before.keys() - left.keys():
                assert max(alike(i, j) for j in before if j != i) > 0.65
            ids = sorted(left)
            assert not any(alike(i, j) >= 0.9 for i in ids for j in ids if i < j)
        if name == "secret_scans":
            assert left.keys() == before.keys()
            assert not any(brute_base(r.text) for r in left.values())
            assert all(r.n_chars == len(r.text) for r in left.values())
    packed = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in packed} == left.keys()


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_default_is_jaccard():
    shape = near.Near.jaccard()
    assert shape.words == 5 and shape.width * 64 == 512 and 70 < shape.radius < 90
