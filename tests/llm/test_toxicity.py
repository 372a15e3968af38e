"""Toxicity by compression: recomputed window by window, and what each dictionary adds."""

import math
import zlib
from dataclasses import replace

import numpy as np
import pytest
import zstandard

from tierscope.llm import toxicity
from tests.llm.conftest import ODD


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (
        spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")
    )
    return docs, labels, toxicity.trained(docs, labels)


def brute_score(model, text):
    """The score from the definition: cut, compress, subtract, weigh."""
    words = (text or "").lower().encode().split()
    x = []
    for a, b in ((model.ordinary, model.toxic), (model.filled, model.telling)):
        less = []
        for start in range(0, len(words), 20):
            window = b" " + b" ".join(words[start : start + 20]) + b" "
            size = []
            for dictionary in (a, b):
                parameters = zstandard.ZstdCompressionParameters.from_level(
                    3, source_size=128, dict_size=len(dictionary), min_match=3,
                    strategy=zstandard.STRATEGY_BTOPT, write_content_size=0, write_checksum=0,
                    write_dict_id=0,
                )
                size.append(len(zstandard.ZstdCompressor(
                    compression_params=parameters, dict_data=zstandard.ZstdCompressionDict(
                        dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                ).compress(window)))
            less.append(size[0] - size[1])
        less = less or [0]
        x += [max(less), sum(less) / len(less), sum(v >= 2 for v in less) / len(less),
              sum(v >= 4 for v in less) / len(less)]
    z = model.bias + sum(
        w * (v - m) / s for v, m, s, w in zip(x, model.mean, model.scale, model.weights)
    )
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def test_scores_equal_brute_force(spark, learned):
    docs, labels, model = learned
    some = docs.where("doc_id % 40 = 0")
    got = {r.doc_id: r for r in toxicity.classified(some, labels, model).collect()}
    rows = some.select("doc_id", "text").collect()
    assert len(rows) == len(got) > 100
    for row in rows:
        found = got[row.doc_id]
        assert found.score == pytest.approx(brute_score(model, row.text))
        assert found.predicted == int(found.score >= 0.5)
        assert found.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_both_dictionaries_are_trained_and_differ(learned):
    _, _, model = learned
    assert len(model.toxic) == len(model.ordinary) == toxicity.TRAINED_BYTES
    magic = b"\x37\xa4\x30\xec"  # of a dictionary that zstandard has trained
    assert model.toxic[:4] == model.ordinary[:4] == magic
    assert model.toxic != model.ordinary and any(model.weights[:4])


def test_the_score_moves_with_the_toxic_dictionary(learned):
    docs, labels, model = learned
    noise = np.random.default_rng(0).integers(0, 256, len(model.toxic), dtype=np.uint8).tobytes()
    other = replace(model, toxic=noise)
    texts = [r.text for r in docs.join(labels.where("toxic = 1"), "doc_id").select("text").limit(60).collect()]
    moved = [abs(model.score(t or "") - other.score(t or "")) for t in texts]
    assert max(moved) > 0.05 and sum(m > 1e-6 for m in moved) > len(moved) / 2


def test_labels_of_held_out_documents_are_not_learned(spark, docs):
    """Labels of held-out documents may say anything."""
    ids = range(400)
    texts = [f"vile nasty words {i}" if i % 2 else f"kind mild phrases {i}" for i in ids]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 5 == 0}
    rows = docs(texts)
    models = [
        toxicity.trained(rows, spark.createDataFrame(
            [(i, 1 - i % 2 if i in held and wrong else i % 2) for i in ids], "doc_id bigint, toxic int"
        )) for wrong in (False, True)
    ]
    assert models[0] == models[1]
    assert all((models[0].score(t) >= 0.5) == bool(i % 2) for i, t in enumerate(texts))


def test_odd_texts_equal_brute_force(learned):
    _, _, model = learned
    for text in ODD:
        if text is None or len(text) < 1000:
            assert model.score(text or "") == pytest.approx(brute_score(model, text))
