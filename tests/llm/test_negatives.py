"""Hard negatives against all pairs scored."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from tests.llm.conftest import SF_DIR
from tierscope.llm import negatives

SCHEMA = "vec_id bigint, label int, embedding array<float>, row_ string, score string, tile string"


def brute(rows, positives=5, most=10, low=30, high=90, each=100):
    """Rows (vec_id, label, vector) as asked for, without codes or tiles."""
    whole = [
        (n, v, label, [math.floor(256 * float(np.float32(x))) for x in vector])
        for n, (v, label, vector) in enumerate(rows)
        if v is not None and label is not None and vector is not None
        and all(x is not None and math.isfinite(np.float32(x)) for x in vector)
    ]
    out = []
    for n, v, label, vector in whole:
        if v % each:
            continue
        scored = [
            (min(2**63 - 1, sum(a * b for a, b in zip(vector, other))), w, other_label)
            for m, w, other_label, other in whole if m != n
        ]
        scored.sort(key=lambda r: (-r[0], r[1]))
        for ps, pv, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * ps <= 100 * r[0] <= high * ps][:most]
            out += [(v, pv, i, w, ps, ns) for i, (ns, w, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **options)
    return sorted(map(tuple, got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ).collect()))


def drawn(seed, n, width=9, labels=3, spread=0.3):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((labels + 2, width))
    return [
        (int(i), int(rng.integers(labels)), [float(np.float32(x)) for x in (
            middle[i % (labels + 2)] + spread * rng.standard_normal(width)
        )]) for i in range(n)
    ]


@pytest.mark.parametrize("seed, width", [(1, 9), (2, 64), (3, 130)])
def test_equals_brute_force_over_several_tiles(spark, monkeypatch, seed, width):
    monkeypatch.setattr(negatives, "LEAST_ROWS", 50)
    monkeypatch.setattr(negatives, "MOST_ROWS", 100)
    monkeypatch.setattr(negatives, "ANCHOR_ROWS", 3)
    rows = drawn(seed, 700, width)
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 20


def test_odd_rows(spark):
    same = [0.5, -0.25, 1.0]
    rows = drawn(4, 300, 3) + [
        (400, 1, None), (500, None, same), (None, 1, same), (600, 1, [1.0, None, 2.0]),
        (700, 1, [1.0, math.nan, 2.0]), (701, 2, [math.inf, 0.0, 0.0]), (800, 1, []),
        (900, 1, [0.75]), (1000, 2, [1.0, 1.0, 1.0, 1.0]),
        (100, 1, same), (100, 1, same),  # repeats
        *[(2000 + i, i % 2, same) for i in range(60)],  # ties
    ]
    random.Random(5).shuffle(rows)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=120) == brute(
        rows, 2, 3, -50, 120
    )


def test_large_components_stay_exact(spark):
    rows = [(i, i % 3, [x * 2.0 ** (i % 40) for x in v]) for i, _, v in drawn(6, 240, 4)]
    assert mined(spark, rows) == brute(rows)
    huge = [(0, 0, [3e38, 1.0]), (1, 0, [3e38, 2.0]), (2, 1, [1.0, 1.0]), (3, 1, [-3e38, 0.0])]
    assert mined(spark, huge) == brute(huge)


def test_empty_tables_and_no_anchor(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, None)]) == []


def test_intervals_hold_every_score():
    for seed, width in ((1, 3), (2, 64), (3, 200)):
        v = np.array([r[2] for r in drawn(seed, 400, width)])
        v = np.floor(256 * v)
        coder = negatives.Coder(v.mean(0), 256.0)
        exact, widths = v[:50] @ v.T, []
        for low, high in coder.intervals(coder.anchors(v[:50]), slice(None), *coder.code(v)):
            assert (low <= exact).all() and (exact <= high).all()
            widths.append((high - low).mean())
        assert len(widths) == negatives.LEVELS
        assert widths == sorted(widths, reverse=True) and widths[-1] < widths[0] / 4


def test_intervals_leave_out_most_pairs():
    """On the test table, whose vectors lie almost at right angles to one another."""
    rows = duckdb.sql(f"SELECT label, embedding FROM '{SF_DIR}/embeddings.parquet'").fetchall()
    v = np.floor(256 * np.array([r[1] for r in rows]))
    coder = negatives.Coder(v.mean(0), 256.0)
    *_, (low, high) = coder.intervals(coder.anchors(v[:100]), slice(None), *coder.code(v))
    assert (high >= negatives.kth(low, 6)[:, None]).mean() < 0.4  # measured: 0.33


def test_query_equals_sql(spark):
    outcome, n = compare(spark, connect(SF_DIR), SF_DIR, "op11_hard_negatives")
    assert outcome == "ok" and n > 0
