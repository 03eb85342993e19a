"""Hard negatives against a restatement that looks at all pairs."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerwatch.llm import hard_negatives as module
from ledgerwatch.llm.hard_negatives import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
NAMES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def restated(rows, is_anchor, positives=5, negatives=5, lower=80):
    fit = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [max(-(1 << 63), min((1 << 63) - 1, math.floor(256 * x))) for x in v]
        fit[i] = min(fit.get(i, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in fit.items():
        if not is_anchor(a):
            continue
        score = {}
        for i, (_, w) in fit.items():
            s = sum(x * y for x, y in zip(v, w))
            score[i] = max(-(1 << 56), min(1 << 56, s))
        ranked = sorted((i for i in fit if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if fit[i][0] == label][:positives]:
            inside = [i for i in ranked if fit[i][0] != label and lower * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k, i, score[p], score[i]) for k, i in enumerate(inside[:negatives], 1)]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r[n] for n in NAMES) for r in hard_negatives(df, F.col("vec_id") % 10 == 0, **options).collect())


def random_rows(n, seed, spread=1.0, dims=6, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.3, spread) for _ in range(dims)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_vectors(spark, seed):
    rows = random_rows(400, seed)
    expected = restated(rows, lambda i: i % 10 == 0)
    assert expected and found(spark.createDataFrame(rows, SCHEMA)) == expected


def test_ties_in_many_blocks(spark, monkeypatch):
    """Few different vectors, so that slots, ranks and windows are full of ties, over many blocks of both sides."""
    monkeypatch.setattr(module, "ROWS", 50)
    monkeypatch.setattr(module, "ANCHORS", 7)
    monkeypatch.setattr(module, "_SCORES_AT_ONCE", 64)
    rng = random.Random(5)
    rows = [(i, [rng.randrange(3) / 2, rng.randrange(3) / 2, 1.0], int(i % 3 == 0) + int(i % 50 == 0)) for i in range(600)]
    expected = restated(rows, lambda i: i % 10 == 0)
    assert len(expected) > 500 and found(spark.createDataFrame(rows, SCHEMA)) == expected


def test_odd_rows(spark):
    rows = random_rows(60, 9, dims=3) + [
        (None, [1.0, 1.0, 1.0], 1),
        (100, None, 1),
        (110, [1.0, None, 1.0], 1),
        (120, [1.0, float("nan"), 1.0], 1),
        (130, [float("inf"), 1.0, 1.0], 1),
        (140, [1.0, 1.0, 1.0], None),
        (150, [], 1),
        (160, [1.0], 2),
        (170, [1.0, 1.0, 1.0, 1.0], 2),
        (180, [-1.0, -1.0, -1.0], 1),
        (190, [1e30, -1e30, 3e200], 1),
        (191, [1e30, 1e30, 1.0], 0),
        (200, [2e6, 2e6, 2e6], 1),
        (201, [2e6, 1.8e6, 2e6], 0),
        (202, [2e6, 2e6, 1.9e6], 1),
        (20, [1.0, 1.0, 1.0], 9),
        (20, [1.0, 1.0, 1.0], 9),
        (20, [0.5, 1.0, 1.0], 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "slot", "limits", "anchor_id", "down", "row_block", "vector", "parts"):
        df = df.withColumn(name, F.lit("x"))
    assert found(df) == restated(rows, lambda i: i % 10 == 0)


def test_other_numbers_and_empty(spark):
    rows = random_rows(150, 4, labels=2)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = restated(rows, lambda i: i % 10 == 0, positives=3, negatives=8, lower=50)
    assert expected and found(df, positives=3, negatives=8, lower=50) == expected
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id % 10 <> 0")) == []


def test_slots_are_disjoint_and_bounded(spark, monkeypatch):
    """What leaves a group is at most k rows per anchor and slot."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vectors = rng.integers(0, 200, (500, 4))
    rows = pa.table({"vec_id": np.arange(500), "label": np.ones(500, dtype=np.int64), "vector": pa.array(vectors.tolist(), pa.list_(pa.int64()))})
    anchors = pa.table({
        "vec_id": np.arange(3) + 1000, "label": np.zeros(3, dtype=np.int64),
        "vector": pa.array(vectors[:3].tolist(), pa.list_(pa.int64())), "limits": [[60_000, 40_000, 20_000]] * 3,
    })
    out = module._other_label(4, 80)(None, rows, anchors).to_pylist()
    held = defaultdict(list)
    for r in out:
        held[r["anchor_id"], r["slot"]].append(-r["down"])
    limits = [60_000, 40_000, 20_000, -(1 << 60)]
    for (_, slot), scores in held.items():
        assert len(scores) <= 4
        assert all(limits[slot + 1] < s <= limits[slot] for s in scores)
