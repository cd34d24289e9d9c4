from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulltally.llm import hard_negatives as hard
from pulltally.llm.shipping import ship_package

TABLE = "vec_id long, embedding array<double>, label int, row int, code string, rank string"


def table(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], TABLE)


def expected(rows, every, positives=5, negatives=3):
    known = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(256 * x) for x in v)]
    known = [r for r in known if sum(x * x for x in r[1]) < 2**62]
    out = []
    for i, v, label in known:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in known if j != i and len(v) == len(w))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            window = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            out += [(i, j, rank, k, -p, -n) for rank, (n, k, _) in enumerate(window[:negatives], 1)]
    return sorted(out)


def found(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def near(seed, n, dim, labels=4):
    """Vectors around few centres, so that positives and negatives lie close together."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim))
    x = centres[rng.integers(0, 5, n)] + 0.4 * rng.standard_normal((n, dim))
    return [(int(i), v.tolist(), int(k)) for i, v, k in zip(rng.permutation(n), x, rng.integers(0, labels, n), strict=True)]


@pytest.mark.parametrize("dim", [3, 24, 70])
def test_against_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(hard, "ROWS", 100)
    monkeypatch.setattr(hard, "ANCHORS", 16)
    rows = near(dim, 420, dim)
    assert found(hard.hard_negatives(table(spark, rows), F.col("vec_id") % 9 == 0)) == expected(rows, 9)


def test_ties_and_repeats(spark):
    rng = np.random.default_rng(2)
    rows = [(k // 2, (rng.integers(-2, 3, 4) / 256).tolist(), int(rng.integers(0, 2))) for k in range(300)]
    rows += [(500, [0.5, 0.5], 0)] * 5 + [(k, [0.5, 0.4], 0) for k in range(501, 510)] + [(k, [0.25, 0.25], 1) for k in range(510, 530)]
    assert found(hard.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == expected(rows, 10)


def test_odd_rows(spark):
    big = 2.0**40
    rows = [(0, None, 1), (10, [1.0, None], 1), (20, [float("nan"), 1.0], 1), (30, [float("inf"), 1.0], 1), (40, [1e308, 1e308], 1), (50, [big, big], 1), (None, [1.0, 1.0], 1), (60, [1.0, 1.0], None)]
    rows += [(70, [], 1), (71, [], 1), (72, [], 2), (80, [0.0, 0.0], 1), (81, [0.0, 0.0], 2), (90, [1.0, 1.0], 1), (91, [1.0, 0.9], 1), (92, [1.0, 0.8], 2), (100, [2e6, 2e6], 1), (101, [2e6, 2e6], 1), (102, [1e6, 2e6], 3), (110, [1.0] * 3, 1)]
    assert found(hard.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0)) == expected(rows, 10)
    for none in (table(spark, []), table(spark, rows[:8])):
        assert hard.hard_negatives(none, F.col("vec_id") % 10 == 0).count() == 0


def test_intervals_hold_every_score_and_spare_most():
    rng = np.random.default_rng(4)
    x = np.floor(256 * (rng.standard_normal((6, 64))[rng.integers(0, 6, 3000)] + 0.3 * rng.standard_normal((3000, 64)))).astype(np.int64)
    codes, alignment, rest, norm = hard.encode(x)
    low, high, _ = hard.intervals(hard.rotate(x[:50].astype(float)), codes, alignment, rest, norm)
    score = x[:50] @ x.T
    assert (low <= score).all() and (score <= high).all()
    assert (high >= np.sort(score, axis=1)[:, -6, None]).mean() < 0.3
