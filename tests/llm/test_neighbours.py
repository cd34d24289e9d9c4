from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulltally.llm import neighbours
from pulltally.llm.neighbours import nearest_neighbours
from pulltally.llm.shipping import ship_package

TABLE = "vec_id long, embedding array<float>, id int, query int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], TABLE)


def exact(rows, queries, k=10):
    out = {}
    for q in queries:
        mine = next(v for i, v in rows if i == q)
        near = sorted((float(np.sqrt(((np.array(mine, float) - np.array(v, float)) ** 2).sum())), i) for i, v in rows if i != q)
        out[q] = near[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_on_a_graph(spark, monkeypatch):
    """Cells far smaller than the table, so that descent and search have to find most neighbours."""
    ship_package(spark)
    monkeypatch.setattr(neighbours, "LEAF", 128)
    x = np.random.default_rng(1).standard_normal((3000, 24)).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    result = found(nearest_neighbours(table(spark, rows), F.col("vec_id") % 100 == 0))
    want = exact(rows, range(0, 3000, 100))
    hits = sum(len({i for _, i in result[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    for q, near in result.items():
        assert near == sorted(near) and len(near) == 10
        for d, i in near:
            assert d == pytest.approx(float(np.sqrt(((x[q].astype(float) - x[i]) ** 2).sum())), abs=1e-12)


def test_copies_and_ties(spark):
    ship_package(spark)
    rows = [(k, [1.0, 0.0]) for k in range(40)] + [(100 + k, [0.0, 1.0 + k]) for k in range(5)]
    result = found(nearest_neighbours(table(spark, rows), F.col("vec_id").isin(3, 100)))
    assert result == exact(rows, [3, 100])


def test_left_out_rows(spark):
    ship_package(spark)
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k + 1), 1.0]) for k in range(4)]
    bad = [(10, None), (20, [0.0, 0.0]), (30, [None, 1.0]), (40, [nan, 1.0]), (50, [inf, 1.0]), (60, []), (70, [1.0]), (None, [1.0, 1.0])]
    result = found(nearest_neighbours(table(spark, [*good, good[1], *bad]), F.col("vec_id") % 10 == 0))
    assert result == exact(good, [0])


def test_empty(spark):
    assert nearest_neighbours(table(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(table(spark, [(0, None)]), F.lit(True)).count() == 0
    assert nearest_neighbours(table(spark, [(0, [1.0])]), F.lit(True)).count() == 0
