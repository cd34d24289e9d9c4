from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from pulltally.llm.toxicity import OTHER, fit, segments, toxic_scores
from tests.llm.cases import documents, odd_texts, prose


def best_segments(scores):
    """By definition: take the best span of the sequence, then of what lies on either side."""
    def split(a, b):
        spans = [(sum(scores[i:j]), -i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
        top = max(spans, default=(0, 0, 0))
        if top[0] <= 0:
            return []
        # Of equal sums, the shortest is maximal in their sense.
        i, j = min(((-s[1], s[2]) for s in spans if abs(s[0] - top[0]) < 1e-12), key=lambda s: s[1] - s[0])
        return [*split(a, i), (i, j), *split(j, b)]

    return split(0, len(scores))


def test_segments():
    rng = random.Random(5)
    for _ in range(300):
        scores = [rng.choice([OTHER, OTHER, OTHER, 0.7, 1.9, 2.3]) for _ in range(rng.randrange(18))]
        found = segments(np.array(scores, float))
        assert [(a, b) for a, b, _ in found] == best_segments(scores)
        assert all(s == pytest.approx(sum(scores[a:b])) for a, b, s in found)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(900):
        words, toxic = prose(k, 60, 800), k % 6 == 0
        if toxic:
            words[20:20] = rng.sample(["vile", "scum", "fool", "trash"], 2) + ["grimword" + rng.choice("abcdefgh") * 3]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic), "x"))
    table = spark.createDataFrame([*labels, (None, 1, "x"), (5, None, "x"), (5000, 1, "x")], "doc_id long, toxic int, text string")
    return documents(spark, rows), table, {k: t for k, t, _ in labels}


def test_held_out_documents(spark, corpus):
    docs, labels, toxic = corpus
    rows = toxic_scores(docs, fit(docs, labels)).select("kept.doc_id", "kept.text_key", "score", "passages").collect()
    apart = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(rows) == 900 and all(r["text_key"] == 2 for r in rows)
    assert np.mean([(r["score"] >= 0.5) == bool(toxic[r["doc_id"]]) for r in apart]) > 0.97
    for r in rows:
        if toxic[r["doc_id"]]:
            assert any(p["first_word"] <= 21 < p["after_word"] for p in r["passages"])


def test_unseen_form_of_a_seen_beginning(spark, corpus):
    docs, labels, _ = corpus
    model = fit(docs, labels)
    rows = toxic_scores(documents(spark, [(1, "w1 w2 grimwordzzz w3"), (2, "w1 w2 w3 w4")]), model).collect()
    by_id = {r["kept"]["doc_id"]: r["score"] for r in rows}
    assert by_id[1] > by_id[2]


def test_odd_rows(spark, corpus):
    docs, labels, _ = corpus
    rows = toxic_scores(documents(spark, odd_texts()), fit(docs, labels)).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if not (r["kept"]["text"] or "").strip()}) == 1


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = documents(spark, [(1, "a b"), (2, None)])
    assert all(r["score"] < 0.5 for r in toxic_scores(some, fit(some, none)).collect())
    empty = documents(spark, [])
    assert toxic_scores(empty, fit(empty, none)).count() == 0
    one_kind = spark.createDataFrame([(k, 0) for k in range(1, 30)], "doc_id long, toxic int")
    assert all(r["score"] < 0.5 for r in toxic_scores(some, fit(some, one_kind)).collect())
