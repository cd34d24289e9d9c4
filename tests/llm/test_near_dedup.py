from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pytest

from pulltally.llm import near_dedup
from pulltally.llm.components import connected_components
from pulltally.llm.near_dedup import near_duplicate_classes
from pulltally.llm.scratch import Scratch
from tests.llm.cases import documents, odd_texts, prose


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def expected(texts):
    sets = {i: shingle_set(t) for i, t in texts}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_against_brute_force(spark):
    texts, rng = [], np.random.default_rng(1)
    for group in range(12):
        base = prose(group, 120)
        for copy in range(8):
            words = list(base)
            for at in rng.choice(len(words), copy % 5, replace=False):
                words[at] = f"x{group}-{copy}-{at}"
            texts.append((len(texts), " ".join(words)))
    rng.shuffle(texts)
    texts = [(i, t) for i, (_, t) in enumerate(texts)]
    assert found(near_duplicate_classes(documents(spark, texts))) == expected(texts)


def test_chains_and_blocks(spark, monkeypatch):
    """Neighbours in a chain are similar, distant ones aren't; small blocks take the later steps."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    words = prose(99, 400)
    texts = [(100 - k, " ".join(words[4 * k:4 * k + 160])) for k in range(40)]
    assert found(near_duplicate_classes(documents(spark, texts))) == expected(texts)


def test_odd_rows(spark):
    rows = near_duplicate_classes(documents(spark, odd_texts())).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(odd_texts())
    assert [(by_id[i]["n_shingles"], by_id[i]["component_id"]) for i in (1, 2, 3, 4, 5, 7)] == [(0, 1), (0, 2), (0, 3), (1, 4), (1, 4), (1, 7)]
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    assert not by_id[5]["kept"] and by_id[4]["kept"]


def test_empty(spark):
    assert near_duplicate_classes(documents(spark, [])).count() == 0


@pytest.mark.parametrize("few", [2, 16])
def test_small_and_large_bands(spark, monkeypatch, few):
    """Groups around two texts that are alike in parts: bands of every size, paired by joins or in blocks."""
    monkeypatch.setattr(near_dedup, "FEW", few)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng, texts = np.random.default_rng(8), []
    for group in range(6):
        base = prose(group, 200)
        for copy in range(3 * group + 2):
            words = list(base)
            for at in rng.choice(len(words), 3 + copy % 7, replace=False):
                words[at] = f"y{group}-{copy}-{at}"
            texts.append(" ".join(words))
    texts = [(i, t) for i, t in enumerate(rng.permutation(texts).tolist())]
    assert found(near_duplicate_classes(documents(spark, texts))) == expected(texts)


def test_sets_that_share_one_fingerprint_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, 10, 7), (2, 10, 7), (3, 11, 7), (4, 12, 8)], "doc_id long, check long, node long")
    clashes = spark.createDataFrame([(7, 10)], "node long, _least long")
    nodes = {r["doc_id"]: r["node"] for r in near_dedup._apart(rows, clashes).collect()}
    assert nodes[1] == nodes[2] == 7 and nodes[4] == 8 and nodes[3] not in (7, 8)
    hashes = np.arange(1, 50, dtype=np.uint64)
    assert near_dedup.fingerprint(hashes) != near_dedup.fingerprint(hashes, 1)
    assert [near_dedup.fingerprint(hashes[::-1], k) for k in (0, 1)] == [near_dedup.fingerprint(hashes, k) for k in (0, 1)]


def test_rows_that_repeat_an_id(spark):
    one, other = (" ".join(prose(k, 50)) for k in (1, 2))
    rows = [(3, one), (3, other), (7, other), (9, one), (9, None)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicate_classes(documents(spark, rows)).collect())
    assert got == [(3, 46, 3, True), (3, 46, 3, True), (7, 46, 3, False), (9, 0, 9, True), (9, 46, 3, False)]


@pytest.mark.parametrize("shift", [0, 1000])
def test_components(spark, shift):
    rng = np.random.default_rng(3)
    pairs = [(int(a) + shift, int(b) + shift) for a, b in rng.integers(0, 300, (200, 2))] + [(k + 500, k + 501) for k in range(60)] + [(900, k) for k in range(901, 960)]
    edges = spark.createDataFrame([*pairs, (None, 5), (7, 7)], "u long, v long")
    parts = {r["node"]: r["component"] for r in connected_components(edges, Scratch(spark, "test"), "c").collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        return i if root[i] == i else find(root[i])

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert parts == {i: find(i) for i in list(root)}
