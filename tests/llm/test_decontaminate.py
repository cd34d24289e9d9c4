from __future__ import annotations

from pulltally.llm.decontaminate import contaminated
from tests.llm.cases import documents, odd_texts, prose
from tests.llm.test_near_dedup import shingle_set


def items_table(spark, items):
    return spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")


def expected(texts, items):
    out = {}
    for i, t in texts:
        for j, u in items:
            need = shingle_set(u)
            both = len(shingle_set(t) & need)
            if i is not None and j is not None and need and 100 * both >= 75 * len(need):
                out[i, j] = max(out.get((i, j), (0, 0)), (len(need), both))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in df.collect()}


def test_against_brute_force(spark):
    items = [(k, " ".join(prose(1000 + k, 6 + 3 * k))) for k in range(30)]
    texts = []
    for k in range(60):
        words = prose(k, 3000 if k % 7 == 0 else 300)
        item = items[k % 30][1].split()
        if k % 3 == 0:
            at = 13 * k % 250
            words[at:at] = item
        elif k % 3 == 1:
            part = item[: int(len(item) * (0.6 + 0.1 * (k % 5)))]
            words[50:50] = part
        texts.append((k, " ".join(words).upper() if k % 2 else " ".join(words)))
    result = found(contaminated(documents(spark, texts), items_table(spark, items)))
    assert result == expected(texts, items) and len(result) > 20


def test_short_items_at_every_place(spark):
    """Items of four to nine words, at the start, the end and many places of texts of many lengths."""
    items = [(n, " ".join(f"q{n}x{k}" for k in range(n))) for n in range(4, 10)]
    texts = []
    for n, item in items:
        for k in range(250):
            words = prose(1000 * n + k, 20 + k % 90)
            at = (7 * k) % (len(words) + 1)
            texts.append((len(texts), " ".join([*words[:at], *item.split(), *words[at:]])))
    texts.append((len(texts), items[0][1]))
    result = found(contaminated(documents(spark, texts), items_table(spark, items)))
    assert set(result) == {(250 * (n - 4) + k, n) for n in range(5, 10) for k in range(250)} | {(1500, 4)}


def test_odd_rows(spark):
    texts = [*odd_texts(), (9, "a b c d e f g h"), (9, "a b c d e f"), (None, "a b c d e f g h")]
    items = [(1, None), (2, ""), (3, "a b c d e f"), (None, "a b c d e"), (4, "ONE two"), (4, "one two"), (5, "é" * 50_000)]
    assert found(contaminated(documents(spark, texts), items_table(spark, items))) == expected(texts, items) == {(9, 3): (2, 2), (4, 4): (1, 1), (5, 4): (1, 1), (7, 5): (1, 1)}


def test_empty(spark):
    some = documents(spark, [(1, "a b c d e f")])
    assert contaminated(some, items_table(spark, [])).count() == 0
    assert contaminated(documents(spark, []), items_table(spark, [(1, "a b c d e f")])).count() == 0
