"""Small tables with the rows that break things."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, node int, text_key int, kept string, spans int"
LONG = "Lorem ipsum dolor sit amet " * 40_000


def documents(spark, texts: list[tuple]):
    """(doc_id, text) rows with more columns, whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", 3) for i, t in texts], DOCS)


def prose(seed: int, n: int, vocabulary: int = 2000) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def odd_texts() -> list[tuple]:
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "one two"), (None, "no id at all here now"), (6, LONG), (7, "é" * 50_000), (7, "é" * 50_000), (8, "\x00​ 漢字 😀")]
