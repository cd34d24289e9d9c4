"""Toxic passages by maximum-scoring segments, calibrated by extreme-value statistics.

Learning: over all labelled training documents, count in how many toxic and clean ones each word occurs,
and each word beginning of 4, 5 and 6 bytes. With an informative Dirichlet prior (the corpus share of the
term, weighing as much as all toxic documents) this gives a log-odds ratio and its z-score. Terms with
z >= 3 and log-odds >= 2.5 form the model; all others count a little below zero.

Scoring: a word has the log-odds of its most specific term. One linear scan finds all maximal scoring
segments (Ruzzo and Tompa). By Karlin and Altschul, a segment of score S among n words of clean text has
the E-value K n exp(-lambda S); lambda comes from the words' rates in clean documents. The document's feature
is the largest -ln E; a logistic curve, fitted to a histogram of the training documents, makes it a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulltally.llm.arrays import Words, byte_chunks, mix, random_words, split_words
from pulltally.llm.scratch import Scratch

MIN_Z = 3.0
MIN_LOG_ODDS = 2.5
#: Score of a word outside the model.
OTHER = -0.5
#: Bytes of the word beginnings that stand in for words too rare to judge.
BEGINNINGS = (6, 5, 4)
#: Passages with E-values up to this are reported.
MAX_E = 0.05
#: Labels up to this number (some 20 MB) are broadcast to the texts; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000
#: Distinct terms that a task counts before it passes them on.
HELD_TERMS = 2_000_000
#: Terms of a model, which every task holds.
MODEL_TERMS = 1_000_000
LOW, HIGH, STEP = -40.0, 80.0, 0.25

_LEVEL = random_words(len(BEGINNINGS) + 1, 31)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[:128] = True
SEPARATORS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False


def held_out(doc_id: Column) -> Column:
    """One fifth of the documents, by a checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def terms(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from whole words to the shortest beginnings: the words that have it, and its hashes."""
    out = [(np.arange(len(words.starts)), mix(words.hashes() ^ _LEVEL[0]))]
    for level, size in enumerate(BEGINNINGS, 1):
        has = words.ends - words.starts >= size
        cut = words.hashes(np.minimum(words.ends, words.starts + size))
        out.append((np.flatnonzero(has), mix(cut[has] ^ _LEVEL[level])))
    return out


def _distinct_terms(words: Words) -> Iterator[np.ndarray]:
    """Per document, its distinct terms of all levels."""
    levels = terms(words)
    cuts = [np.searchsorted(at, words.bounds) for at, _ in levels]
    for i in range(len(words.bounds) - 1):
        yield np.unique(np.concatenate([h[c[i]:c[i + 1]] for (_, h), c in zip(levels, cuts, strict=True)]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): documents of a task that hold the term; term null: all documents; its words as `words`."""
    held, size = [], 0

    def passed() -> pa.RecordBatch:
        keys = np.concatenate([h[0] for h in held])
        toxic = np.concatenate([h[1] for h in held])
        clean = np.concatenate([h[2] for h in held])
        found, at = np.unique(keys, return_inverse=True)
        held[:] = [(found, np.bincount(at, toxic, len(found)), np.bincount(at, clean, len(found)))]
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *(pa.array(x.astype(np.int64)) for x in held[0][1:]), pa.nulls(len(found), pa.int64())], ["term", "toxic", "clean", "words"])

    for batch in batches:
        for first, last, data, offsets in byte_chunks(batch.column("text")):
            label = np.asarray(batch.column("toxic").slice(first, last - first).to_pylist(), bool)
            words = split_words(data, offsets, SEPARATORS)
            sets = list(_distinct_terms(words))
            keys = np.concatenate(sets)
            toxic = np.repeat(label, [len(s) for s in sets]).astype(float)
            held.append((keys, toxic, 1 - toxic))
            size += len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), *(pa.array([int(x)], pa.int64()) for x in (label.sum(), (~label).sum(), np.diff(words.bounds)[~label].sum()))], ["term", "toxic", "clean", "words"]
            )
            if size > HELD_TERMS:
                out = passed()
                size = out.num_rows
                if size > HELD_TERMS // 2:
                    held, size = [], 0
                    yield out
    if held:
        yield passed()


@dataclass
class Model:
    keys: np.ndarray  # sorted term hashes
    scores: np.ndarray
    decay: float  # lambda
    rate: float  # K
    slope: float = 1.0
    offset: float = 0.0

    def word_scores(self, words: Words) -> np.ndarray:
        out = np.full(len(words.starts), OTHER)
        if len(self.keys):
            for at, hashes in reversed(terms(words)):  # whole words last, so that they win
                place = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
                hit = self.keys[place] == hashes
                out[at[hit]] = self.scores[place[hit]]
        return out

    def feature(self, best: float, n_words: int) -> float:
        """-ln E of the best segment score."""
        return self.decay * best - np.log(self.rate * max(n_words, 1))

    def probability(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * feature + self.offset)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first, after last, score), in one pass (Ruzzo and Tompa, 1999)."""
    found: list[list] = []  # first, after last, sum before it, sum with it
    total, before = 0.0, 0
    for at in np.flatnonzero(scores > 0):
        total += OTHER * (at - before)  # between positive words lie only words outside the model
        item = [int(at), int(at) + 1, total, total + scores[at]]
        total, before = item[3], at + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j -= 1
            if j < 0 or found[j][3] >= item[3]:
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3]]
            del found[j:]
    return [(a, b, hi - lo) for a, b, lo, hi in found]


def _lambda(rates: np.ndarray, scores: np.ndarray) -> float:
    """The positive root of sum(rate * exp(lambda * score)) = 1 over model terms and other words."""
    rest = 1 - rates.sum()
    low, high = 1e-6, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if (rates * np.exp(np.minimum(mid * scores, 700))).sum() + rest * np.exp(mid * OTHER) < 1:
            low = mid
        else:
            high = mid
    return low


def _scorer(model: Model, passages: bool):
    """The first column with the score and passages of `text`, or with the feature alone."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in byte_chunks(batch.column("text")):
                words = split_words(data, offsets, SEPARATORS)
                scores = model.word_scores(words)
                features, spans, numbers = [], [], []
                for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
                    found = segments(scores[a:b])
                    best = max((s for _, _, s in found), default=0.0)
                    features.append(model.feature(best, b - a) if found else LOW)
                    if passages:
                        numbers.append(len(found))
                        spans.append([
                            {"first_word": i, "after_word": j, "score": s, "e_value": float(np.exp(-model.feature(s, b - a))), "text": data[words.starts[a + i]:words.ends[a + j - 1]].tobytes().decode()}
                            for i, j, s in found if model.feature(s, b - a) >= -np.log(MAX_E)
                        ])
                features = np.clip(features, LOW, HIGH)
                columns, names = [batch.column(0).slice(first, last - first)], [batch.schema.names[0]]
                if passages:
                    columns += [pa.array(model.probability(features)), pa.array(numbers, pa.int64()), pa.array(spans, _SPANS)]
                    names += ["score", "n_segments", "passages"]
                else:
                    columns.append(pa.array(features))
                    names.append("feature")
                yield pa.RecordBatch.from_arrays(columns, names)

    return score


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("after_word", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64()), ("text", pa.string())]))
_PASSAGES = T.ArrayType(T.StructType([T.StructField("first_word", T.LongType()), T.StructField("after_word", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("e_value", T.DoubleType()), T.StructField("text", T.StringType())]))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of all documents (doc_id, text) that have a label (doc_id, toxic) and aren't held out.

    Labels that are null count as none; of several for one document the mean decides, a half being toxic. A term of one
    toxic document never reaches MIN_Z, so such terms aren't stored. The model holds only terms that pass both limits, at
    most MODEL_TERMS (16 MB), which is checked before they are collected: more are an error, not cut.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    labels = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg(F.col("toxic").cast("int")) >= 0.5).alias("toxic"))
    labels = scratch.save(labels, "labels")
    if labels.count() <= BROADCAST_LABELS:
        labels = F.broadcast(labels)
    training = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").join(labels, "doc_id").select("text", "toxic")
    counts = scratch.save(
        training.mapInArrow(_count, "term long, toxic long, clean long, words long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("toxic", "clean", "words"))).where("term is null or toxic > 1"),
        "counts",
    )
    n = counts.where("term is null").first()
    if n is None or not n["toxic"] or not n["clean"]:
        # Nothing to tell apart: every document gets the share of toxic labels.
        share = ((n["toxic"] or 0) + 0.5) / ((n["toxic"] or 0) + (n["clean"] or 0) + 1) if n else 0.1
        return Model(np.zeros(0, np.uint64), np.zeros(0), 1.0, 1.0, 0.0, float(np.log(share / (1 - share))))
    n_toxic, n_clean, mass = n["toxic"], n["clean"], n["toxic"]
    prior = mass * (F.col("toxic") + F.col("clean")) / F.lit(float(n_toxic + n_clean))
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = lambda x, total: F.log(x / F.greatest(total - x, F.lit(0.5)))
    delta = odds(t, n_toxic + mass) - odds(c, n_clean + mass)
    chosen = counts.where("term is not null").select("term", delta.alias("delta"), (delta / F.sqrt((t + c) / (t * c))).alias("z"), c.alias("clean")).where(f"z >= {MIN_Z} and delta >= {MIN_LOG_ODDS}")
    chosen = scratch.save(chosen, "chosen")
    if (size := chosen.count()) > MODEL_TERMS:
        raise ValueError(f"{size} toxic terms, more than MODEL_TERMS; raise MIN_Z or MIN_LOG_ODDS")
    got = chosen.toPandas()
    keys = got["term"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    scores, clean = got["delta"].to_numpy(float)[order], got["clean"].to_numpy(float)[order]
    # The terms of one word are nested, so the rates of all levels together overstate; that is the careful side.
    rates = clean * n_clean / (n_clean + mass) / max(n["words"], 1) / (len(BEGINNINGS) + 1)
    rates = rates * min(1.0, 0.05 / max(rates.sum(), 1e-12))
    model = Model(keys[order], scores, _lambda(rates, scores) if len(keys) else 1.0, max(float(rates.sum()), 1e-9))
    bins = training.select("toxic", "text").mapInArrow(_scorer(model, False), "toxic boolean, feature double").groupBy(F.round(F.col("feature") / STEP).alias("bin")).agg(
        F.sum(F.col("toxic").cast("long")).alias("toxic"), F.count("*").alias("n")).toPandas()  # at most (HIGH - LOW) / STEP + 1 rows
    x, y, w = bins["bin"].to_numpy(float) * STEP, bins["toxic"].to_numpy(float), bins["n"].to_numpy(float)
    model.slope, model.offset = _logistic(x, y, w)
    return model


def _logistic(x: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope (never below 0) and offset of a logistic curve, by Newton steps with a slight pull of the slope to 0."""
    beta = np.zeros(2)
    design = np.stack([x / 10, np.ones_like(x)], axis=1)
    pull = np.diag([0.5, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + pull, design.T @ (positive - n * p) - pull @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(beta[0] / 10, 0.0), beta[1]


def toxic_scores(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs as `kept` (a struct of all its columns) with its score (0 to 1), number of segments and passages.

    docs needs a column text; others may have any name. A passage has its first word, the word after its last, score,
    E-value and lower-cased text; words are runs of letters. Segments hold toxic terms, but need not be significant. Null, empty and wordless texts have no passage and the
    lowest score. Equal texts score alike.
    """
    rows = docs.select(F.struct("*").alias("kept"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["kept"], T.StructField("score", T.DoubleType()), T.StructField("n_segments", T.LongType()), T.StructField("passages", _PASSAGES)])
    return rows.mapInArrow(_scorer(model, True), schema)
