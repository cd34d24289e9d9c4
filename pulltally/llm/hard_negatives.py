"""Hard negatives for training embeddings, exact, by one-bit codes and intervals around their estimates.

1. Vectors become integers. Rotated by random signs and Hadamard transforms, each gives a one-bit code (the signs), the
   alignment of vector and code (the length of the vector along the unit vector of its code), and the length of the rest.
2. An anchor's rotated vector is cut into BITS bit planes. Popcounts of plane and code estimate the product of anchor and
   code vector, up to the length of what the planes leave out.
3. With g that product, an integer score lies within alignment * g +- rest * sqrt(norm ** 2 - g ** 2): the rest is at right
   angles to the code vector, so Cauchy and Schwarz bound its part. Nothing is left to chance.
4. Anchors and rows meet in blocks. The rows with the highest estimates are scored in integers; their scores are what an
   upper end must reach for a row to be scored at all. First for the positives, then for the negatives.

Every anchor meets every row's code, in blocks of bounded size; first ones of blocks are cut down before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulltally.llm.arrays import random_words
from pulltally.llm.scratch import Scratch

#: Rows and anchors that meet in one group, and anchors handled at once in it.
ROWS = 4096
ANCHORS = 1024
AT_ONCE = 32
#: Bit planes of an anchor's vector.
BITS = 6
#: Times the wanted number of rows that are scored for their high estimates.
SEEDS = 3
#: Components in a block of rows, whatever the vectors' length.
COMPONENTS = 1 << 21
#: Components multiplied at once when pairs are scored one by one; where more than a share of DENSE of all pairs is to be
#: scored, a matrix product does it.
PRODUCTS = 1 << 21
DENSE = 0.05
#: Up to this size of all sums, floating-point products of integers are exact.
EXACT = 2.0**53
#: Squared length up to which every score surely fits a 64-bit number.
LONGEST = 2.0**62

_ENCODED = "row long, vec_id long, label long, dim int, is_anchor boolean, vector binary, code binary, alignment double, rest double, norm double"
_CODE_WORD = 64


def finite(vector: Column) -> Column:
    """Not null, and no component null, infinite or undefined."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def rotate(vectors: np.ndarray) -> np.ndarray:
    """The vectors, padded to a power of two, turned by two rounds of fixed random signs and a Hadamard transform."""
    size = max(_CODE_WORD, 1 << max(0, vectors.shape[1] - 1).bit_length())
    out = np.zeros((len(vectors), size))
    out[:, :vectors.shape[1]] = vectors
    for seed in (31, 32):
        out *= np.where(random_words(size, seed) >> np.uint64(63), 1.0, -1.0)
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
            pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
            half *= 2
        out /= np.sqrt(size)
    return out


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (64-bit words), alignments, lengths of the rests, and norms of integer vectors of one length."""
    turned = rotate(vectors.astype(float))
    codes = np.packbits(turned >= 0, axis=1, bitorder="little").view(np.uint64)
    norm = np.sqrt((turned * turned).sum(axis=1))
    alignment = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return codes, alignment, np.sqrt(np.maximum(norm**2 - alignment**2, 0.0)), norm


def _encoder(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            values = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), float)
            sizes = np.asarray(lists.value_lengths())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                with np.errstate(over="ignore"):
                    whole = np.floor(scale * values[starts[at][:, None] + np.arange(dim)[None, :]])
                    fits = (whole * whole).sum(axis=1) < LONGEST
                at, whole = at[fits], whole[fits].astype(np.int64)
                if not len(at):
                    continue
                codes, alignment, rest, norm = encode(whole)
                mine = batch.select(["row", "vec_id", "label", "is_anchor"]).take(pa.array(at, pa.int64()))
                columns = {
                    "row": mine["row"], "vec_id": mine["vec_id"], "label": mine["label"], "dim": pa.array(np.full(len(at), dim, np.int32)), "is_anchor": mine["is_anchor"],
                    "vector": pa.array([v.tobytes() for v in whole], pa.binary()), "code": pa.array([c.tobytes() for c in codes], pa.binary()),
                    "alignment": pa.array(alignment), "rest": pa.array(rest), "norm": pa.array(norm)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


class _Side:
    """One side of a block pair as numpy arrays."""

    def __init__(self, table: pa.Table) -> None:
        self.vec_id, self.label, self.row = (table[c].to_numpy() for c in ("vec_id", "label", "row"))
        self.alignment, self.rest, self.norm = (table[c].to_numpy() for c in ("alignment", "rest", "norm"))
        self.vector = np.frombuffer(b"".join(table["vector"].to_pylist()), np.int64).reshape(len(table), table["dim"][0].as_py())
        self.floats = self.vector.astype(float)
        self.longest = float(self.norm.max()) * (1 + 1e-9)
        self.code = np.frombuffer(b"".join(table["code"].to_pylist()), np.uint64).reshape(len(table), -1)


def intervals(turned: np.ndarray, codes: np.ndarray, alignment: np.ndarray, rest: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the scores of each anchor (its rotated vector) with each row, given by its code and lengths: lower and upper ends, and estimates."""
    n, size = turned.shape
    low, high = turned.min(axis=1), turned.max(axis=1)
    step = np.maximum(high - low, 1e-9) / (2**BITS - 1)
    levels = np.rint((turned - low[:, None]) / step[:, None]).clip(0, 2**BITS - 1).astype(np.uint8)
    left_out = np.sqrt(((low[:, None] + step[:, None] * levels - turned) ** 2).sum(axis=1))
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    total = np.zeros((n, len(codes)), np.int64)
    for bit in range(BITS):
        plane = np.packbits((levels >> bit) & 1, axis=1, bitorder="little").view(np.uint64)
        for word in range(codes.shape[1]):
            total += np.bitwise_count(plane[:, word, None] & codes[None, :, word]).astype(np.int64) << bit
    # The sum of the components where the code is positive, twice, less all of them, is the product with the signs.
    sums = low * size + step * levels.sum(axis=1, dtype=np.int64)
    product = (2 * (low[:, None] * ones + step[:, None] * total) - sums[:, None]) / np.sqrt(size)
    own = np.sqrt((turned * turned).sum(axis=1))
    near = np.maximum(np.abs(product) - left_out[:, None], 0.0)
    spread = rest * np.sqrt(np.maximum(own[:, None] ** 2 - near**2, 0.0)) + alignment * left_out[:, None]
    spread += 1e-9 * own[:, None] * norm + 1e-6  # more than rounding can change
    centre = alignment * product
    return centre - spread, centre + spread, product * (norm**2 / np.maximum(alignment, 1e-9))


def _scores(anchors: _Side, rows: _Side, at: slice, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer scores of pairs of an anchor, counted from the slice's first, and a row."""
    some = anchors.vector[at]
    if len(i) > DENSE * len(some) * len(rows.vector) and anchors.longest * rows.longest < EXACT:
        return (anchors.floats[at] @ rows.floats.T)[i, j].astype(np.int64)
    out = np.empty(len(i), np.int64)
    step = max(1, PRODUCTS // max(1, rows.vector.shape[1]))
    for k in range(0, len(i), step):
        out[k:k + step] = (some[i[k:k + step]] * rows.vector[j[k:k + step]]).sum(axis=1)
    return out


def _reached(estimates: np.ndarray, among: np.ndarray, n: int, score: Callable, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Per anchor a score that n of the marked rows reach, between low and high; low where too few of those tried do."""
    tried = min(SEEDS * n, estimates.shape[1])
    best = np.argpartition(np.where(among, estimates, -np.inf), estimates.shape[1] - tried, axis=1)[:, estimates.shape[1] - tried:]
    i = np.repeat(np.arange(len(best)), tried)
    found = score(i, best.ravel()).reshape(best.shape).astype(float)
    fits = np.take_along_axis(among, best, axis=1) & (found >= low) & (found <= high)
    found = np.sort(np.where(fits, found, -np.inf), axis=1)
    return np.maximum(found[:, -n, None], low) if tried >= n else np.broadcast_to(low, (len(best), 1))


def _firsts(i: np.ndarray, score: np.ndarray, vec_id: np.ndarray, n: int) -> np.ndarray:
    """Places of the first n of each i: highest scores, of equal ones the smaller id."""
    order = np.lexsort((vec_id, -score, i))
    of = i[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of, "left")
    return order[rank < n]


def _chunks(anchors: _Side, rows: _Side) -> Iterator[tuple[slice, tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray, np.ndarray]]:
    """Some anchors at a time: their slice, the intervals, and the marks of other rows of the same and of other labels."""
    turned = rotate(anchors.vector.astype(float))
    for k in range(0, len(turned), AT_ONCE):
        at = slice(k, k + AT_ONCE)
        ends = intervals(turned[at], rows.code, rows.alignment, rows.rest, rows.norm)
        other = anchors.vec_id[at, None] != rows.vec_id
        same = anchors.label[at, None] == rows.label
        yield at, ends, other & same, other & ~same


_POSITIVE = pa.schema([("anchor_row", pa.int64()), ("anchor_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_NEGATIVE = pa.schema([("anchor_row", pa.int64()), ("window", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _columns(schema: pa.Schema, parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    return pa.table([np.concatenate([p[k] for p in parts]) if parts else pa.array([], f.type) for k, f in enumerate(schema)], schema=schema)


def _best_positives(n: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            anchors, rows = _Side(left), _Side(right)
            for at, (_, upper, estimates), same, _ in _chunks(anchors, rows):
                score_of = partial(_scores, anchors, rows, at)
                none = np.full((len(upper), 1), np.inf)
                i, j = np.nonzero(same & (upper >= _reached(estimates, same, n, score_of, -none, none)))
                score = score_of(i, j)
                first = _firsts(i, score, rows.vec_id[j], n)
                i, j, score = i[first] + at.start, j[first], score[first]
                parts.append((anchors.row[i], anchors.vec_id[i], rows.vec_id[j], score))
        return _columns(_POSITIVE, parts)

    return find


def _best_negatives(n: int, low_percent: int, high_percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if len(left) and len(right):
            anchors, rows = _Side(left), _Side(right)
            windows = [[(-(-low_percent * p // 100), high_percent * p // 100) for p in scores] for scores in left["positive_scores"].to_pylist()]
            most = max(map(len, windows))
            for at, (lower, upper, estimates), _, different in _chunks(anchors, rows):
                score_of = partial(_scores, anchors, rows, at)
                bounds = np.array([[*scores, *[(1, 0)] * (most - len(scores))] for scores in windows[at]], np.int64)  # (1, 0): no window
                low, high = bounds[:, :, 0], bounds[:, :, 1]
                real = low <= high
                # Where the lowest window has n rows, the other windows' first n score no less than those.
                lowest = np.where(real, high, np.iinfo(np.int64).max).argmin(axis=1)[:, None]
                low_end, high_end = (np.take_along_axis(x, lowest, 1).astype(float) for x in (low, high))
                top = np.where(real, high, np.iinfo(np.int64).min).max(axis=1, keepdims=True).astype(float)
                may = different & real.any(axis=1, keepdims=True) & (upper >= low_end) & (lower <= top)
                i, j = np.nonzero(may & (upper >= _reached(estimates, may & (estimates <= high_end), n, score_of, low_end, high_end)))
                scores = np.full(different.shape, np.iinfo(np.int64).min)
                scores[i, j] = score_of(i, j)
                ordered = np.sort(scores, axis=1)
                for w in range(most):
                    ends = np.array([np.searchsorted(row, end, "right") for row, end in zip(ordered, high[:, w], strict=True)])
                    least = np.maximum(np.take_along_axis(ordered, np.maximum(ends - n, 0)[:, None], 1)[:, 0], low[:, w])
                    i, j = np.nonzero((scores >= least[:, None]) & (scores <= high[:, w, None]))
                    score = scores[i, j]
                    first = _firsts(i, score, rows.vec_id[j], n)
                    parts.append((anchors.row[i[first] + at.start], np.full(len(first), w), rows.vec_id[j[first]], score[first]))
        return _columns(_NEGATIVE, parts)

    return find


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], parts: int, find: Callable, kind: str) -> DataFrame:
    """Each block of anchors with each block of rows (of vectors of the same length)."""
    keys = ["dim", "anchor_block", "row_block"]
    of_row = F.pmod(F.xxhash64("row"), F.lit(blocks[1])).cast("int")
    of_anchor = F.pmod(F.xxhash64("row"), F.lit(blocks[0])).cast("int")
    left = anchors.withColumn("anchor_block", of_anchor).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(blocks[1] - 1))))
    rows = rows.select(*[F.col(name).alias(name) for name in rows.columns])  # told apart from the anchors' columns
    right = rows.withColumn("row_block", of_row).withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(blocks[0] - 1))))
    left, right = (side.repartition(parts, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, kind)


def _ranked(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = [F.col("score").desc(), F.col("vec_id").asc()]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def hard_negatives(
    rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows (vec_id, embedding, label) that `anchors` marks.

    Components become floor(scale * x); a score is the integer product. An anchor's positives are its first other rows of
    the same label; for each, the first rows of other labels that score low_percent to high_percent of the positive's score.
    Higher scores come first, ties by the smaller vec_id. Exact, and without a cap.
    Rows with a null id, label or vector, or a null, infinite or undefined component take no part, nor do vectors that are
    2**31 or longer as integers, whose scores may not fit a long. Vectors of other lengths than the anchor's are no partners.
    Rows that repeat an id count each, but are no partners of one another. Without partners an anchor has no row.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vector = F.col("embedding").cast("array<double>")
    known = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(vector))
    known = known.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), F.coalesce(anchors, F.lit(False)).alias("is_anchor"))
    numbered = known.withColumn("row", F.monotonically_increasing_id())
    encoded = scratch.save(numbered.mapInArrow(_encoder(scale), _ENCODED), "encoded")
    sizes = encoded.agg(F.count("*").alias("rows"), F.count_if("is_anchor").alias("anchors"), F.max("dim").alias("dim")).first()
    most = max(1, COMPONENTS // max(1, sizes["dim"] or 1))
    blocks = max(1, -(-sizes["anchors"] // min(ANCHORS, most))), max(1, -(-sizes["rows"] // min(ROWS, most)))
    chosen = encoded.where("is_anchor")

    found = _met(chosen, encoded, blocks, parts, _best_positives(positives), "anchor_row long, anchor_id long, vec_id long, score long")
    firsts = scratch.save(_ranked(found, ["anchor_row"], positives), "positives")
    # At most `positives` scores an anchor, in the order of their ranks.
    windows = firsts.groupBy("anchor_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("positive_scores"))
    asking = chosen.join(windows, chosen["row"] == F.col("anchor_row")).drop("anchor_row")
    found = _met(asking, encoded, blocks, parts, _best_negatives(negatives, low_percent, high_percent), "anchor_row long, window long, vec_id long, score long")
    best = _ranked(found, ["anchor_row", "window"], negatives)
    best = best.select("anchor_row", (F.col("window") + 1).cast("int").alias("_positive"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = firsts.select("anchor_row", F.col("rank").alias("_positive"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(best, ["anchor_row", "_positive"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
