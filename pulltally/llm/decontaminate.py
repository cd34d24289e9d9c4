"""Benchmark items inside documents, however long: MinHash containment search, then exact shingle containment.

Whole long documents have hopelessly small similarities to short items, so both sides are partitioned
by size: items fall into size classes of powers of two, and for each class documents are cut into
overlapping windows of two blocks of that many shingles, so that every place of an item lies within
one window. An item of one shingle is looked up as it is; any other of a class has a similarity of at least 0.17 to its window when 0.75 of
its shingles are there, and one common minimum of 48 makes the pair a candidate (missed with a chance of 1e-4
at worst, of 1e-6 where the whole item is present). Block minima of a class come from those of the class below, so
all classes cost one pass. A fixed-size table of item minima keeps other windows from the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.arrays import Shingles, byte_chunks, mix, random_words, shingles
from pulltally.llm.scratch import Scratch

MINIMA = 48
#: Places in the table that holds the items' minima for the map side; it is 4 MB whatever the number of items.
PLACES = 1 << 25

_A = random_words(MINIMA, 21) | np.uint64(1)
_B = random_words(MINIMA, 22)
_SALT = random_words(MINIMA, 23)


def _keys(values: np.ndarray, k: int, size: int) -> np.ndarray:
    return mix(values ^ (_SALT[k] + np.uint64(size)))


def _size_class(n: int) -> int:
    """A class holds sizes up to its own, above half of it."""
    return 1 << max(n - 1, 0).bit_length()


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in byte_chunks(batch.column("text")):
            ids = batch.column("item_id").slice(first, last - first).to_pylist()
            item, size, number, key = [], [], [], []
            for i, s in zip(ids, shingles(data, offsets).sets(), strict=True):
                if len(s):
                    c = _size_class(len(s))
                    least = [s] if c == 1 else [(s * _A[k] + _B[k]).min(keepdims=True) for k in range(MINIMA)]
                    item += [i] * len(least)
                    size += [c] * len(least)
                    number += [len(s)] * len(least)
                    key += [int(_keys(x, k, c).view(np.int64)[0]) for k, x in enumerate(least)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, size, number, key)], ["item_id", "size", "n_item", "key"])


def window_keys(found: Shingles, sizes: list[int], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) of the window minima whose place in the table is taken, for all size classes (ascending)."""
    docs, keys = [], []
    counts = np.diff(found.bounds)

    def look_up(owner: np.ndarray, key: np.ndarray) -> None:
        place = key & np.uint64(PLACES - 1)
        hit = (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0
        docs.append(owner[hit])
        keys.append(key[hit])

    if 1 in sizes:
        look_up(np.repeat(np.arange(len(counts)), counts), _keys(found.hashes, 0, 1))
    wider = [size for size in sizes if size > 1]
    for k in range(MINIMA if wider else 0):
        values, n, size = found.hashes * _A[k] + _B[k], counts, 1
        while len(values) and size < wider[-1]:
            # Minima of runs of blocks: of the smallest class's shingles first, then always of two.
            step = wider[0] if size == 1 else 2
            blocks = -(-n // step)
            begin = np.repeat(np.cumsum(n) - n, blocks) + step * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
            values, n, size = np.minimum.reduceat(values, begin), blocks, size * step
            if size in wider:
                owner = np.repeat(np.arange(len(n)), n)
                window = values.copy()
                joined = np.flatnonzero(owner[:-1] == owner[1:])
                window[joined] = np.minimum(values[joined], values[joined + 1])
                look_up(owner, _keys(window, k, size))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def _searcher(sizes: list[int], table: bytes):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = np.frombuffer(table, np.uint8)
        for batch in batches:
            for first, last, data, offsets in byte_chunks(batch.column("text")):
                docs, keys = window_keys(shingles(data, offsets), sizes, places)
                pairs = np.unique(np.stack([docs.astype(np.uint64), keys]), axis=1) if len(docs) else np.zeros((2, 0), np.uint64)
                ids = batch.column("doc_id").slice(first, last - first).take(pa.array(pairs[0].astype(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(pairs[1].view(np.int64))], ["doc_id", "key"])

    return search


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared shingles of each (document text, item text)."""
    for batch in batches:
        n_item, n_shared = [], []
        for text, item in zip(batch.column("text"), batch.column("item_text"), strict=True):
            sets = []
            for value in (text, item):
                whole = pa.array([value.as_py()], pa.large_string())
                sets.append(next(next(shingles(d, o) for _, _, d, o in byte_chunks(whole)).sets()))
            n_item.append(len(sets[1]))
            n_shared.append(len(np.intersect1d(*sets, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("item_id"), pa.array(n_item, pa.int64()), pa.array(n_shared, pa.int64())], ["doc_id", "item_id", "n_item", "n_shared"])


def contaminated(docs: DataFrame, items: DataFrame, threshold_percent: int = 75) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item found in a document.

    docs: doc_id, text; items: item_id, text; other columns are ignored. Found means 100 * shared distinct
    shingles >= threshold_percent * the item's. A text of fewer than five words is one shingle, so a short item
    is found only in a document of just these words. Null, empty and blank texts match nothing; rows without
    doc_id or item_id are left out. Rows that repeat an id count as one document or item with the best of their values.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "contaminated")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null")
    keys = scratch.save(items.mapInArrow(_item_keys, "item_id long, size long, n_item long, key long"), "keys")
    sizes = sorted(r["size"] for r in keys.select("size").distinct().collect())  # one for each power of two
    schema = "doc_id long, item_id long, n_item long, n_shared long"
    if not sizes:
        return spark.createDataFrame([], f"{schema}, containment double")
    # The taken places as words of 64 bits, OR-ed on the executors: at most PLACES / 64 rows of 8 bytes.
    place = F.col("key").bitwiseAND(PLACES - 1)
    words = keys.groupBy(F.floor(place / 64).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((key & {PLACES - 1}) % 64 as int))")).alias("bits"))
    table = np.zeros(PLACES // 64, np.int64)
    taken = words.toPandas()
    table[taken["word"].to_numpy(np.int64)] = taken["bits"].to_numpy(np.int64)
    hits = docs.mapInArrow(_searcher(sizes, table.tobytes()), "doc_id long, key long")
    pairs = scratch.save(hits.join(keys.select("key", "item_id").distinct(), "key").select("doc_id", "item_id").distinct(), "pairs")
    texts = scratch.save(docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")
    both = pairs.join(items.select("item_id", F.col("text").alias("item_text")), "item_id").join(texts, "doc_id").select("doc_id", "item_id", "text", "item_text")
    found = both.mapInArrow(_verify, schema).where(100 * F.col("n_shared") >= threshold_percent * F.col("n_item"))
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_item", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_shared", (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"))
