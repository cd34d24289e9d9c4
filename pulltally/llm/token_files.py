"""Token-id files with Elias-Fano document boundaries.

A file is a run of segments, each followed by a line feed. A segment holds, little-endian: magic (8 bytes);
part and number in the part (u32 each), documents (u32), documents without an id, which come first (u32), bytes per
token id (u8, 2 or 4), low bits of the boundaries and of the document ids (u8 each), a zero byte, tokens (u64), bytes of
the high parts of both (u64 each), the first document id (i64); the boundaries; the document ids, less the first; the
token ids, concatenated.

Boundaries are the document ends e_0 <= e_1 <= ... in Elias-Fano form: the low bits of all values, packed; the high
parts in unary, as a bit vector in which value i sets bit (e_i >> low) + i; and for every 64th set bit its position
(u32). This takes about 2 + log2(tokens per document) bits for each document; an offset is found by one select. The
ascending document ids are kept in the same way.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch
from pulltally.llm.tokens import encoder, text_runs

MAGIC = b"TOKSEG02"
HEADER = struct.Struct("<8sIIIIBBBxQQQq")
SAMPLE = 64
#: A segment ends with the document that reaches this many tokens; a file holds so many segments.
SEGMENT_TOKENS = 1 << 18
SEGMENTS_PER_FILE = 64

_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Number of low bits, low part, high part and select samples of a non-decreasing sequence of numbers from 0."""
    n, top = len(ends), int(ends[-1]) if len(ends) else 0
    low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
    ends = ends.astype(np.uint64)
    low = np.packbits((ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) == 1, bitorder="little")
    at = (ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((top >> low_bits) + n + 1, bool)
    high[at] = True
    return low_bits, low.tobytes(), np.packbits(high, bitorder="little").tobytes(), at[::SAMPLE].astype("<u4").tobytes()


class Boundaries:
    """Select over the stored form; it never builds a table of all offsets."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self._low_bits = n, low_bits
        self._low, self._high = np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self._samples = np.frombuffer(samples, "<u4")

    def end(self, i: int) -> int:
        """The i-th document's end."""
        at = int(self._samples[i // SAMPLE])
        left, byte = i % SAMPLE, at // 8
        bits = int(self._high[byte]) >> (at % 8) << (at % 8)
        while left >= (ones := int(_ONES[bits])):
            left, byte = left - ones, byte + 1
            bits = int(self._high[byte])
        for _ in range(left):
            bits &= bits - 1
        position = byte * 8 + (bits & -bits).bit_length() - 1
        first, last = i * self._low_bits, (i + 1) * self._low_bits
        low = int.from_bytes(self._low[first // 8:-(-last // 8)].tobytes(), "little") >> (first % 8)
        return (position - i) << self._low_bits | low & ((1 << self._low_bits) - 1)

    def start(self, i: int) -> int:
        return self.end(i - 1) if i else 0

    def ends(self) -> Iterator[int]:
        """All ends in order, by select."""
        return map(self.end, range(self.n))


def write_segment(part: int, number: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """Documents in ascending order of their ids, those without one first."""
    tokens = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([len(x) // 4 for x in ids]).astype(np.int64)
    width = 2 if not len(tokens) or tokens.max() < 1 << 16 else 4
    known = [x for x in doc_ids if x is not None]
    if doc_ids[:len(doc_ids) - len(known)] != [None] * (len(doc_ids) - len(known)) or known != sorted(known):
        raise ValueError("documents must ascend by id")
    first = known[0] if known else 0
    low_bits, *boundaries = elias_fano(ends)
    id_bits, *names = elias_fano(np.array([x - first for x in known], np.uint64))
    header = HEADER.pack(
        MAGIC, part, number, len(ids), len(ids) - len(known), width, low_bits, id_bits, len(tokens), len(boundaries[1]), len(names[1]), first)
    return b"".join([header, *boundaries, *names, tokens.astype(f"<u{width}").tobytes()])


class Segment:
    """A segment at `begin` of a file's bytes."""

    def __init__(self, content: bytes, begin: int = 0) -> None:
        magic, self.part, self.number, n, unnamed, width, low_bits, id_bits, tokens, high, id_high, self._first = HEADER.unpack_from(content, begin)
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")

        def parts(n: int, low_bits: int, high: int) -> tuple[int, int, int]:
            return -(-n * low_bits // 8), high, 4 * -(-n // SAMPLE)

        sizes = (*parts(n, low_bits, high), *parts(n - unnamed, id_bits, id_high), width * tokens)
        at = begin + HEADER.size + np.concatenate([[0], np.cumsum(sizes)])
        *held, ids = (content[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
        if len(ids) != sizes[-1]:
            raise ValueError("a segment is cut off")
        self.boundaries, self._unnamed = Boundaries(n, low_bits, *held[:3]), unnamed
        self._names = Boundaries(n - unnamed, id_bits, *held[3:])
        self.ids = np.frombuffer(ids, f"<u{width}")
        self.after = int(at[-1]) + 1

    def doc_id(self, i: int) -> int | None:
        """The i-th document's id."""
        return None if i < self._unnamed else self._first + self._names.end(i - self._unnamed)

    def tokens(self, i: int) -> np.ndarray:
        """The i-th document's token ids."""
        return self.ids[self.boundaries.start(i):self.boundaries.end(i)]


def _segmenter(tokenizer: str, split: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        encode, end = encoder(tokenizer, split).encode, end_id.to_bytes(4, "little")
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([write_segment(part, number, doc_ids, ids)], pa.binary())], ["segment"])
            doc_ids.clear()
            ids.clear()
            return out

        for batch in batches:
            known = batch.column("doc_id").to_pylist()
            for first, last, texts in text_runs(batch.column("text").to_pylist()):
                for doc_id, found in zip(known[first:last], encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    ids.append(found + end)
                    size += len(found) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield passed()
                        number, size = number + 1, 0
        if ids:
            yield passed()

    return write


def write_token_files(docs: DataFrame, path: str, tokenizer: str, split: str = "words", end_id: int = 1) -> None:
    """Writes the ids of every row of docs (doc_id, text) to binary files below path, in ascending doc_id order.

    Rows go to tasks by ranges of doc_id (of equal ids, by a hash of the text), nulls first; each document's ids end
    with end_id, so a null or empty text has that one. Parts and segment numbers tell the order of all segments.
    Spark's own writer commits the files, so they may lie in any store and lost tasks leave nothing behind.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    segments = rows.select("doc_id", "text").mapInArrow(_segmenter(tokenizer, split, end_id), "segment binary")
    segments.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", SEGMENTS_PER_FILE).option("lineSep", "\n").text(path)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("content"):
            content, at = value.as_py(), 0
            while at < len(content):
                segment = Segment(content, at)
                at = segment.after
                ends = np.fromiter(segment.boundaries.ends(), np.int64, segment.boundaries.n)
                doc_ids = [segment.doc_id(i) for i in range(segment.boundaries.n)]
                starts = np.concatenate([[0], ends[:-1]])
                ids = segment.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in (np.full(n, segment.part), np.full(n, segment.number), doc_ids, starts, ends - starts, crc)],
                    ["part", "number", "doc_id", "place", "n_tokens", "ids_crc32"],
                )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files below path.

    start counts the ids of all documents before it, over all segments: running totals within each part,
    and over the parts. ids_crc32 is the checksum of the ids as little-endian unsigned 32-bit numbers.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = Scratch(spark, "token-files").save(files.mapInArrow(_reader, "part long, number long, doc_id long, place long, n_tokens long, ids_crc32 long"), "rows")
    segments = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = segments.withColumn("in_part", before(Window.partitionBy("part").orderBy("number")))
    parts = segments.groupBy("part").agg(F.sum("n").alias("n")).withColumn("before_part", before(Window.orderBy("part"))).drop("n")  # one row per part
    starts = inside.join(parts, "part").select("part", "number", (F.col("in_part") + F.col("before_part")).alias("base"))
    return rows.join(starts, ["part", "number"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
