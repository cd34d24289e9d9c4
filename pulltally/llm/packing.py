"""Best-fit packing of token sequences: online, with a fixed number of open sequences per task.

Each task reads its documents once. Open sequences are kept by their free space; a bitset of the taken
spaces finds the tightest one that fits in a few machine operations. A full sequence closes; when more than
`open_limit` are open, the fullest closes. A place is final as soon as it is given, so rows stream out and
memory is bounded by the open sequences. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.tokens import encoder, text_runs

LENGTH = 1024
OPEN_LIMIT = 4096

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """Gives each piece a sequence and an offset."""

    def __init__(self, capacity: int, open_limit: int, first_id: int = 0) -> None:
        self._capacity, self._open_limit, self._next = capacity, open_limit, first_id
        self._bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # open sequences by free space
        self._taken = 0  # bit f: some open sequence has f free
        self._open = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self._capacity:
            raise ValueError("a piece must have between 1 and `capacity` tokens")
        fitting = self._taken >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._pop(free)
        else:
            free, sequence = self._capacity, self._next
            self._next += 1
        left = free - length
        if left:
            self._bins[left].append(sequence)
            self._taken |= 1 << left
            self._open += 1
            if self._open > self._open_limit:
                self._pop((self._taken & -self._taken).bit_length() - 1)
        return sequence, self._capacity - free

    def _pop(self, free: int) -> int:
        sequence = self._bins[free].pop()
        if not self._bins[free]:
            self._taken &= ~(1 << free)
        self._open -= 1
        return sequence


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, before them the rest."""
    first = n % capacity or capacity
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def _packer(tokenizer: str, split: str, end_id: int, capacity: int, open_limit: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = BestFit(capacity, open_limit, TaskContext.get().partitionId() << 33)
        encode, end = encoder(tokenizer, split).encode, end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, last, texts in text_runs(batch.column("text").to_pylist()):
                rows = []
                for doc_id, found in zip(ids[first:last], encode(texts), strict=True):
                    found += end
                    for piece, (start, length) in enumerate(cut(len(found) // 4, capacity)):
                        rows.append((doc_id, piece, start, length, found[4 * start:4 * (start + length)], *bins.place(length)))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

    return pack


def pack_documents(docs: DataFrame, tokenizer: str, split: str = "spaces", end_id: int = 2, capacity: int = LENGTH, open_limit: int = OPEN_LIMIT) -> DataFrame:
    """One row per piece of every row of docs (doc_id, text; other columns are ignored).

    Columns: doc_id, piece (from 0), start (the document's ids before it), length, ids (little-endian unsigned
    32-bit), sequence_id and offset (its place). A document's ids are those of its text and then end_id; only
    documents over `capacity` are cut, the first piece being the shorter one. Null and empty texts have end_id
    alone. Every row is packed by itself, also with a null or repeated doc_id.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_packer(tokenizer, split, end_id, capacity, open_limit), SCHEMA)
