"""Words and word shingles of whole Arrow batches as numpy arrays.

Texts are handled as UTF-8 bytes, several documents at a time. All separators are ASCII, so they
never fall inside a character. Words and shingles are 64-bit hashes: equal texts have equal hashes;
different ones collide with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is handled alone.
CHUNK_BYTES = 1 << 19
SHINGLE = 5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + mix(np.array([seed], np.uint64)))


_BYTE = random_words(256, 1)
_PLACE = random_words(SHINGLE, 2) | _U(1)
_LENGTH = random_words(SHINGLE + 1, 3)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of several documents: document i has those from bounds[i] to bounds[i + 1]."""

    data: np.ndarray  # bytes, A-Z lower-cased
    starts: np.ndarray  # in data
    ends: np.ndarray
    bounds: np.ndarray
    doc_starts: np.ndarray  # in data, one more than documents

    def hashes(self, ends: np.ndarray | None = None) -> np.ndarray:
        """Of each word, or of its beginning up to `ends`."""
        ends = self.ends if ends is None else ends
        up, down = _power_tables(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
        return mix((total[ends] - total[self.starts]) * down[self.starts])

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def byte_chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and offsets of runs of rows of about CHUNK_BYTES. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        yield first, last, whole[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def split_words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Words are runs of bytes that aren't separators, within a document. Rows without words are kept."""
    data = _LOWER[data]
    inside = ~separators[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets), offsets)


@dataclass
class Shingles:
    """Hashes in text order; document i has those from bounds[i] to bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray

    def sets(self) -> Iterator[np.ndarray]:
        """Per document: sorted distinct hashes."""
        for a, b in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            yield np.unique(self.hashes[a:b])


def shingles(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES) -> Shingles:
    """Five-word shingles; of fewer words the whole sequence as one; none without words."""
    words = split_words(data, offsets, separators)
    w, n = words.hashes(), np.diff(words.bounds)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    bounds = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(bounds[-1]) + np.repeat(words.bounds[:-1] - bounds[:-1], count)
    length = np.repeat(np.minimum(n, SHINGLE), count)
    total = _LENGTH[length]
    padded = np.concatenate([w, np.zeros(SHINGLE, np.uint64)])
    for k in range(SHINGLE):
        total += np.where(k < length, padded[at + k], _U(0)) * _PLACE[k]
    return Shingles(mix(total), bounds)
