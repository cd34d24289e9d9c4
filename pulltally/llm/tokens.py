"""Token ids of whole texts by a public tokenizer, with a bounded cache of ids per piece of text."""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: How a text falls into pieces that the tokenizer treats independently.
#: "words": white space only separates (it is dropped, and no token or normal form spans it).
#: "spaces": byte-level; a piece may begin with the space before it, and a line end is a token of its own.
#: "whole": the text is one piece.
SPLITS = ("words", "spaces", "whole")
#: Pieces kept in each of two generations; some 80 MB for usual words. When the young one is full it becomes the old one;
#: pieces of the old one that are met again are young again, the others go with it.
CACHED = 400_000
#: Longer pieces are encoded but not kept.
LONGEST = 64
#: Pieces encoded in one call; they are joined by a mark, which saves most of a call's cost.
JOINED = 200

#: White space as Python and the tokenizers see it, for Arrow's patterns.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Runs of white space that hold a space, runs of line ends, and beginnings of special tokens reach across a split.
_SPANNING = rf"{_SPACE} | {_SPACE}|\n{_SPACE}|{_SPACE}\n|<\|"
#: Pieces that can't be joined with others: with white space, the mark or the beginning of a special token.
_ALONE = re.compile(r"[\s\x01]|<\|")


class Encoder:
    """Ids of a text, exactly as `Tokenizer.encode(text, add_special_tokens=False)` gives them.

    Splitting at single spaces and line ends between other characters changes nothing: these tokenizers'
    patterns never match beyond such a place. Texts with other white space there are encoded whole.
    """

    def __init__(self, path: str, split: str) -> None:
        if split not in SPLITS:
            raise ValueError(f"split must be one of {SPLITS}")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._split = split
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        # A mark between pieces, which is always one token, and before each piece what stands there in a text.
        self._mark, self._lead = (" \x01 ", "") if split == "words" else ("\n", " ")
        ids = self._ids([self._mark])[0]
        self._mark_id = ids[0] if len(ids) == 1 else None
        self._last = self._word_ends() if split == "words" else None
        self._line_end = array("I", self._ids(["\n"])[0]).tobytes()

    def _word_ends(self) -> np.ndarray | None:
        """Per id, whether it ends a word; None where the tokenizer doesn't mark ends, or not after every byte."""
        from tokenizers.pre_tokenizers import ByteLevel

        suffix, vocabulary = getattr(self._tokenizer.model, "end_of_word_suffix", None), self._tokenizer.get_vocab()
        if not suffix or any(x + suffix not in vocabulary for x in ByteLevel.alphabet()):
            return None
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[x for token, x in vocabulary.items() if token.endswith(suffix)]] = True
        return last

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces of letters, where ids that end a word tell them apart without a mark.

        A piece has at least one such id; where a group has as many as pieces, each piece has just one. Other groups are left out.
        """
        found: dict[str, bytes] = {}
        groups = [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, ids in zip(groups, self._ids([" ".join(g) for g in groups]), strict=True):
            numbers = np.array(ids, "<u4")
            at = 4 * np.flatnonzero(self._last[numbers]) + 4
            if len(at) == len(group):
                raw, ends = numbers.tobytes(), at.tolist()
                found.update(zip(group, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        return found

    def _joined(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of pieces that hold neither white space nor the mark, each after `lead`."""
        out: list[bytes] = []
        groups = [pieces[i:i + JOINED] for i in range(0, len(pieces), JOINED)]
        for group, ids in zip(groups, self._ids([self._mark.join([lead + p for p in g]) for g in groups]), strict=True):
            numbers = np.array(ids, "<u4")
            at = np.flatnonzero(numbers == self._mark_id)
            if len(at) != len(group) - 1:
                raise ValueError("the tokenizer joins pieces; use split='whole'")
            raw = numbers.tobytes()
            out += [raw[a:b] for a, b in zip([0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(raw)], strict=True)]
        return out

    def _fill(self, missing: list[str]) -> dict[str, bytes]:
        """Ids of new pieces, each with what leads to it in a text: a space, or its own line end."""
        found = self._letters([p for p in missing if p.isalpha()]) if self._last is not None else {}
        if found:
            missing = [p for p in missing if p not in found]
        lines = [p for p in missing if p[:1] == "\n"] if self._split == "spaces" else []
        plain = [p for p in missing if p[:1] != "\n"] if lines else missing
        alone: list[str] = []
        bare = [p[1:] for p in lines]
        # Seldom does any piece have to stand alone, so all are searched at once first.
        if self._mark_id is None or _ALONE.search("".join(plain)) or _ALONE.search("".join(bare)):
            apart = [self._mark_id is None or bool(_ALONE.search(p)) for p in plain]
            alone = [p for p, a in zip(plain, apart, strict=True) if a]
            plain = [p for p, a in zip(plain, apart, strict=True) if not a]
            apart = [self._mark_id is None or bool(_ALONE.search(p)) for p in bare]
            alone += [p for p, a in zip(lines, apart, strict=True) if a]
            lines = [p for p, a in zip(lines, apart, strict=True) if not a]
        empty = [p for p in ("", "\n") if p in missing]
        if empty:
            alone += empty
            plain, lines = [p for p in plain if p], [p for p in lines if p != "\n"]
            alone = list(dict.fromkeys(alone))
        found.update(zip(plain, self._joined(plain, self._lead), strict=True))
        found.update(zip(lines, (self._line_end + x for x in self._joined([p[1:] for p in lines], "")), strict=True))
        led = [p if self._split != "spaces" or p[:1] == "\n" else " " + p for p in alone]
        found.update(zip(alone, (array("I", x).tobytes() for x in self._ids(led)), strict=True))
        return found

    def _known(self, pieces: list[str]) -> list[bytes]:
        """Ids of different pieces, from the cache or new."""
        if len(self._young) > CACHED:
            self._old, self._young = self._young, {}
        values = list(map(self._young.get, pieces))
        gaps = [k for k, v in enumerate(values) if v is None]
        if gaps:
            wanted = [pieces[k] for k in gaps]
            old = self._old
            found = {p: old[p] for p in wanted if p in old} if old else {}
            missing = [p for p in wanted if p not in found] if found else wanted
            if missing:
                found.update(self._fill(missing))
            for k, value in zip(gaps, map(found.get, wanted), strict=True):
                values[k] = value
            if max(map(len, wanted)) > LONGEST:
                found = {p: v for p, v in found.items() if len(p) <= LONGEST}
            self._young.update(found)
        return values

    def _split_texts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be split. Each different piece is looked up once; its ids are copied to all its places."""
        between, into = ("\n", " ") if self._split == "words" else ("\n", " \n")
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), between, into), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        pieces = lists.flatten().dictionary_encode()
        at = pieces.indices.to_numpy()
        heads = [b""] * len(texts)
        if self._split == "spaces":  # nothing leads to a text's first piece
            first = pieces.dictionary.take(pieces.indices.take(pa.array(bounds[:-1]))).to_pylist()
            heads = [array("I", x).tobytes() for x in self._ids(first)]
        values = self._known(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = np.frombuffer(b"".join(values), "<u4")
        number = np.int32 if sum(map(len, texts)) < 1 << 28 else np.int64  # a character gives few ids
        sizes = np.fromiter(map(len, values), number, len(values)) >> 2
        starts = np.cumsum(sizes, dtype=number) - sizes
        n = sizes[at]
        if self._split == "spaces":
            n[bounds[:-1]] = 0
        ends = np.cumsum(n, dtype=number)
        placed = np.repeat(starts[at] - (ends - n), n)
        placed += np.arange(len(placed), dtype=number)
        placed = ids[placed]
        edges = np.concatenate([[0], ends])[bounds]
        raw = memoryview(placed.tobytes())
        return [head + bytes(raw[4 * a:4 * b]) for head, a, b in zip(heads, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text, its ids as little-endian unsigned 32-bit numbers."""
        if not texts:
            return []
        whole = np.full(len(texts), self._split == "whole")
        if self._split == "spaces":
            whole = pc.match_substring_regex(pa.array(texts, pa.large_string()), _SPANNING).to_numpy(zero_copy_only=False)
        out: list[bytes | None] = [None] * len(texts)
        for k, ids in zip(np.flatnonzero(whole).tolist(), self._ids([texts[k] for k in np.flatnonzero(whole).tolist()]), strict=True):
            out[k] = array("I", ids).tobytes()
        rest = np.flatnonzero(~whole).tolist()
        if rest:
            for k, ids in zip(rest, self._split_texts([texts[k] for k in rest]), strict=True):
                out[k] = ids
        return out


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, split: str) -> Encoder:
    """One encoder for each tokenizer in a Python worker; it outlives the task."""
    if (path, split) not in _encoders:
        _encoders[path, split] = Encoder(path, split)
    return _encoders[path, split]


def public_tokenizer(name: str) -> str:
    """Place of a public tokenizer's file; every executor has them."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_runs(texts: list[str | None], most: int = 1 << 20):
    """(first, after last, texts) of runs of about `most` characters. Nulls are empty."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i == len(texts) - 1:
            yield first, i + 1, [t or "" for t in texts[first:i + 1]]
            first, size = i + 1, 0
