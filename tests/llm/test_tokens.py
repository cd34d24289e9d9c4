from __future__ import annotations

import random
import struct
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer

from pulltally.llm import token_files
from pulltally.llm.packing import BestFit, cut, pack_documents
from pulltally.llm.shipping import ship_package
from pulltally.llm.token_files import Boundaries, Segment, elias_fano, read_token_files, write_segment, write_token_files
from pulltally.llm.tokens import Encoder, public_tokenizer
from tests.llm.cases import documents, odd_texts, prose

PARTS = ["a", "b c", " ", "  ", "\n", " \n", "\n ", "\t", "'s", "é", "́", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|", "A", "ÄÖ", "123", "!?", "한", "😀", "Σ", "x's", "\r\n", "\x00", "\x01"]


@pytest.mark.parametrize(("name", "split"), [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "spaces"), ("byte_bpe_50k.json", "whole")])
def test_pieces_change_nothing(name, split):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PARTS, k=rng.randrange(12))) for _ in range(4000)]
    plain, encoder = Tokenizer.from_file(public_tokenizer(name)), Encoder(public_tokenizer(name), split)
    for _ in range(2):
        assert encoder.encode(texts) == [array("I", e.ids).tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_new_words_need_no_marks(monkeypatch):
    path, got = public_tokenizer("word_bpe_49k.json"), []
    words = sorted({f"{a}{b}{c}"[k:] for a in ("in", "Über", "año", "漢") for b in ("tion", "Σ", "elle", "xq") for c in ("s", "ñ", "ing") for k in range(3)})
    encoder, ids = Encoder(path, "words"), Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, texts: [got.append(len(x)) or x for x in ids(self, texts)])
    found = encoder.encode([" ".join(words * 2)])[0]
    assert 4 * 2 * sum(got) == len(found)  # the library gives each word's ids once, and nothing else
    assert found == array("I", Tokenizer.from_file(path).encode(" ".join(words * 2), add_special_tokens=False).ids).tobytes()


# Letters of which the normal form holds a mark, so that they are several words, or one that its neighbours don't join.
@pytest.mark.parametrize("odd", ["İ", "xİx", "\u0958", "a\u0958b", "ﬁn", "ẞ", "ǰ", "\u3164", "ªº", "Ⅷ", "x\u02b0", "\U0001e900", "\u1c89", "\ufb1d"])
def test_words_of_several_tokens_of_the_library(odd):
    path = public_tokenizer("word_bpe_49k.json")
    text = " ".join([*prose(1, 300), *(f"{'abcdefghij'[k % 10] * (k // 10 + 1)}" for k in range(300)), odd, "end", odd + "s", "last"])
    for order in (text, " ".join(reversed(text.split()))):
        assert Encoder(path, "words").encode([order])[0] == array("I", Tokenizer.from_file(path).encode(order, add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("lengths", [[1], [5, 1, 1, 70_000, 3], [1] * 1000, list(range(1, 500)), [0, 0, 4]])
def test_elias_fano(lengths):
    ends = np.cumsum(lengths).astype(np.int64)
    low_bits, *parts = elias_fano(ends)
    stored = Boundaries(len(ends), low_bits, *parts)
    assert list(stored.ends()) == ends.tolist()
    assert [stored.end(i) for i in range(len(ends))] == ends.tolist()
    assert stored.start(0) == 0


def test_elias_fano_is_small():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    assert sum(map(len, elias_fano(ends)[1:])) * 8 / len(ends) < 13.5


@pytest.mark.parametrize("known", [[-1, 7], [5], [], [-(2**63), -1, 0, 2**63 - 1], [3, 3, 3], list(range(0, 90_000, 9)), [2**62 + k * k for k in range(1000)]])
@pytest.mark.parametrize("unnamed", [0, 2])
def test_segment_round_trip(known, unnamed):
    doc_ids = [None] * unnamed + known
    ids = [[], [1], [1, 2, 99_999]]
    content = write_segment(3, 4, doc_ids, [array("I", ids[k % 3]).tobytes() for k in range(len(doc_ids))])
    segment = Segment(b"xx" + content + b"\n", 2)
    assert (segment.part, segment.number, segment.after) == (3, 4, len(content) + 3)
    assert [segment.doc_id(k) for k in range(len(doc_ids))] == doc_ids
    assert [segment.tokens(k).tolist() for k in range(len(doc_ids))] == [ids[k % 3] for k in range(len(doc_ids))]
    with pytest.raises((ValueError, struct.error)):
        Segment(content[:-1] if len(doc_ids) > 1 else content[:20])


def test_document_ids_are_small():
    content = write_segment(0, 0, list(range(0, 30_000, 3)), [b"\1\0\0\0"] * 10_000)
    assert len(content) * 8 / 10_000 < 16 + 3 + 5  # token, boundary, id


def test_segments_ascend():
    for wrong in ([7, -1], [7, None]):
        with pytest.raises(ValueError):
            write_segment(0, 0, wrong, [b"", b""])


def test_token_files(spark, tmp_path, monkeypatch):
    ship_package(spark)
    monkeypatch.setattr(token_files, "SEGMENTS_PER_FILE", 2)
    texts = [*odd_texts(), *((20 - k, " ".join(prose(k, 40))) for k in range(12))]
    path = f"file://{tmp_path}/ids"
    write_token_files(documents(spark, texts), path, public_tokenizer("word_bpe_49k.json"))
    rows = sorted(read_token_files(spark, path).collect(), key=lambda r: r["start"])
    plain = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    want = {(i, (t or "")): plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts}
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    place = 0
    for r in rows:
        assert r["start"] == place
        place += r["n_tokens"]
        assert (r["n_tokens"], r["ids_crc32"]) in {(len(x), zlib.crc32(array("I", x))) for (i, _), x in want.items() if i == r["doc_id"]}


def test_best_fit():
    bins = BestFit(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 10, 9, 8, 5)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (4, 0), (5, 0)]
    assert bins.place(2) == (4, 8)  # 3 was the fullest of three and closed
    assert bins.place(1) == (5, 5)
    for bad in (0, 11):
        with pytest.raises(ValueError):
            bins.place(bad)
    assert list(cut(25, 10)) == [(0, 5), (5, 10), (15, 10)] and list(cut(20, 10)) == [(0, 10), (10, 10)] and list(cut(1, 10)) == [(0, 1)]


def test_packing(spark):
    ship_package(spark)
    texts = [*odd_texts(), *((20 + k, " ".join(prose(k, 30 + 7 * k))) for k in range(80))]
    rows = pack_documents(documents(spark, texts), public_tokenizer("byte_bpe_50k.json")).collect()
    plain = Tokenizer.from_file(public_tokenizer("byte_bpe_50k.json"))
    sequences, docs = {}, {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["ids"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    for i, t in texts:
        if i != 7:  # twice
            pieces = sorted(docs[i])
            assert b"".join(p[2] for p in pieces) == array("I", [*plain.encode(t or "", add_special_tokens=False).ids, 2]).tobytes()
            assert all(len(p[2]) == 4096 for p in pieces[1:]) and [p[0] for p in pieces] == list(range(len(pieces)))
    tokens = sum(r["length"] for r in rows)
    assert len(sequences) <= 1.05 * tokens / 1024 + 4 * 2


def test_empty(spark, tmp_path):
    ship_package(spark)
    assert pack_documents(documents(spark, []), public_tokenizer("byte_bpe_50k.json")).count() == 0
    write_token_files(documents(spark, []), f"file://{tmp_path}/none", public_tokenizer("word_bpe_49k.json"))
    assert read_token_files(spark, f"file://{tmp_path}/none").count() == 0
