from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
import xxhash

from pulltally.llm import pii
from pulltally.llm.pii import base_spans, personal_data, redact
from tests.llm.cases import documents, odd_texts
from tests.llm.cases import prose as numbered

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


def expected(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


def test_patterns():
    rng = random.Random(2)
    parts = ["a", "b.c", "@", "@", ".", "-", " ", "1", "25", "255", "300", "0007", "+", "4111111111111111", "4111 1111-1111 1111", "555-", "(", ")", "é", "\n", "%", "_"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(14)))
        assert base_spans(text) == expected(text), text


def test_long_runs_are_linear():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000):
        assert isinstance(base_spans(text), list)


def test_spans_and_redaction(spark):
    texts = [*odd_texts(), (11, "é Mail: a.b@c.de, +1 (555) 555-1234 or 10.0.0.1!")]
    rows = personal_data(documents(spark, texts)).collect()
    assert len(rows) == len(texts)
    row = next(r for r in rows if r["kept"]["doc_id"] == 11)
    assert row["redacted"] == "é Mail: [EMAIL], [PHONE] or [IP]!"
    assert row["kept"]["text_key"] == 2 and row["kept"]["kept"] == "x"
    for r in rows:
        text = r["kept"]["text"]
        assert [tuple(s) for s in r["spans"]] == expected(text or "")
        assert (r["redacted"] is None) == (text is None)
        assert r["redacted"] == text or text and r["spans"]


def test_disclosing_terms(spark):
    """A name that always stands beside an address gives it away; common words and copies don't."""
    def prose(seed, n, vocabulary):
        return ["".join("abcdefghij"[int(d)] for d in w[1:]) + "en" for w in numbered(seed, n, vocabulary)]

    texts = [(k, " ".join([*prose(k, 12, 50), "Zebulon", "x@y.org", *prose(500 + k, 12, 50)])) for k in range(6)]
    texts += [(100 + k, " ".join(prose(100 + k, 40, 50))) for k in range(300)]
    texts += [(900 + k, "Quandary words stand here q@z.org often enough") for k in range(20)]
    rows = {r["kept"]["doc_id"]: r for r in personal_data(documents(spark, texts)).collect()}
    for k in range(6):
        text = texts[k][1]
        assert [text[s["start"]:s["end"]] for s in rows[k]["spans"] if s["kind"] == "term"] == ["Zebulon"]
        assert "[NAME] [EMAIL]" in rows[k]["redacted"]
    assert not any(s["kind"] == "term" for i, r in rows.items() if i > 5 for s in r["spans"])


def test_overlaps():
    assert redact("ab cd", [("email", 0, 3), ("ip", 1, 2), ("phone", 2, 4)]) == "[EMAIL]d"
    assert redact("ab cd", []) == "ab cd"


def test_empty(spark):
    assert personal_data(documents(spark, [])).count() == 0
    assert pii.disclosing_terms(documents(spark, []).select("text")) is None


def letters(seed, n, vocabulary=50):
    return ["".join("abcdefghij"[int(d)] for d in w[1:]) + "en" for w in numbered(seed, n, vocabulary)]


def terms(spark, texts):
    rows = personal_data(documents(spark, texts)).collect()
    return {r["kept"]["doc_id"]: [r["kept"]["text"][s["start"]:s["end"]] for s in r["spans"] if s["kind"] == "term"] for r in rows}


def test_copies_count_neither_for_nor_against_a_term(spark):
    texts = [(k, " ".join([*letters(k, 12), "Zebulon", "x@y.org", *letters(500 + k, 12)])) for k in range(6)]
    texts += [(100 + k, " ".join(letters(100 + k, 40))) for k in range(300)]
    texts += [(1000 + k, texts[0][1]) for k in range(1000)]
    found = terms(spark, texts)
    assert all(found[k] == ["Zebulon"] for k in (*range(6), *range(1000, 2000)))
    assert not any(found[k] for k in range(100, 400))


def test_terms_anywhere_in_the_document(spark):
    """A name at the head discloses the address at the foot and goes wherever it stands, long words between or not."""
    texts = [(k, " ".join(["Zebulon", *letters(k, 60), "zebulon", *letters(700 + k, 30), "q" * 300, "x@y.org"])) for k in range(8)]
    texts += [(100 + k, " ".join(letters(100 + k, 40))) for k in range(300)]
    found = terms(spark, texts)
    for k in range(8):
        assert [t for t in found[k] if t.lower() == "zebulon"] == ["Zebulon", "zebulon"]
        assert set(found[k]) == {"Zebulon", "zebulon", "q" * 300}
    assert not any(found[k] for k in range(100, 400))


def test_two_texts_are_evidence_in_a_large_corpus(spark):
    """An address seen twice has terms where the corpus is large enough to tell them from chance; one seen once has none."""
    texts = [(k, " ".join([*letters(k, 9), "Zebulon", "x@y.org", *letters(500 + k, 9)])) for k in range(2)]
    texts += [(10, "Quandary stands here q@z.org")] + [(100 + k, " ".join(letters(100 + k, 12))) for k in range(5000)]
    found = terms(spark, texts)
    assert found[0] == found[1] == ["Zebulon"] and not any(t for i, t in found.items() if i > 1)
    few = terms(spark, texts[:300])
    assert not any(few.values())


def test_near_copies_are_one_text(spark):
    """Two texts of 42 and 43 words that differ in one, or many near copies of one, give no term; a name met elsewhere does."""
    base = letters(1, 42, 5000)
    texts = [(0, " ".join([*base, "x@y.org"])), (1, " ".join([*base[:20], "added", *base[20:], "x@y.org"]))]
    long = letters(2, 120, 5000)
    texts += [(10 + k, " ".join([*long[:k], f"changed{'abcdefghij'[k]}", *long[k:], "p@y.org"])) for k in range(10)]
    texts += [(50 + k, " ".join([*letters(900 + k, 9, 5000), "Zebulon", "z@y.org", *letters(950 + k, 9, 5000)])) for k in range(3)]
    texts += [(60 + k, " ".join([*letters(900, 9, 5000), "Zebulon", "z@y.org", *letters(950, 9, 5000), "end"])) for k in range(3)]
    texts += [(100 + k, " ".join(letters(100 + k, 12, 5000))) for k in range(5000)]
    found = terms(spark, texts)
    assert all(found.pop(k) == ["Zebulon"] for k in (50, 51, 52, 60, 61, 62))
    assert not any(found.values())


@pytest.mark.parametrize("copies", [0, pii.COPIES])
def test_terms_against_brute_force(spark, monkeypatch, copies):
    monkeypatch.setattr(pii, "COPIES", copies)
    rng = random.Random(11)
    texts = []
    for person in range(12):
        name, address = f"Name{'abcdefghijkl'[person]}", f"p{person}@y.org"
        for k in range(rng.randint(1, 5)):
            words = letters(100 * person + k, rng.randint(10, 40), 60)
            words.insert(rng.randrange(len(words)), name)
            words.insert(rng.randrange(len(words)), address)
            texts += [" ".join(words)] * rng.randint(1, 3)
            if rng.random() < 0.4:
                texts.append(" ".join([*words, "last"]))
        texts += [" ".join([*letters(5000 + 10 * person + k, 15, 60), name]) for k in range(rng.randint(0, 2))]
    texts += [" ".join(letters(9000 + k, 20, 60)) for k in range(800)]

    keys = {t: xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts}
    keys = {t: k - (1 << 64) if k >> 63 else k for t, k in keys.items()}
    batch = pa.RecordBatch.from_arrays([pa.array(keys.values(), pa.int64()), pa.array(keys)], ["text_key", "text"])
    bands = dict(zip(keys, next(pii._bands(iter([batch]))).column("bands").to_pylist()))
    least = {}
    for t, found in bands.items():
        for band in found:
            least[band] = min(least.get(band, keys[t]), keys[t])
    counted = [t for t, found in bands.items() if all(least[band] == keys[t] for band in found)]
    assert len(counted) < len(keys)

    def words(t):
        return {w for w, _, _ in pii.words_outside(t, pii.base_spans(t))}

    def entities(t):
        return {t[a:b] for _, a, b in pii.base_spans(t)}

    holding = Counter(w for t in keys for w in words(t))
    both, n_entity = Counter(), Counter(e for t in counted for e in entities(t))
    for t in counted:
        both.update((e, w) for e in entities(t) for w in words(t))
    others = Counter((e, w) for t in set(keys) - set(counted) for e in entities(t) for w in words(t))
    strong = set()
    for (e, w), n in both.items():
        rest = holding[w] - others[e, w] - n
        floor, share = (n_entity[e] / len(counted)) ** (1 - pii.DISCLOSURE), n / (n + rest)
        gain = n * math.log(share / floor) + (rest * math.log((1 - share) / (1 - floor)) if share < 1 else 0)
        if share > floor and gain >= pii.EVIDENCE:
            strong.add((e, w))
    assert strong
    want = {i: {w for e in entities(t) for w in words(t) if (e, w) in strong} for i, t in enumerate(texts)}
    assert {i: {w.lower() for w in found} for i, found in terms(spark, list(enumerate(texts))).items()} == want
