from __future__ import annotations

import math
import random
import re
import textwrap

from pulltally.llm.licenses import PHRASES, TEMPLATES, license_notices
from tests.llm.cases import documents, odd_texts, prose

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected(text, templates=TEMPLATES):
    w = words(text)
    places = [(k, label) for p, label in PHRASES.items() for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
    blocks, at = [], 0
    for line in (text or "").split("\n"):
        own = words(line)
        found = {}
        for label, notices in templates.items():
            for notice in notices:
                need = set(words(notice))
                both = len(need & set(own))
                if both >= math.ceil(0.75 * len(need)):
                    found.setdefault(both / len(need), set()).add(label)
        if found:
            blocks += [(label, at, at + len(own), max(found)) for label in sorted(found[max(found)])]
        at += len(own)
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places}), blocks


def found(row):
    return (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"], [tuple(b) for b in row["blocks"]])


def test_against_brute_force(spark):
    rng = random.Random(4)
    notices = [n for x in TEMPLATES.values() for n in x]
    texts = []
    for k in range(200):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            line = " ".join(prose(rng.randrange(10**6), rng.randrange(20)))
            if rng.random() < 0.6:
                notice = words(rng.choice(notices))
                rng.shuffle(notice) if rng.random() < 0.3 else None
                line += " " + " ".join(notice[: int(len(notice) * rng.choice([0.6, 0.75, 0.8, 1]))]).upper() + " " + " ".join(prose(k, 5))
            lines.append(line)
        texts.append((k, "\n".join(lines)))
    rows = {r["doc_id"]: r for r in license_notices(documents(spark, texts)).collect()}
    for i, t in texts:
        assert found(rows[i]) == expected(t), t
    assert sum(len(r["blocks"]) for r in rows.values()) > 50


def test_sample_lines(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "Licensed under CC BY-SA 4.0.": "cc-by-sa", "Released under the MIT License.": None, "This work is licensed under the GNU General Public License, version 3.": "gpl"}
    rows = {r["doc_id"]: r for r in license_notices(documents(spark, list(enumerate(lines)))).collect()}
    for k, label in enumerate(lines.values()):
        assert [b["label"] for b in rows[k]["blocks"]] == ([label] if label else [])


def test_odd_rows(spark):
    rows = license_notices(documents(spark, odd_texts())).collect()
    assert sorted(map(repr, map(found, rows))) == sorted(repr(expected(t)) for _, t in odd_texts())
    assert license_notices(documents(spark, [])).count() == 0
    assert license_notices(documents(spark, [(1, "mit license")]), templates={}).first()["base_labels"] == ["mit"]


def test_wrapped_notices(spark):
    """Every notice has its block however its lines are broken, with comment marks and text around it."""
    cases = [(label, notice, width) for label, notices in TEMPLATES.items() for notice in notices for width in (40, 72, 80)]
    texts = []
    for k, (_, notice, width) in enumerate(cases):
        lines = [" ".join(prose(k, 9)), "", *textwrap.wrap(notice, width), "", " ".join(prose(k + 1, 9))]
        texts.append((k, "\n".join(f" * {x}" for x in lines)))
    rows = {r["doc_id"]: r for r in license_notices(documents(spark, texts)).collect()}
    for k, (label, notice, width) in enumerate(cases):
        full = {tuple(b) for b in rows[k]["blocks"] if b["containment"] == 1}
        lines = textwrap.wrap(notice, width)
        if len(lines) > 1:
            last = max(words(notice).index(w) for w in words(notice)) + 1  # words that stand before end no block
            assert (label, 9, 9 + last, 1.0) in full, (label, width)
        assert label in {b[0] for b in full}
        assert "gpl" not in {b["label"] for b in rows[k]["blocks"]} or label == "gpl"


def test_stretches_stay_inside(spark):
    """Words of a notice that stand too far apart or in two documents are no block."""
    head, tail = TEMPLATES["mit"][0][:70], TEMPLATES["mit"][0][70:]
    texts = [(1, f"{head}\n{' '.join(prose(1, 30))}\n{tail}"), (2, head), (3, tail), (4, f"{head}\n{tail}\n{head}\n{tail}")]
    rows = {r["doc_id"]: [tuple(b) for b in r["blocks"]] for r in license_notices(documents(spark, texts).coalesce(1)).collect()}
    n = len(words(TEMPLATES["mit"][0]))
    assert not rows[1] and not rows[2] and not rows[3]
    assert rows[4] == [("mit", 0, n, 1.0), ("mit", n, 2 * n, 1.0)]


def test_several_notices_in_a_line(spark):
    """A line that holds a whole notice and most of others has blocks of all; of gpl only where it stands by itself."""
    cut = {label: " ".join(words(TEMPLATES[label][0])) for label in ("bsd", "mit", "gpl", "lgpl", "isc")}
    part = " ".join(cut["mit"].split()[:17])
    own = cut["gpl"].replace("this program is free", "it is free")
    texts = [(1, f"{cut['bsd']} {part}"), (2, cut["lgpl"]), (3, f"{cut['lgpl']} {' '.join(prose(1, 40))} {own}"), (4, f"{' '.join(prose(2, 300))} {part} {' '.join(prose(3, 300))} {cut['bsd']} {cut['isc']}")]
    rows = {r["doc_id"]: {b["label"]: b["containment"] for b in r["blocks"]} for r in license_notices(documents(spark, texts)).collect()}
    n = len(set(cut["mit"].split()))
    assert set(rows[1]) == {"bsd", "mit"} and rows[1]["bsd"] == 1 and math.ceil(0.75 * n) / n <= rows[1]["mit"] < 1
    assert rows[2] == {"lgpl": 1.0}
    assert set(rows[3]) == {"lgpl", "gpl"} and rows[3]["lgpl"] == 1 > rows[3]["gpl"]
    assert set(rows[4]) == {"bsd", "mit", "isc"}
