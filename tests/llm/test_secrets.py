from __future__ import annotations

import base64
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from pulltally.llm import secrets
from pulltally.llm.queries import QUERIES
from tests.llm.cases import documents, odd_texts, prose

ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
KINDS = ("assign", "access", "hex", "random")


def base_spans(text):
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def random_spans(text, model):
    found = []
    for m in re.finditer("[A-Za-z0-9+/_=-]{16,}", text):
        signs = [0, *map(ord, m[0]), 0]
        if sum(model.ratios[128 * a + b] for a, b in zip(signs, signs[1:])) > model.threshold:
            found.append(("random", m.start(), m.end()))
    return found


def found(df):
    return {r["kept"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in df.collect()}


def samples(spark, seed, n=600):
    rng = random.Random(seed)
    words = ["".join(rng.choice(("ba", "re", "tion", "ing", "lo", "_id", "str", "un", "20")) for _ in range(rng.randint(2, 7))) for _ in range(n)]
    keys = [base64.b64encode(rng.randbytes(24)).decode().rstrip("=") if k % 2 else rng.randbytes(20).hex() for k in range(n // 4)]
    return spark.createDataFrame([(w, False) for w in words] + [(k, True) for k in keys], "token string, random boolean")


def awkward():
    hexed, key = "0123456789abcdef" * 2, "AKIA" + "ABCDEFGH12345678"
    return [
        f"é😀 Password: 'hunter22' token=abc secret = short1 API_KEY='x-y.z/w+' apikey:{hexed}", f"token: token: abcdef passwd=\"{key}\"",
        f"{key} {key[:19]} {key}{key} AKIAAKIA{key}", f"{hexed} {hexed[:23]} g{hexed}g {hexed.upper()}", "token==abcdefg", "secret \x20 : \n value99",
        "password:" * 50, "tokenpassword=" + "=" * 9, "TOKEN\t=abcdef", "a" * 40, "\x00token=abcdef\x00", "ſecret=abcdefg Kelvin toKen=abcdefg", "1" * 30,
    ]


def test_against_brute_force(spark):
    model = secrets.fit(samples(spark, 1))
    rng = random.Random(5)
    texts = awkward() + [" ".join(rng.choice(awkward() + prose(k, 9)) for _ in range(30)) for k in range(40)]
    texts += [base64.b64encode(rng.randbytes(30)).decode() + " src/main/strings/reunions_id", "x" * 20 + "é" + rng.randbytes(30).hex()]
    want = {i: sorted(base_spans(t) + random_spans(t, model), key=lambda s: (s[1], KINDS.index(s[0]))) for i, t in enumerate(texts)}
    assert found(secrets.secret_spans(documents(spark, list(enumerate(texts))), model)) == want


def test_held_out_strings(spark):
    model = secrets.fit(samples(spark, 1, 8000))
    judged = samples(spark, 2).where("length(token) >= 16").withColumn("taken", secrets.log_ratio(F.col("token"), model) > model.threshold)
    counts = {(r["random"], r["taken"]): r["count"] for r in judged.groupBy("random", "taken").count().collect()}
    assert counts.get((True, False), 0) <= 0.02 * counts[True, True] and counts.get((False, True), 0) <= 0.01 * counts[False, False]


def test_model_is_the_ratio_of_smoothed_counts(spark):
    model = secrets.fit(spark.createDataFrame([("ab", True), ("aa", True), ("ab", False), ("abab", False), ("b", False), (None, True), ("", False)], "token string, random boolean"))
    a, b = ord("a"), ord("b")
    assert model.ratios[128 * a + b] == pytest.approx(math.log((1 + .5) / (3 + 33)) - math.log((3 + .5) / (3 + 33)))
    assert model.ratios[a] == pytest.approx(math.log((2 + .5) / (2 + 33)) - math.log((2 + .5) / (3 + 33)))
    assert model.threshold == pytest.approx(math.log(3 / 2))


def test_learned_from_the_corpus(spark):
    rng = random.Random(3)
    texts = [(k, " ".join(prose(k, 60)) + f" kept_in_the_long_identifier_{k}") for k in range(60)]
    planted = base64.b64encode(rng.randbytes(30)).decode()
    docs = documents(spark, [*texts, (99, f"see {planted} here")])
    by_id = found(secrets.secret_spans(docs, secrets.fit(secrets.labelled_samples(docs))))
    assert by_id.pop(99) == [("random", 4, 4 + len(planted))]
    assert not any(by_id.values())


def test_odd_rows(spark):
    docs = documents(spark, [*odd_texts(), (20, "q" * 300_000), (21, "token=abcdef " * 3000), (21, "token=abcdef " * 3000)])
    result = secrets.secret_spans(docs, secrets.fit(secrets.labelled_samples(docs)))
    rows = result.collect()
    assert len(rows) == docs.count() and all(not r["spans"] for r in rows if r["kept"]["doc_id"] not in (20, 21))
    assert [[s["end"] for s in r["spans"]] for r in rows if r["kept"]["doc_id"] == 21] == [[13 * k + 12 for k in range(3000)]] * 2
    empty = docs.limit(0)
    assert secrets.secret_spans(empty, secrets.fit(secrets.labelled_samples(empty))).count() == 0
    nothing = secrets.fit(spark.createDataFrame([], "token string, random boolean"))
    assert all(not r["spans"] for r in secrets.secret_spans(documents(spark, [(1, "x9Kq" * 20)]), nothing).collect())


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op11_secrets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
