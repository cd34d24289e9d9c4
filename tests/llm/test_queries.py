"""The registered queries over the smallest sample, and the pipeline stage by stage."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from pulltally.llm.queries import ORACLE, QUERIES
from pulltally.llm import scratch
from pulltally.llm.scratch import Scratch, discard
from tests.llm.cases import documents, odd_texts, prose

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, duck, name):
    result = QUERIES[name](spark, FOLDER)
    cursor = duck.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(result.columns)
    assert Counter(map(tuple, result.select(*names).collect())) == Counter(cursor.fetchall())


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}


def test_pipeline(spark, duck):
    result = corpus_pipeline.run(spark, FOLDER).collect()
    ids = {r["doc_id"] for r in result}
    documents_, contaminated = (duck.execute(q).fetchall() for q in ("SELECT doc_id FROM documents", f"SELECT DISTINCT doc_id FROM ({ORACLE['op2_decontaminate']})"))
    assert ids < {i for (i,) in documents_} and not ids & {i for (i,) in contaminated}
    copies = duck.execute(f"SELECT component_id, list(doc_id) FROM ({ORACLE['op1_near_dedup']}) GROUP BY 1 HAVING count(*) > 1").fetchall()
    toxic = {r["doc_id"] for r in QUERIES["op9_toxicity"](spark, FOLDER).collect() if r["predicted"]}
    assert not ids & toxic
    # Of each group one stays at most; it may be split by a toxic member that linked others.
    assert all(len(ids & set(group)) <= 1 for _, group in copies if not toxic & set(group))
    clean = {i for (i,) in documents_} - toxic - {i for (i,) in contaminated} - {i for _, g in copies for i in g}
    assert clean <= ids


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, tmp_path, stage):
    labels = [(100 + k, k % 2) for k in range(40)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(prose(1, 30))), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [*odd_texts(), *((100 + k, " ".join(prose(k, 30))) for k in range(40)), (300, "mail a@b.cd now please today")]
    docs = documents(spark, texts)
    function = dict(corpus_pipeline.STAGES)[stage]
    result = Scratch(spark, "test").save(function(spark, docs, str(tmp_path)), "out")
    left = Counter(r["doc_id"] for r in result.collect())
    if stage == "packing":
        assert set(left) == {i for i, _ in texts}
        return
    assert result.columns == docs.columns
    want = Counter(i for i, _ in texts)
    if stage == "near_dedup":
        want.subtract([5, 7])
    if stage == "decontamination":
        want.subtract([101])
    assert left == +want
    if stage == "personal_data":
        assert result.where("doc_id = 300").first()["text"] == "mail [EMAIL] now please today"
    assert function(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_repeated_ids_lose_no_document(spark, tmp_path):
    one, other, third = (" ".join(prose(k, 60)) for k in (1, 2, 3))
    rows = [(1, one), (1, None), (1, None), (2, one + " more"), (2, other), (3, other + " end"), (4, third), (4, third), (4, ""), (5, "few"), (5, "words"), (6, "few"), (None, one), (None, one)]
    result = corpus_pipeline.drop_near_duplicates(spark, documents(spark, rows), str(tmp_path))
    assert result.columns == documents(spark, rows).columns
    left = Counter((r["doc_id"], r["text"]) for r in result.collect())
    assert left == Counter({(1, one): 1, (1, None): 1, (2, other): 1, (4, third): 1, (4, ""): 1, (5, "few"): 1, (5, "words"): 1, (None, one): 2})


def test_toxic_by_score_alone(spark, tmp_path):
    """A document goes by its score alone, significant passage or not; but never without any toxic term."""
    bad = ["vile", "scum", "filth", "trash", "idiot", "moron", "loser", "creep"]
    letters = str.maketrans("0123456789", "abcdefghij")
    plain = {k: " ".join(prose(k, 25)).translate(letters) for k in range(900)}
    texts = [(k, plain[k] + (f" {bad[k % 8]} {bad[k // 8 % 8]} {bad[k // 64 % 8]}" if k % 5 == 1 else "")) for k in range(900)]
    spark.createDataFrame([(k, int(k % 5 == 1)) for k in range(900)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(prose(7, 30_000)).translate(letters)
    docs = documents(spark, [*texts, *((1000 + n, " ".join(prose(n, n)).translate(letters) + " vile scum") for n in (10, 100, 1000, 10_000)), (2000, long)])
    model = corpus_pipeline.toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = {r["kept"]["doc_id"]: r for r in corpus_pipeline.toxicity.toxic_scores(docs, model).collect()}
    left = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).collect()}
    assert left == {i for i, r in scores.items() if r["score"] < 0.5 or not r["n_segments"]}
    assert 2000 in left and not left & set(range(1, 900, 5)) and left >= {k for k in range(900) if k % 5 != 1}


def test_stored_tables_can_be_removed(tmp_path, spark, monkeypatch):
    monkeypatch.setattr(scratch, "_made", [])
    table = Scratch(spark, "gone").save(spark.range(3), "t")
    assert table.count() == 3
    (folder,) = (path for _, path in scratch._made)
    discard(spark)
    assert not scratch._made and not os.path.exists(folder.removeprefix("file://"))
