from __future__ import annotations

import re

from pyspark.sql import functions as F

from pulltally.operators import metrics
from pulltally.samples.tables import pr_diffs
from pulltally.sources.exports import diff_chunks
from tests.data import DIFF, DIFF_COUNTS, at

COUNTS = ("test_additions", "doc_additions", "security_pattern_matches")


def counts(spark, texts):
    df = spark.createDataFrame([("r/r", i, t) for i, t in enumerate(texts)], "repo STRING, number BIGINT, diff STRING")
    whole = {r.number: tuple(r[c] for c in COUNTS) for r in metrics.diff_line_counts(df).collect()}
    lines = df.filter("diff IS NOT NULL").select("repo", "number", F.explode(F.split("diff", "\n", -1)).alias("line"))
    by_line = {r.number: tuple(r[c] for c in COUNTS) for r in metrics.diff_line_counts_by_line(lines).collect()}
    assert whole == by_line
    for size in (1, 2, 3, 7, 50, 1 << 20):
        chunks = diff_chunks(df, size)
        assert {r.number: tuple(r[c] for c in COUNTS) for r in metrics.diff_line_counts_by_chunk(chunks).collect()} == whole
    return whole


def expected(text):
    tests = (r"test|[.]spec[.]", r"README|\.md|/\*\*|///|#[^\n\r\u2028\u2029]*(?:TODO|FIXME)",
             r"password|secret|token|api_key|private_key|auth")
    added = [line for line in text.split("\n") if line.startswith("+")]
    return tuple(sum(bool(re.search(t, line, re.IGNORECASE | re.ASCII)) for line in added) for t in tests)


def test_sample_diff(spark):
    assert counts(spark, [DIFF]) == {0: DIFF_COUNTS}


def test_line_rules(spark):
    texts = [
        "+const password = 'hardcoded';\n+const token = process.env.API_TOKEN;",
        "+++ b/tests/app.py\n-test\n test\n+latest author",
        "+# a TODO\r\n+# later\rfixme\n+#\u2028todo\n+todo #\n+#todo",
        "+x\r+test\n+a.SPEC.b\n+README\n+x.MD /** ///",
        "+to\u212aen\n+F\u0130XME # f\u0130xme\n+TO\u212aEN toKEN",
        "", "\n", "+", "no lines added\n-auth",
        "+ÉTÉ TEST\n+# Ünï FIXME\n+api_KEY Private_Key",
    ]
    assert counts(spark, texts) == {i: expected(t) for i, t in enumerate(texts)}


def test_null_diff_has_no_counts(spark):
    assert counts(spark, [None, "+test"]) == {1: (1, 0, 0)}


def tables(spark):
    details = spark.createDataFrame(
        [("r/r", 1, 10, None, 4), ("r/r", 1, 10, None, 4), ("r/r", 2, 5, 5, 1), ("r/r", 4, None, None, None)],
        "repo STRING, number BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT")
    diffs = spark.createDataFrame(
        [("r/r", 1, DIFF), ("r/r", 3, DIFF), ("r/r", 4, "+auth"), ("r/r", 4, "+auth"), ("r/r", 2, None)],
        "repo STRING, number BIGINT, diff STRING")
    return details, diffs


def test_metrics_need_details_and_diff(spark):
    rows = metrics.pr_metrics(*tables(spark)).orderBy("number").collect()
    assert [tuple(r) for r in rows] == [("r/r", 1, *DIFF_COUNTS, 10, 0, 4), ("r/r", 4, 0, 0, 1, 0, 0, 0)]


def test_metrics_of_a_selection(spark):
    details, diffs = tables(spark)
    selected = spark.createDataFrame([("r/r", 4), ("r/r", 4), ("r/r", 2)], "repo STRING, number BIGINT")
    assert metrics.few_rows(selected, 3) and not metrics.few_rows(selected, 2)
    assert metrics.few_rows(selected, 3, most_bytes=12) and not metrics.few_rows(selected, 3, most_bytes=11)
    for small in (False, True):
        rows = metrics.pr_metrics(details, diffs, selected, broadcast_selected=small).collect()
        assert [r.number for r in rows] == [4]


def test_metrics_from_lines(spark):
    details, diffs = tables(spark)
    lines = diffs.filter("diff IS NOT NULL").select("repo", "number", F.explode(F.split("diff", "\n", -1)).alias("line"))
    once = metrics.pr_metrics(details, lines.filter("number = 1")).collect()
    assert [tuple(r) for r in once] == [("r/r", 1, *DIFF_COUNTS, 10, 0, 4)]


def test_texts_are_not_shuffled(spark):
    details, diffs = tables(spark)
    plan = metrics.pr_metrics(details, diffs)._jdf.queryExecution().executedPlan().toString()
    for part in plan.split("Exchange")[1:]:
        assert "diff#" not in part.split("\n")[0]


def test_details_fill_sizes(spark):
    details, _ = tables(spark)
    prs = spark.createDataFrame([("r/r", 1, "a"), ("r/r", 9, "a")], "repo STRING, number BIGINT, author STRING")
    rows = {r.number: r for r in metrics.with_details(prs, details).collect()}
    assert rows[1].additions == 10 and rows[9].additions is None and len(rows) == 2


def test_latest_copy_of_details_counts(spark):
    layout = "repo STRING, number BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT, exported_at TIMESTAMP"
    details = spark.createDataFrame(
        [("r/r", 1, size, 0, 1, at(f"2025-01-{day}T00:00:00")) for size, day in ((10, "02"), (500, "04"), (70, "03"))], layout)
    prs = spark.createDataFrame([("r/r", 1)], "repo STRING, number BIGINT")
    assert metrics.with_details(prs, details).first().additions == 500
    diffs = spark.createDataFrame([("r/r", 1, "+x")], "repo STRING, number BIGINT, diff STRING")
    assert metrics.pr_metrics(details.orderBy("additions"), diffs).first().total_additions == 500


def test_metrics_from_chunks(spark):
    details, diffs = tables(spark)
    once = diff_chunks(diffs.filter("number = 1"), 5)
    assert once.count() > 20
    assert [tuple(r) for r in metrics.pr_metrics(details, once).collect()] == [("r/r", 1, *DIFF_COUNTS, 10, 0, 4)]


def test_chunks_are_read_and_shuffled_once(spark, tmp_path):
    spark.createDataFrame([("r/r", 1, 0, b"+test\n+au"), ("r/r", 1, 1, b"th\n")], "repo STRING, number BIGINT, chunk BIGINT, data BINARY").write.parquet(f"{tmp_path}/chunks")
    found = metrics.diff_line_counts_by_chunk(spark.read.parquet(f"{tmp_path}/chunks"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1, plan
    assert [tuple(r[c] for c in COUNTS) for r in found.collect()] == [(1, 0, 1)]


def test_sample_diffs_keep_their_partitions(spark, tmp_path):
    spark.createDataFrame([(i, "a\nb\nc\nd" if i else None) for i in range(3)], "doc_id BIGINT, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(200).withColumnRenamed("id", "o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        diffs = pr_diffs(spark, str(tmp_path))
        assert diffs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
        found = {r.number: r.diff for r in diffs.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == 200 and (found[0], found[3], found[29]) == ("", "", "")
    assert found[1] == "+++ b/tests/app.test.ts\n+a\n+b\n-c\n+d"


def test_a_line_over_many_chunks_and_uneven_cuts(spark):
    text = "+é test " + "x" * 5000 + "README\n-password\n" + "+tokén auth" * 300 + "\n+漢字 secret\n\n"
    data, cuts = text.encode(), [0, 1, 3, 4, 900, 901, 5018, 5019, 5031, 9000, 9001]
    chunks = [("r/r", 1, k, bytearray(data[a:b])) for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(data)]))]
    rows = [*chunks, ("r/r", 2, 0, bytearray()), ("r/r", 3, 0, None), ("r/r", 4, 0, bytearray(b"\n")), ("r/r", 5, 7, bytearray(b"+te")), ("r/r", 5, 9, bytearray(b"st"))]
    df = spark.createDataFrame(rows, "repo STRING, number BIGINT, chunk BIGINT, data BINARY")
    found = {r.number: tuple(r[c] for c in COUNTS) for r in metrics.diff_line_counts_by_chunk(df).collect()}
    assert found == {1: expected(text), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0), 5: (1, 0, 0)}


def test_latest_copies_are_hash_aggregated(spark):
    layout = "repo STRING, number BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT, exported_at "
    diffs = spark.createDataFrame([("r/r", k, "+x") for k in range(4)], "repo STRING, number BIGINT, diff STRING")
    early, late = at("1960-01-01T00:00:00"), at("9999-12-31T00:00:00")
    rows = [("r/r", 0, 1, 0, 1, None), ("r/r", 0, 2, 0, 1, early), ("r/r", 1, 3, 0, 1, early), ("r/r", 1, 4, 0, 1, late), ("r/r", 2, 5, 0, 1, None)]
    for kind in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        given = [r if kind == "TIMESTAMP" or r[-1] is None else (*r[:-1], r[-1].replace(tzinfo=None)) for r in rows]
        result = metrics.pr_metrics(spark.createDataFrame(given, layout + kind), diffs)
        assert sorted((r.number, r.total_additions) for r in result.collect()) == [(0, 2), (1, 4), (2, 5)]
        assert "SortAggregate" not in result._jdf.queryExecution().executedPlan().toString()
