"""Sources, sinks and the whole plan, over files."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

import pulltally
from pulltally.functions.strict_json import with_object
from pulltally.operators.activity import activity_report, first_parts
from pulltally.operators.insights import parse_responses
from pulltally.operators.languages import extensions_of, language_filter
from pulltally.operators.metrics import diff_line_counts, diff_line_counts_by_chunk, diff_line_counts_by_line, pr_metrics, with_details
from pulltally.plans.assessment import AssessmentConfig, assess, finish, save
from pulltally.session import discard, materialize, run_folder, shared_folder
from pulltally.sinks import writers
from pulltally.sources import exports
from pulltally.sources.records import stored_texts
from pulltally.sources.reports import activity_reports, read_activity_reports
from pulltally.sources.stored import add_to_stored, store_by_key, stored_by_key
from tests.data import DIFF, DIFF_COUNTS, at, pull_requests

OPEN_ITEM = {
    "number": 41, "state": "open", "title": "Sort orders", "body": None, "created_at": "2025-01-01T00:00:00Z",
    "closed_at": None, "repository_url": "https://api.github.com/repos/acme/shop", "user": {"login": "mira"},
    "labels": ["a", {"name": "bug"}, {"id": 1}], "html_url": "https://github.com/acme/shop/pull/41"}
MERGED_ITEM = {
    **OPEN_ITEM, "number": 42, "state": "closed", "body": "Text", "closed_at": "2025-01-02T00:00:00Z",
    "pull_request": {"merged_at": "2025-01-02T00:00:00Z"}, "user": None, "labels": []}


def lines(path, *records):
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n", encoding="utf-8")
    return str(path)


def test_api_items(spark, tmp_path):
    path = lines(tmp_path / "items.json", OPEN_ITEM, MERGED_ITEM)
    first, second = exports.read_api_search(spark, path).rows.orderBy("number").collect()
    assert (first.repo, first.state, first.body, first.author) == ("acme/shop", "OPEN", "", "mira")
    assert [x["name"] for x in first.labels] == ["a", "bug", ""]
    assert (second.state, second.author, second.merged_at) == ("MERGED", "unknown", second.closed_at)
    raw = spark.read.schema(pulltally.schema.RAW_API_ITEM).json(path)
    assert [r.number for r in exports.pull_requests_only(raw).collect()] == [42]


def test_api_pages(spark, tmp_path):
    path = lines(tmp_path / "pages.json", {"items": [OPEN_ITEM]}, {"items": [MERGED_ITEM, OPEN_ITEM]})
    assert exports.read_api_search(spark, path, pages=True).rows.count() == 3


def test_cli_records(spark, tmp_path):
    record = {"repository": {"nameWithOwner": "t/r"}, "number": 1, "state": "closed", "title": "x", "body": "",
              "createdAt": "2025-01-02T00:00:00Z", "closedAt": None, "author": {"login": "u"},
              "labels": [{"name": "n"}], "url": "u"}
    path = lines(tmp_path / "prs.json", record, {**record, "number": 2}, {**record, "number": 3})
    merged = {"repo": "t/r", "number": 1, "state": "MERGED", "mergedAt": "2025-01-03T00:00:00Z"}
    status = lines(tmp_path / "status.json", merged, merged, {"repo": "t/r", "number": 2, "mergedAt": ""})
    rows = exports.read_cli_search(spark, path, status).rows.orderBy("number").collect()
    assert [(r.number, r.state, r.merged_at is None) for r in rows] == [
        (1, "MERGED", False), (2, "CLOSED", True), (3, "CLOSED", True)]


def test_details(spark, tmp_path):
    api = {"html_url": "https://github.com/acme/shop/pull/57", "body": None, "created_at": "2025-01-03T00:00:00Z",
           "additions": 31, "deletions": 7, "changed_files": 4, "user": {"login": "mira"}, "assignees": [],
           "labels": [], "head": {"ref": "sorting"}, "base": {"ref": "main"}, "draft": False}
    row = exports.read_details(spark, lines(tmp_path / "api.json", api)).rows.first()
    assert (row.repo, row.number, row.additions, row.deletions, row.changed_files) == ("acme/shop", 57, 31, 7, 4)
    assert (row.head_ref_name, row.base_ref_name, row.is_draft, row.body) == ("sorting", "main", False, "")
    cli = {"url": api["html_url"], "body": "b", "createdAt": "2025-01-03T00:00:00Z", "additions": 1, "deletions": 2,
           "changedFiles": 3, "author": {"login": "u"}, "headRefName": "h", "baseRefName": "m", "isDraft": True}
    row = exports.read_details(spark, lines(tmp_path / "cli.json", cli), shape="cli").rows.first()
    assert (row.number, row.changed_files, row.author, row.is_draft) == (57, 3, "u", True)


def diff_files(folder):
    for name, text in {"acme/shop/1": DIFF, "acme/re po+x/22": "+auth\r+x\n-y", "acme/shop/3": ""}.items():
        path = folder / f"{name}.diff"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return str(folder)


def test_diffs(spark, tmp_path):
    path = diff_files(tmp_path)
    whole = {(r.repo, r.number): r.diff for r in exports.read_diffs(spark, path).collect()}
    assert whole == {("acme/shop", 1): DIFF, ("acme/re po+x", 22): "+auth\r+x\n-y", ("acme/shop", 3): ""}
    by_line = exports.read_diff_lines(spark, path).filter("number = 22").collect()
    assert sorted(r.line for r in by_line) == ["+auth\r+x", "-y"]
    counts = [sorted(map(tuple, f(d).collect())) for f, d in (
        (diff_line_counts, exports.read_diffs(spark, path)), (diff_line_counts_by_line, exports.read_diff_lines(spark, path)))]
    assert counts[0] == counts[1] and ("acme/shop", 3, 0, 0, 0) in counts[0] and ("acme/shop", 1, *DIFF_COUNTS) in counts[0]


def test_diff_records(spark, tmp_path):
    records = [{"repo": "a/b", "number": 1, "diff": DIFF}, {"repo": "a/b", "number": 2, "diff": ""}, {"repo": "a/b", "number": 3}]
    rows, rejected = exports.read_diff_records(spark, lines(tmp_path / "diffs.json", *records))
    assert {(r.number, r.diff) for r in rows.collect()} == {(1, DIFF), (2, "")}
    assert [r.reason for r in rejected.collect()] == ["no diff"]
    stored = str(tmp_path / "diffs.parquet")
    spark.createDataFrame([("a/b", 1, DIFF), ("a/b", 2, ""), (None, 3, "x")], "repo STRING, number BIGINT, diff STRING").write.parquet(stored)
    rows, rejected = exports.read_diff_records(spark, stored, "parquet")
    assert {(r.number, r.diff) for r in rows.collect()} == {(1, DIFF), (2, "")}
    assert [r.reason for r in rejected.collect()] == ["no repository"]


def test_rejected_records(spark, tmp_path):
    path = lines(tmp_path / "items.json", OPEN_ITEM, {**MERGED_ITEM, "repository_url": None}, {**MERGED_ITEM, "number": None})
    with open(path, "a", encoding="utf-8") as file:
        file.write(json.dumps(OPEN_ITEM)[:-5] + "\n\n   \n" + json.dumps(OPEN_ITEM) + " more\n[]\nnull\n")
    rows, rejected = exports.read_api_search(spark, path)
    assert [r.author for r in rows.collect()] == ["mira"]
    assert sorted(r.reason for r in rejected.collect()) == ["no number", "no repository", *["not JSON"] * 4]
    assert {r.file.rsplit("/", 1)[1] for r in rejected.collect()} == {"items.json"}
    details = exports.read_details(spark, lines(tmp_path / "d.json", {"html_url": "https://x/none", "additions": 1}))
    assert details.rows.count() == 0 and details.rejected.first().reason == "no repository, number"
    files = exports.read_files(spark, lines(tmp_path / "f.json", {"repo": "a/b", "number": 1}))
    assert files.rows.count() == 0 and files.rejected.first().reason == "no files"
    cli = exports.read_cli_search(spark, lines(tmp_path / "c.json", {"number": 1}), lines(tmp_path / "s.json", {"repo": "a/b"}))
    assert cli.rows.count() == 0 and sorted(r.reason for r in cli.rejected.collect()) == ["no number", "no repository"]


def test_indented_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"items": [OPEN_ITEM, MERGED_ITEM, {"number": 7}]}, indent=2))
    (tmp_path / "b.json").write_text(json.dumps({"items": []}, indent=2))
    (tmp_path / "c.json").write_text(json.dumps({"message": "limit"}, indent=2))
    rows, rejected = exports.read_api_search(spark, str(tmp_path), multi_line=True)
    assert sorted(r.number for r in rows.collect()) == [41, 42]
    assert sorted((r.file[-6:], r.reason) for r in rejected.collect()) == [("a.json", "no repository"), ("c.json", "no items")]


def pages(folder):
    """Indented pages, good and broken, and compact ones."""
    odd = {**OPEN_ITEM, "number": 50, "title": 'a "{x}\n    },\n    {" b', "body": "line\u2028end \\", "labels": [{"name": "q", "more": {"k": [1, {"z": []}]}}]}
    docs = {
        "many": {"total_count": 9, "items": [{**OPEN_ITEM, "number": k} for k in range(100, 400)], "incomplete_results": False},
        "odd": {"errors": [{"items": [{"number": 1}]}, {"number": 2}], "items": [odd, {}, MERGED_ITEM, None, {"number": 7}], "items_more": [{"number": 3}]},
        **{f"mixed{k}": {"items": [OPEN_ITEM, other]} for k, other in enumerate((5, [1, [2]], "x", True, [OPEN_ITEM]))},
        "none": {"items": []}, "null": {"items": None}, "other": {"message": "limit"}, "nested": {"data": {"items": [OPEN_ITEM]}}, "list": [OPEN_ITEM],
    }
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(json.dumps(doc, indent=2))
        (folder / f"{name}-compact.json").write_text(json.dumps(doc))
        (folder / f"{name}-wide.json").write_text(json.dumps(doc, indent=4))
    whole = json.dumps(docs["many"], indent=2)
    (folder / "cut.json").write_text(whole[:len(whole) // 2])
    (folder / "comma.json").write_text(whole.replace("    },", "    }", 1))
    (folder / "commas.json").write_text(whole.replace("    }\n  ]", "    },\n  ]"))
    (folder / "word.json").write_text(whole.replace('"number": 150', '"number": oops'))
    (folder / "after.json").write_text(whole + "\n{}")
    (folder / "blank.json").write_text(" \n\n")
    (folder / "crlf.json").write_text(whole.replace("\n", "\r\n"))


def test_pages_by_lines_equal_whole_pages(spark, tmp_path):
    pages(tmp_path)
    whole = exports.api_search(stored_texts(spark, str(tmp_path), multi_line=True), "items")
    for block in ("128m", "3000b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = exports.read_api_search(spark, str(tmp_path), multi_line=True, run=str(tmp_path / "runs"))
        assert sorted(found.rows.collect(), key=str) == sorted(whole.rows.collect(), key=str)
        assert sorted((r.file, r.reason) for r in found.rejected.collect()) == sorted((r.file, r.reason) for r in whole.rejected.collect())
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def test_parsed_once(spark, tmp_path):
    path = lines(tmp_path / "items.json", OPEN_ITEM, MERGED_ITEM, {"number": 9})
    found = exports.read_api_search(spark, path, run=str(tmp_path / "run"))
    (tmp_path / "items.json").unlink()
    assert found.rows.count() == 2 and [r.reason for r in found.rejected.collect()] == ["no repository"]


def test_filters_do_not_repeat_the_parser(spark):
    texts = spark.range(4).select(F.lit("f").alias("file"), F.concat(F.lit('{"repo": "r/r", "diff": "+a", "number": '), "id", F.lit("}")).alias("text"))
    answers = spark.range(4).select(F.col("id").cast("string").alias("author"), F.concat(F.lit('{"insights": ["'), "id", F.lit('"]}')).alias("content"))
    results = [*exports.diff_records(texts), *exports.api_search(texts), *activity_reports(texts)]
    results += [parse_responses(answers).filter("problem is null"), parse_responses(answers).filter("problem is not null")]
    for result in results:
        plan = result._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, plan
    assert [r.number for r in exports.diff_records(texts).rows.orderBy("number").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("text, kept", [
    (' \t\n\r{"a": 1}', True), ('{"a": 1} \n', True), ("{}", True), ('\u00a0{"a": 1}', False), ('{"a": 1}, {"a": 2}', False),
    ('{"a": 1} x', False), ("[]", False), ("", False), (None, False)])
def test_only_one_object_is_an_object(spark, text, kept):
    found = with_object(spark.createDataFrame([(text,)], "text STRING"), "object", F.col("text"), "a: INT").collect()
    assert [r.text for r in found] == [text] and (found[0].object is not None) == kept


def test_indented_report(spark, tmp_path):
    report = activity_report(pull_requests(spark, [(1, "MERGED", "2025-01-10T00:00:00", 1, 1, "a b", "o/x")]), "2025-01-15")
    document = writers.report_document(report).select(F.to_json(F.struct("*")).alias("j")).first().j
    (tmp_path / "r.json").write_text(json.dumps(json.loads(document), indent=2))
    assert read_activity_reports(spark, str(tmp_path), multi_line=True).rows.collect() == report.collect()
    assert read_activity_reports(spark, str(tmp_path)).rejected.count() > 1


@pytest.mark.parametrize("layout", [writers.BY_DATE, writers.PER_USER])
def test_reports_by_repository_are_stored(spark, tmp_path, layout):
    prs = pull_requests(spark, [(k, "MERGED", "2025-01-10T00:00:00", 1, 1, f"a{k}", f"o/x {k % 3}") for k in range(9)])
    report = activity_report(prs, "2025-01-15", keys=("repo",))
    writers.write_activity_reports(report, str(tmp_path / "r"), "2025-01-15", layout, key="repo")
    found = read_activity_reports(spark, str(tmp_path / "r"), key="repo").rows
    assert found.columns == report.columns and sorted(map(str, found.collect())) == sorted(map(str, report.collect()))
    texts = spark.createDataFrame([("o/x", "# Text", "Letter")], "repo STRING, assessment STRING, coaching STRING")
    writers.write_assessments(texts, str(tmp_path / "a"), "2025-01-15", layout, key="repo")
    writers.write_coaching(texts, str(tmp_path / "c"), "2025-01-15", layout, key="repo")
    assert writers.assessment_records(texts, "2025-01-15", "repo").first()["user"] == "o/x"


@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_another_session_zone(spark, zone):
    prs = pull_requests(spark, [(1, "MERGED", "2025-01-01T00:30:00", 1, 1, "a", "o/x"), (2, "OPEN", "2024-12-31T23:30:00", 1, 1, "a", "o/x")])
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        report = activity_report(prs, "2025-01-15")
        assert [(m.month, m["count"]) for m in report.first().monthly_activity] == [("2025-01", 1), ("2024-12", 1)]
        stored = writers.report_document(report).first().recentPRs
        assert [p.createdAt for p in stored] == ["2025-01-01T00:30:00Z", "2024-12-31T23:30:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_groups_are_needed(spark):
    with pytest.raises(ValueError, match="groups"):
        activity_report(pull_requests(spark, []), keys=())


def test_many_small_diffs_with_a_manifest(spark, tmp_path, monkeypatch):
    """The driver looks for nothing: folders are listed by Spark's own jobs, empty files come from the manifest."""
    listed = []
    for k in range(10_000):
        folder = tmp_path / "diffs" / f"owner{k % 50}" / "a b"
        folder.mkdir(parents=True, exist_ok=True)
        text = "" if k % 100 == 7 else "+test\n"
        (folder / f"{k}.diff").write_text(text)
        listed.append((f"{folder}/{k}.diff".replace(" ", "%20"), len(text)))
    (folder / "notes.diff").write_text("+test")
    listed += [(f"{folder}/notes.diff", 5), (f"{folder}/99999.diff", 3)]
    manifest = spark.createDataFrame(listed, pulltally.schema.DIFF_MANIFEST)
    monkeypatch.setattr(exports, "_empty_files", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    found = exports.read_diffs(spark, str(tmp_path / "diffs"), manifest)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) > jobs
    counts = {tuple(r) for r in diff_line_counts(found).select("repo", "number", "test_additions").collect()}
    assert counts == {(f"owner{k % 50}/a b", k, int(k % 100 != 7)) for k in range(10_000)}
    assert sorted(r.path[-10:] for r in exports.missing_diffs(manifest, found).collect()) == ["99999.diff", "notes.diff"]


def test_stored_chunks(spark, tmp_path):
    diffs = spark.createDataFrame([("o/r", 1, DIFF), ("o/r", 2, ""), ("o/r", 3, None)], pulltally.schema.PR_DIFFS)
    exports.diff_chunks(diffs, 10).write.parquet(str(tmp_path / "chunks"))
    rows, rejected = exports.read_diff_chunks(spark, str(tmp_path / "chunks"))
    counts = {r.number: (r.test_additions, r.doc_additions, r.security_pattern_matches) for r in diff_line_counts_by_chunk(rows).collect()}
    assert counts == {1: DIFF_COUNTS, 2: (0, 0, 0)} and rejected.count() == 0
    records = exports.diff_chunks(diffs, 10).withColumn("data", F.base64("data")).select(F.to_json(F.struct("*")).alias("value"))
    bad = spark.createDataFrame([('{"repo": "o/r", "number": 1, "chunk": 4, "data": "?"}',), ('{"repo": "o/r", "number": 1, "data": ""}',), ("{",)], "value STRING")
    records.union(bad).write.text(str(tmp_path / "json"))
    again, rejected = exports.read_diff_chunks(spark, str(tmp_path / "json"), form="json")
    assert sorted(again.collect()) == sorted(rows.collect())
    assert sorted(r.reason for r in rejected.collect()) == ["no chunk", "no data", "not JSON"]


def test_file_lists(spark, tmp_path):
    cli = {"repo": "t/r", "number": 1, "files": [{"path": "a/b.TS", "additions": 1, "deletions": 0, "changeType": "ADDED"}]}
    api = {"repo": "t/r", "number": 2, "files": [{"filename": "c.go", "additions": 2, "deletions": 3, "status": "modified"}]}
    files = exports.read_files(spark, lines(tmp_path / "files.json", cli, api)).rows
    assert [tuple(r) for r in files.orderBy("number").collect()] == [
        ("t/r", 1, "a/b.TS", 1, 0, "ADDED"), ("t/r", 2, "c.go", 2, 3, "modified")]
    prs = pull_requests(spark, [(n, "OPEN", "2025-01-01T00:00:00", 1, 1, "d", "t/r") for n in (1, 2, 3)])
    assert [r.number for r in language_filter(prs, files, "TypeScript").collect()] == [1]
    assert language_filter(prs, files, None).count() == 3
    assert extensions_of("go, Zig") == ["go", "zig"]


def test_reports_round_trip(spark, tmp_path):
    prs = pull_requests(spark, [
        (1, "MERGED", "2025-01-10T00:00:00", 1, 1, "a", "o/x"), (2, "OPEN", "2025-01-09T00:00:00", 1, 1, "a", "o/y"),
        (3, "OPEN", "2025-01-09T00:00:00", 1, 1, "b", "o/y")])
    report = activity_report(prs, "2025-01-15", part_rows=1)
    for layout in (writers.BY_DATE, writers.PER_USER):
        path = str(tmp_path / layout)
        writers.write_activity_reports(report, path, "2025-01-15", layout)
        writers.write_activity_reports(report.filter("author = 'a'"), path, "2025-01-16", layout)
        back = read_activity_reports(spark, path, "2025-01-15").rows.orderBy("author", "part").collect()
        assert back == report.orderBy("author", "part").collect()
        assert read_activity_reports(spark, path).rows.count() == 5
    stored = next(f for f in (tmp_path / "per_user" / "user=b" / "date=2025-01-15").iterdir() if f.suffix == ".json")
    document = json.loads(stored.read_text())
    assert document["summary"]["last30Days"] == {"totalPRs": 1, "mergedPRs": 0, "mergeRate": "0.0"}
    assert document["recentPRs"][0]["createdAt"] == "2025-01-09T00:00:00Z"
    (tmp_path / "by_date" / "date=2025-01-15" / "bad.json").write_text("{broken\n")
    rows, rejected = read_activity_reports(spark, str(tmp_path / "by_date"), "2025-01-15")
    assert rows.count() == 3
    assert [(r.file.rsplit("/", 1)[1], r.text, r.reason) for r in rejected.collect()] == [("bad.json", "{broken", "not JSON")]


def test_missing_assessment_is_an_error(spark, tmp_path):
    texts = spark.createDataFrame([("a", None)], "author STRING, assessment STRING")
    with pytest.raises(Exception, match="no assessment for a"):
        writers.write_assessments(texts, str(tmp_path / "out"))


def test_materialize(spark):
    run = run_folder(spark)
    df = materialize(spark.range(3), "three", run)
    assert df.count() == 3
    assert shared_folder(spark) in df.inputFiles()[0]
    discard(spark, run)
    assert not os.path.exists(run)


class Unset:
    """A session without the setting, perhaps with a checkpoint folder of its own."""

    def __init__(self, own=None):
        self.sparkContext = self.conf = self._jsc = self
        self.own = own

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.own is not None

    def get(self, *_):
        return self.own


def test_shared_folder_where_none_is_set():
    assert shared_folder(Unset(), "mine") == "mine"
    assert shared_folder(Unset("s3://own")) == "s3://own"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Unset())


@pytest.fixture(scope="module")
def tables(spark):
    prs = spark.createDataFrame(
        [("t/r", n, s, f"PR {n}", at(f"2025-01-{n:02d}T00:00:00"), a) for n, s, a in [
            (1, "MERGED", "ann"), (2, "OPEN", "ann"), (3, "OPEN", "ann"), (4, "CLOSED", "bob")]],
        "repo STRING, number BIGINT, state STRING, title STRING, created_at TIMESTAMP, author STRING")
    details = spark.createDataFrame(
        [("t/r", n, size, 0, 1) for n, size in [(1, 2000), (2, 5), (3, 10)]],
        "repo STRING, number BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT")
    diffs = spark.createDataFrame([("t/r", 1, DIFF), ("t/r", 2, "+token"), ("t/r", 4, "+x")],
                                  "repo STRING, number BIGINT, diff STRING")
    return prs, details, diffs


def config(out, **changes):
    return AssessmentConfig(review_focus="all", output_dir=str(out), **changes)


def test_whole_plan(spark, tables, tmp_path):
    first = assess(*tables, config(tmp_path), as_of="2025-01-20T10:20:30")
    rows = {r.author: r for r in first.analysis.collect()}
    assert (rows["ann"].total_prs_analyzed, rows["bob"].total_prs_analyzed) == (3, 1)
    assert rows["ann"].metrics.total_test_additions == DIFF_COUNTS[0]
    assert {r.author for r in first.insight_prompts.collect()} == {"ann", "bob"}

    answers = spark.createDataFrame(
        [("ann", '{"insights": ["more"], "recommendations": ["tidy"]}'), ("bob", "?")], "author STRING, content STRING")
    done = finish(first, answers)
    assert [r.problem for r in done.rejected.collect()] == ["not JSON"]
    assert "Developer: ann" in done.coaching_prompts.first().prompt
    advice = spark.createDataFrame([("ann", "Dear Ann"), ("bob", None)], "author STRING, advice STRING")
    save(done, advice, layout=writers.PER_USER)

    run = "date=2025-01-20/run=analysis-2025-01-20T10-20-30"
    text = "".join(f.read_text() for f in (tmp_path / "assessments/user=ann" / run).glob("*.txt"))
    assert "**User:** ann" in text and "- more" in text and ". tidy" in text
    assert os.listdir(tmp_path / "assessments") and not (tmp_path / "assessments/user=bob").exists()
    assert len(list((tmp_path / "coaching").glob("user=*"))) == 1
    bundle = json.loads(next((tmp_path / "bundles/user=ann" / run).glob("*.json")).read_text())
    assert bundle["config"]["prSelection"] == "last 10" and bundle["config"]["username"] is None
    assert [p["number"] for p in bundle["selectedPRs"]] == [3, 2, 1]
    assert bundle["selectedPRs"][1]["additions"] == 5 and bundle["selectedPRs"][0]["additions"] is None
    assert sorted(bundle["metrics"]) == ["t/r#1", "t/r#2"]
    assert bundle["metrics"]["t/r#1"]["testAdditions"] == DIFF_COUNTS[0]
    assert bundle["report"]["findings"][-1] == "more" and bundle["report"]["totalPRsAnalyzed"] == 3


def test_plan_by_date(spark, tables, tmp_path):
    done = finish(
        assess(*tables, config(tmp_path, pr_selection="largest 1", username="ann", repo_filter="t/r"), "2025-01-20"),
        spark.createDataFrame([("ann", '{"insights": [], "recommendations": []}')], "author STRING, content STRING"))
    save(done, files=2)
    rows = spark.read.json(str(tmp_path / "bundles")).collect()
    assert [(r.user, [p.number for p in r.selectedPRs]) for r in rows] == [("ann", [1])]
    stored = spark.read.json(str(tmp_path / "assessments")).first()
    assert stored.user == "ann" and "2000" in stored.assessment


def test_nothing_selected_still_reports(spark, tables, tmp_path):
    found = assess(*tables, config(tmp_path, pr_selection="last-week", repo_filter="other/repo"), "2025-01-20")
    assert sorted((r.author, r.total_prs_analyzed) for r in found.analysis.collect()) == [("ann", 0), ("bob", 0)]
    answers = found.analysis.select("author", F.lit('{"insights": [], "recommendations": []}').alias("content"))
    bundles = finish(found, answers).bundles.collect()
    assert [(len(b.selected_prs), len(b.metrics), b.report is None) for b in bundles] == [(0, 0, False)] * 2


def test_language_needs_files(tables, tmp_path):
    with pytest.raises(ValueError):
        assess(*tables, config(tmp_path, language_filter="go"), "2025-01-20")


def test_quick_config():
    quick = AssessmentConfig.quick("u")
    assert (quick.pr_selection, quick.username, quick.repo_filter) == ("last 10", "u", None)


@pytest.mark.parametrize("criteria", ["last 1", "largest 1"])
def test_size_without_a_diff_is_none_for_any_selection(spark, tables, criteria):
    """Details alone measure nothing: the size rule stays quiet however the pull request was chosen."""
    prs, details, diffs = tables
    only = prs.filter("number = 1")
    found = assess(only, details, diffs.filter("number > 1"), AssessmentConfig(pr_selection=criteria), "2025-01-20").analysis.first()
    assert found.metrics.average_pr_size == 0.0 and not any("large" in f.lower() for f in found.findings)


def test_repeated_answers_give_one_report(spark, tables, tmp_path):
    answer = '{"insights": ["x"], "recommendations": []}'
    answers = spark.createDataFrame([("ann", answer)] * 3 + [("bob", answer), ("bob", "other")], "author STRING, content STRING")
    done = finish(assess(*tables, config(tmp_path), as_of="2025-01-20"), answers)
    assert [r.author for r in done.analysis.collect()] == ["ann"]
    assert done.assessments.count() == 1
    assert sorted((r.author, r.report is None) for r in done.bundles.collect()) == [("ann", False), ("bob", True)]
    assert [(r.author, r.problem) for r in done.rejected.collect()] == [("bob", "several responses")]


def test_joins_over_an_author_in_parts(spark):
    prs = pull_requests(spark, [(n, "OPEN", "2025-01-01T00:00:00", 1, 1, "a", f"o/{n}") for n in range(5)])
    report = activity_report(prs, "2025-01-15", part_rows=2)
    assert [r.part for r in report.orderBy("part").collect()] == [0, 1, 2]
    assert first_parts(report).join(prs.select("author").distinct(), "author").count() == 1


def test_buckets_meet_without_a_shuffle(spark, tmp_path):
    layout = "repo STRING, number BIGINT, additions BIGINT, deletions BIGINT, changed_files BIGINT"
    prs = pull_requests(spark, [(k, "OPEN", "2025-01-01T00:00:00", 1, 1, "a", f"o/r{k % 7}") for k in range(200)])
    tables = {
        "prs": prs.drop("additions", "deletions"),
        "details": spark.createDataFrame([(f"o/r{k % 7}", k, k, 2, 1) for k in range(0, 200, 2)], layout),
        "status": spark.createDataFrame([(f"o/r{k % 7}", k, "MERGED", "2025-01-02T00:00:00Z") for k in range(0, 200, 3)], pulltally.schema.RAW_MERGE_STATUS),
        "diffs": spark.createDataFrame([(f"o/r{k % 7}", k, "+test") for k in range(200)], pulltally.schema.PR_DIFFS),
        "files": spark.createDataFrame([(f"o/r{k % 7}", k, "a.py" if k % 5 else "a.ts", 1, 1, "added") for k in range(200)], pulltally.schema.PR_FILES),
    }
    for name, df in tables.items():
        store_by_key(df, f"kept_{name}", 4, str(tmp_path / name))
    kept = {name: stored_by_key(spark, f"kept_{name}") for name in tables}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for make in (
            lambda t: exports.with_merge_status(t["prs"], t["status"]),
            lambda t: with_details(t["prs"], t["details"]),
            lambda t: pr_metrics(t["details"], t["diffs"]),
            lambda t: pr_metrics(t["details"], t["diffs"], t["prs"]),
            lambda t: language_filter(t["prs"], t["files"], "Python"),
        ):
            found, plain = make(kept), make(tables)
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect())) and found.count()
            assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        more = spark.createDataFrame([("o/r0", 0, 500, 2, 1), ("o/r9", 9, 9, 9, 9)], layout)
        add_to_stored(spark, more, "kept_details", "more_details", 4, str(tmp_path / "more"))
        sizes = {(r.repo, r.number): r.additions for r in stored_by_key(spark, "more_details").collect()}
        assert len(sizes) == 101 and sizes["o/r0", 0] == 500 and sizes["o/r9", 9] == 9
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in (*(f"kept_{name}" for name in tables), "more_details"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
