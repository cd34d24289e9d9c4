from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulltally.functions.moments import microseconds
from pulltally.operators import activity, ranking
from pulltally.operators.ranking import RANGE_ROWS, with_ranges
from tests.data import pull_requests

AS_OF = "2025-01-15"


def prs(spark):
    return pull_requests(spark, [
        (1, "MERGED", "2025-01-10T00:00:00", 1, 1, "dev", "org/a"),
        (2, "OPEN", "2024-11-01T00:00:00", 1, 1, "dev", "org/a"),
    ])


def test_report(spark):
    row = activity.activity_report(prs(spark), AS_OF).first()
    s = row.summary
    assert (s.total_prs, s.open_prs, s.closed_prs, s.merged_prs, s.merge_rate) == (2, 1, 0, 1, "50.0")
    assert tuple(s.last_30_days) == (1, 1, "100.0")
    assert tuple(s.last_90_days) == (2, 1, "50.0")
    assert [tuple(r) for r in row.repositories] == [("org/a", 2)]
    assert [tuple(m) for m in row.monthly_activity] == [("2025-01", 1), ("2024-11", 1)]
    assert [r.number for r in row.recent_prs] == [1, 2]
    assert row.generated_at == "2025-01-15T00:00:00.000Z"


def test_windows_leave_out_their_edge(spark):
    edge = pull_requests(spark, [
        (1, "OPEN", "2024-12-16T00:00:00", 1, 1), (2, "OPEN", "2024-12-16T00:00:01", 1, 1)])
    row = activity.activity_summary(edge, AS_OF).first()
    assert (row.total_30d, row.total_90d, row.merge_rate, row.merge_rate_30d) == (1, 2, "0.0", "0.0")


def test_empty_window_has_rate_zero(spark):
    old = pull_requests(spark, [(1, "MERGED", "2020-01-01T00:00:00", 1, 1)])
    row = activity.activity_summary(old, AS_OF).first()
    assert (row.merge_rate, row.merge_rate_30d, row.merge_rate_90d) == ("100.0", "0", "0")


def test_many_repositories_go_on_in_parts(spark):
    rows = [(i, "OPEN", f"2025-01-{1 + i % 9:02d}T00:00:00", 1, 1, "dev", f"org/r{i % 25:02d}") for i in range(60)]
    rows.append((99, "OPEN", "2025-01-01T00:00:00", 1, 1, "other", "org/x"))
    found = activity.activity_report(pull_requests(spark, rows), AS_OF, part_rows=10).orderBy("author", "part").collect()
    assert [(r.author, r.part, len(r.repositories), r.summary is None) for r in found] == [
        ("dev", 0, 10, False), ("dev", 1, 10, True), ("dev", 2, 5, True), ("other", 0, 1, False)]
    counts = [c[1] for r in found[:3] for c in r.repositories]
    assert counts == sorted(counts, reverse=True) and sum(counts) == 60
    assert len(found[0].recent_prs) == 30


def test_ties_by_latest_then_name(spark):
    rows = [(1, "OPEN", "2025-01-01T00:00:00", 1, 1, "d", "o/b"), (2, "OPEN", "2025-01-01T00:00:00", 1, 1, "d", "o/a"),
            (3, "OPEN", "2025-01-01T09:00:00", 1, 1, "d", "o/c")]
    found = activity.repo_counts(pull_requests(spark, rows)).orderBy("repo_rank").collect()
    assert [r.repo for r in found] == ["o/c", "o/a", "o/b"]
    top = activity.top_repositories(pull_requests(spark, rows), 2).orderBy("repo_rank").collect()
    assert [r.repo for r in top] == ["o/c", "o/a"]


def test_other_keys(spark):
    row = activity.activity_summary(prs(spark), AS_OF, keys=("repo",)).first()
    assert (row.repo, row.total_prs) == ("org/a", 2)
    assert activity.activity_report(prs(spark), AS_OF, keys=("repo",)).first().repo == "org/a"


def test_windows_do_not_split_the_scan(spark, tmp_path):
    prs(spark).write.parquet(str(tmp_path / "prs"))
    plan = activity.activity_summary(spark.read.parquet(str(tmp_path / "prs")), AS_OF)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "title" not in text


def one_day(spark, n):
    """An author with one pull request in each of n repositories, all on one day, and a few others."""
    many = spark.range(n).select(
        F.concat(F.lit("org/service-"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("repo"), F.lit(1).cast("bigint").alias("number"),
        F.lit("OPEN").alias("state"), F.lit("hot").alias("author"),
        F.timestamp_seconds(F.lit(1_735_700_000) + F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(7)).alias("created_at"))
    few = many.filter("repo < 'org/service-0000050'").withColumn("author", F.concat(F.lit("user"), F.substring("repo", -1, 1)))
    return many.union(few)


def test_one_day_with_very_many_repositories_falls_into_ranges(spark):
    counts = activity._repo_totals(one_day(spark, 300_000), ("author",))
    bucket = F.struct("pr_count", F.to_date("last_created_at").alias("day"))
    place = F.struct((-F.unix_micros("last_created_at")).alias("time"), "repo")
    found = with_ranges(counts, ["author"], bucket, place, "range").groupBy("author", "range").count().collect()
    sizes = [r["count"] for r in found if r["author"] == "hot"]
    assert len(sizes) >= 30 and sum(sizes) == 300_000 and max(sizes) < 3 * RANGE_ROWS
    assert {r["range"] for r in found if r["author"] != "hot"} == {0}


def test_ranks_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 50)
    for kind in ("timestamp", "timestamp_ntz"):
        prs = one_day(spark, 3000).withColumn("created_at", F.col("created_at").cast(kind))
        prs = prs.union(prs.limit(200).withColumns({"repo": F.concat(F.lit("no-time-"), "repo"), "created_at": F.lit(None).cast(kind)}))
        found = activity.repo_counts(prs)
        order = Window.partitionBy("author").orderBy(*activity._busiest_first())
        assert found.count() == 3000 + 50 + 200
        assert found.withColumn("plain", F.row_number().over(order)).filter("plain != repo_rank").count() == 0
        first = activity.top_repositories(prs, 1500).filter("author = 'hot'")
        assert first.count() == 1500 and first.agg(F.max("repo_rank")).first()[0] == 1500


def test_microseconds_follow_the_time(spark):
    rows = spark.sql("SELECT timestamp'1969-12-31 23:59:59.25Z' AS a, timestamp_ntz'2024-03-31 02:30:01.5' AS b")
    times = [microseconds(F.col(c), rows.schema[c].dataType) for c in "ab"]
    assert tuple(rows.select(*times).first()) == (-750_000, 1_711_852_201_500_000)
