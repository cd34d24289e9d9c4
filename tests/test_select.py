from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulltally.operators import ranking
from pulltally.operators.activity import newest_first, newest_levels
from pulltally.operators.select import _largest_levels, largest_first, parse_criteria, search, select_prs
from tests.data import pull_requests, three

AS_OF = "2025-01-16T10:00:00"


def numbers(df):
    if "selection_rank" in df.columns:
        df = df.orderBy("author", "selection_rank")
    else:
        df = df.orderBy(*newest_first())
    return [row.number for row in df.collect()]


@pytest.mark.parametrize("criteria, expected", [
    ("last 2", [1, 2]),
    ("largest 2", [2, 1]),
    ("open", [1]),
    ("unknown", [1, 2, 3]),
    ("unreviewed", [1]),
    ("last -1", [1, 2]),
    ("last -5", []),
    ("largest -2", [2]),
    ("last-week", [1, 2, 3]),
    ("last 5000", [1, 2, 3]),
])
def test_selection(spark, criteria, expected):
    assert numbers(select_prs(three(spark), criteria, AS_OF)) == expected


@pytest.mark.parametrize("criteria, kind, count", [
    ("last 10", "last", 10), ("last 10abc", "last", 10), ("last 0", "last", 5), ("last  7", "last", 5),
    ("last \t7", "last", 7), ("last x", "last", 5), ("last -3", "last", -3), ("last 0x10", "last", 16),
    ("largest 4", "largest", 4), ("largest", "last", 5), ("LAST 3", "last", 5), ("custom", "last", 5),
    ("unreviewed", "unreviewed", 10), ("open", "open", None), ("last-90-days", "last-90-days", None),
])
def test_criteria(criteria, kind, count):
    parsed = parse_criteria(criteria)
    assert (parsed.kind, parsed.count) == (kind, count)


def test_window_includes_its_edge(spark):
    prs = pull_requests(spark, [
        (1, "OPEN", "2025-01-09T10:00:00", 1, 1), (2, "OPEN", "2025-01-09T09:59:59", 1, 1)])
    assert numbers(select_prs(prs, "last-week", AS_OF)) == [1]


def test_unreadable_times_come_last_and_stay(spark):
    prs = pull_requests(spark, [(n, "OPEN", "2025-01-09T10:00:00", 1, 1) for n in (1, 2, 3)])
    broken = prs.withColumn("created_at", F.when(F.col("number") != 2, F.col("created_at")))
    assert numbers(select_prs(broken, "last 3", AS_OF)) == [1, 3, 2]
    assert numbers(select_prs(broken, "last 3000", AS_OF)) == [1, 3, 2]
    assert numbers(select_prs(broken, "last -1", AS_OF)) == [1, 3]


def test_no_size_no_candidate(spark):
    prs = pull_requests(spark, [
        (1, "OPEN", "2025-01-09T10:00:00", None, 900), (2, "OPEN", "2025-01-09T10:00:00", 5, None),
        (3, "OPEN", "2025-01-09T10:00:00", 5, 0)])
    assert numbers(select_prs(prs, "largest 9", AS_OF)) == [2, 3]


def test_search(spark):
    prs = pull_requests(spark, [
        (1, "OPEN", "2025-01-01T00:00:00", 1, 1, "a", "x/y"), (2, "OPEN", "2025-01-02T00:00:00", 1, 1, "a", "x/z"),
        (3, "OPEN", "2025-01-03T00:00:00", 1, 1, "b", "x/y")])
    assert numbers(search(prs, "a")) == [2, 1]
    assert numbers(search(prs, "a", "x/y")) == [1]
    assert [r.number for r in search(prs, limit=2).collect()] == [3, 2]


@pytest.fixture(scope="module")
def hot(spark):
    """One author with most of the rows, many ties, and some small authors."""
    random.seed(3)
    rows = []
    for number in range(3000):
        author = "bot" if number % 3 else f"dev{number % 7}"
        created = f"2025-01-{random.randint(1, 9):02d}T{random.randint(0, 1):02d}:00:0{random.randint(0, 3)}"
        rows.append((number, "OPEN", created, random.choice([1, 1, 2, 70]), 1, author, f"r/{random.randint(0, 5)}"))
    return pull_requests(spark, rows).cache()


def plain(df, order):
    window = Window.partitionBy("author")
    return df.withColumn("selection_rank", F.row_number().over(window.orderBy(*order))).withColumn(
        "n", F.count(F.lit(1)).over(window))


def pairs(df):
    return sorted((r.author, r.number, r.selection_rank) for r in df.select("author", "number", "selection_rank").collect())


@pytest.mark.parametrize("criteria, order, keep", [
    ("last 1500", newest_first, "selection_rank <= 1500"),
    ("last -10", newest_first, "selection_rank <= n - 10"),
    ("last 7", newest_first, "selection_rank <= 7"),
    ("largest 1200", largest_first, "selection_rank <= 1200"),
    ("largest -300", largest_first, "selection_rank <= n - 300"),
])
def test_hot_author_like_a_plain_window(hot, criteria, order, keep):
    assert pairs(select_prs(hot, criteria, AS_OF)) == pairs(plain(hot, order()).filter(keep))


def test_parts_hold_everything_in_order(hot):
    ranked = ranking.ranked(hot, ["author"], newest_first(), newest_levels(), "rank")
    parts = ranking.gather_parts(ranked, ["author"], "rank", F.col("number"), "numbers", part_rows=64)
    longest = parts.select(F.max(F.size("numbers"))).first()[0]
    assert longest == 64
    joined = {}
    for row in parts.orderBy("author", "part").collect():
        joined.setdefault(row.author, []).extend(row.numbers)
    expected = {}
    for row in hot.orderBy("author", *newest_first()).collect():
        expected.setdefault(row.author, []).append(row.number)
    assert joined == expected


def test_small_n_is_cut_before_the_shuffle(hot):
    plan = select_prs(hot, "last 10", AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_hot_groups_are_never_one_window(hot):
    """Rows are numbered within buckets only, never over a whole author."""
    plan = select_prs(hot, "last -10", AS_OF)._jdf.queryExecution().optimizedPlan().toString()
    row_numbers = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert row_numbers and all("_b0" in line for line in row_numbers)


def test_equal_rows_of_one_author_fall_into_many_buckets(spark):
    """A robot's changes have one size, one repository and one hour, or no time at all."""
    number = F.col("id") + 1
    robot = spark.range(200_000).select(
        F.lit("robot").alias("author"), F.lit("o/mono").alias("repo"), number.alias("number"), F.lit(None).cast("timestamp").alias("created_at"),
        F.lit(1).cast("bigint").alias("additions"), F.lit(1).cast("bigint").alias("deletions"))
    for levels in (newest_levels(), _largest_levels()):
        assert ranking.bucket_offsets(robot, ["author"], levels).count() >= 20
    chosen = select_prs(robot, "last -199990")
    assert sorted((r.number, r.selection_rank) for r in chosen.collect()) == [(n, n) for n in range(1, 11)]


def test_newest_of_each_author(hot):
    found = search(hot, limit=5, keys=("author",))
    assert sorted((r.author, r.number) for r in found.collect()) == sorted((a, n) for a, n, _ in pairs(select_prs(hot, "last 5", AS_OF)))
    assert found.columns == hot.columns


def test_a_high_limit_is_cut_by_running_counts(spark):
    hot = spark.range(40_000).select(
        F.lit("x/y").alias("repo"), F.col("id").alias("number"), F.lit("OPEN").alias("state"), F.lit("a").alias("author"),
        F.when(F.col("id") % 1000 != 0, F.timestamp_seconds(1_735_689_000 - F.floor(F.col("id") / 7) * 60 - F.col("id") % 5)).alias("created_at"))
    for limit in (1_001, 20_000, 39_970, 100_000):
        found = search(hot, limit=limit)
        want = hot.orderBy(*newest_first()).limit(limit)
        assert found.count() == min(limit, 40_000) and found.exceptAll(want).count() == 0
    plan = search(hot, limit=1_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
