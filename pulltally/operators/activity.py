"""Activity of each author: state counts, windows, repositories, months, newest pull requests.

Every operator takes ``keys``, the columns that make a group; ``("author",)`` is
the usual one; they must not be null (the sources name missing authors). Pull
requests need ``repo``, ``number``, ``state``, ``created_at``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally.functions.moments import Moment, cutoff, in_utc, iso_text, microseconds
from pulltally.functions.prs import month_key
from pulltally.functions.text import percent, rate_text
from pulltally.operators.ranking import (
    PART_ROWS,
    SMALL_N,
    Level,
    first_rows,
    gather_parts,
    numbered,
    ranked,
    with_ranges,
)

AUTHOR = ("author",)


def newest_first() -> list[Column]:
    """Creation order, newest first, with repository and number to settle ties."""
    return [F.col("created_at").desc(), F.col("repo").asc(), F.col("number").asc()]


def newest_levels() -> list[Level]:
    """Buckets for ``newest_first``: hours. What one account can open in an hour is limited.

    Pull requests without a readable time come last, by repository and ten thousand numbers of it.
    """
    hour = F.coalesce(F.date_trunc("hour", "created_at"), F.lit("0001-01-01").cast("timestamp"))
    untimed = F.when(F.col("created_at").isNull(), numbered_place())
    place = F.coalesce(untimed, F.struct(F.lit("").alias("repo"), F.lit(0).cast("bigint").alias("numbers")))
    return [Level(hour, True), Level(place, False)]


def numbered_place() -> Column:
    """Repository and ten thousand pull requests of it, in the order of repository and number."""
    return F.struct(F.coalesce("repo", F.lit("")).alias("repo"), F.floor(F.col("number") / 10_000).alias("numbers"))


def _day(moment: str) -> Column:
    return F.coalesce(F.to_date(moment), F.lit("0001-01-01").cast("date"))


def _counters(prs: DataFrame, as_of: Moment) -> dict[str, Column]:
    """State counts over all time and over both windows, which exclude their lower edge."""
    state = F.col("state")
    counters = {
        "total_prs": F.count(F.lit(1)),
        "open_prs": F.count_if(state == "OPEN"),
        "closed_prs": F.count_if(state == "CLOSED"),
        "merged_prs": F.count_if(state == "MERGED"),
    }
    for days in fixed.REPORT_WINDOW_DAYS:
        inside = F.col("created_at") > cutoff(prs, "created_at", as_of, days)
        counters[f"total_{days}d"] = F.count_if(inside)
        counters[f"merged_{days}d"] = F.count_if(inside & (state == "MERGED"))
    return counters


def _with_rates(counts: DataFrame) -> DataFrame:
    pairs = {"": ("merged_prs", "total_prs")}
    for days in fixed.REPORT_WINDOW_DAYS:
        pairs[f"_{days}d"] = (f"merged_{days}d", f"total_{days}d")
    rates = {}
    for suffix, (part, whole) in pairs.items():
        rates[f"merge_rate{suffix}"] = rate_text(F.col(part), F.col(whole))
        rates[f"merge_rate_value{suffix}"] = percent(F.col(part), F.col(whole))
    return counts.withColumns(rates)


def activity_summary(prs: DataFrame, as_of: Moment = None, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """State counts and merge rates, over all time and the last 30 and 90 days, in one grouping."""
    counters = [column.alias(name) for name, column in _counters(prs, as_of).items()]
    return _with_rates(prs.groupBy(*keys).agg(*counters))


def activity_summaries(prs: DataFrame, as_of: Moment = None, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Only the ``summary`` of ``activity_report``, for what does not need its lists."""
    return activity_summary(prs, as_of, keys).select(*keys, _summary().alias("summary"))


def repo_counts(prs: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Pull requests per repository, ranked by count, then latest activity, then name.

    An author with very many repositories is ranked by buckets of count and last day, with P pull requests over D
    days at most sqrt(2PD) of these, and where one day has thousands of them by ranges of time and name.
    """
    return _ranked_repos(_repo_totals(prs, keys), keys)


def _ranked_repos(counts: DataFrame, keys: Sequence[str], first: int | None = None) -> DataFrame:
    bucket = F.struct("pr_count", _day("last_created_at").alias("day"))
    # Within a bucket the latest come first, those without a time last, then names.
    time = microseconds(F.col("last_created_at"), counts.schema["last_created_at"].dataType)
    place = F.struct(F.coalesce(-time, F.lit(2**63 - 1)).alias("time"), F.coalesce("repo", F.lit("")).alias("repo"))
    ranges = with_ranges(counts, keys, bucket, place, "_range")
    # One list of buckets in their order: there are few even of an author with very many repositories.
    day = F.datediff(_day("last_created_at"), F.lit("0001-01-01").cast("date"))
    order = F.struct((-F.col("pr_count")).alias("count"), (-day).alias("day"), "_range")
    return ranked(ranges, keys, _busiest_first(), [Level(order, False)], "repo_rank", first=first).drop("_range")


def _repo_totals(prs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return prs.groupBy(*_plus(keys, "repo")).agg(
        F.count(F.lit(1)).alias("pr_count"), F.max("created_at").alias("last_created_at"))


def _busiest_first() -> list[Column]:
    return [F.col("pr_count").desc(), F.col("last_created_at").desc(), F.col("repo").asc()]


def top_repositories(prs: DataFrame, n: int = fixed.PROMPT_REPOSITORIES, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """The first ``n`` of ``repo_counts``."""
    return _first_repos(_repo_totals(prs, keys), n, keys)


def _first_repos(counts: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    if n > SMALL_N:
        return _ranked_repos(counts, keys, first=n)
    return first_rows(counts, keys, _busiest_first(), n, "repo_rank", spread=("repo",))


def _by_month(prs: DataFrame, as_of: Moment, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """All counters per month, and pull requests with the latest time per repository, from one pass over ``prs``."""
    counters = _counters(prs, as_of)
    base = (
        prs.withColumn("month", month_key(in_utc(prs, "created_at")))
        .groupBy(*_plus(_plus(keys, "repo"), "month"))
        .agg(*[column.alias(name) for name, column in counters.items()], F.max("created_at").alias("last_created_at"))
    )
    monthly = base.groupBy(*keys, "month").agg(*[F.sum(name).alias(name) for name in counters])
    repositories = base.groupBy(*_plus(keys, "repo")).agg(
        F.sum("total_prs").alias("pr_count"), F.max("last_created_at").alias("last_created_at"))
    return monthly, repositories


def monthly_counts(prs: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Pull requests per month (UTC), newest month ranked 1; months without any are absent."""
    counts = (
        prs.withColumn("month", month_key(in_utc(prs, "created_at")))
        .groupBy(*keys, "month")
        .agg(F.count(F.lit(1)).alias("pr_count"))
    )
    # As many rows per author as there are months, however many pull requests.
    ranks = numbered(counts, keys, [F.col("month").desc()], "month_rank")
    return ranks.withColumn("month_rank", F.col("month_rank").cast("bigint"))


def latest_months(prs: DataFrame, n: int = fixed.PROMPT_MONTHS, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """The first ``n`` of ``monthly_counts``."""
    return monthly_counts(prs, keys).filter(F.col("month_rank") <= n)


def recent_prs(prs: DataFrame, n: int = fixed.RECENT_PRS, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """The newest ``n`` pull requests of each author."""
    rows = prs.select(*dict.fromkeys([*keys, "repo", "number", "title", "state", "created_at"]))
    if n > SMALL_N:
        return ranked(rows, keys, newest_first(), newest_levels(), "recent_rank", first=n)
    return first_rows(rows, keys, newest_first(), n, "recent_rank", spread=("repo", "number"))


def activity_report(
    prs: DataFrame, as_of: Moment = None, keys: Sequence[str] = AUTHOR, part_rows: int = PART_ROWS
) -> DataFrame:
    """The whole activity report, one row per author.

    An author with more than ``part_rows`` repositories gets further rows, part 1
    and up, that go on with ``repositories`` and leave the other columns null.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("a report is made for groups; add a constant column to report on everything")
    monthly, repo_totals = _by_month(prs, as_of, keys)
    names = list(_counters(prs, as_of))
    month_item = F.struct("month", F.col("total_prs").alias("count"))
    totals = _with_rates(
        monthly.groupBy(*keys).agg(
            *[F.sum(name).alias(name) for name in names],
            F.sort_array(F.collect_list(month_item), asc=False).alias("monthly_activity"),
        )
    )

    repositories = gather_parts(
        _ranked_repos(repo_totals, keys), keys, "repo_rank",
        F.struct("repo", F.col("pr_count").alias("count")), "repositories", part_rows)

    recent = gather_parts(
        recent_prs(prs, keys=keys), keys, "recent_rank",
        F.struct("repo", "number", "title", "state", "created_at"), "recent_prs").drop("part")

    head = totals.join(recent, keys, "left").select(
        *keys, F.lit(0).cast("bigint").alias("part"), _summary().alias("summary"), "monthly_activity", "recent_prs")
    return (
        repositories.join(head, [*keys, "part"], "left")
        .select(
            *keys, "part", F.lit(iso_text(as_of)).alias("generated_at"),
            "summary", "repositories", "monthly_activity", "recent_prs")
    )


def prompt_overview(prs: DataFrame, as_of: Moment = None, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """What a coaching prompt shows: ``summary``, the first repositories and the latest months, one row per author."""
    keys = list(keys)

    def listed(rows: DataFrame, rank: str, item: Column, name: str) -> DataFrame:
        gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(rank, item.alias("item")))).alias("pairs"))
        return gathered.select(*keys, F.col("pairs.item").alias(name))

    monthly, repo_totals = _by_month(prs, as_of, keys)
    first = _first_repos(repo_totals, fixed.PROMPT_REPOSITORIES, keys)
    repositories = listed(first, "repo_rank", F.struct("repo", F.col("pr_count").alias("count")), "repositories")
    # As many rows per author as there are months.
    month = F.struct("month", F.col("total_prs").alias("count"))
    totals = _with_rates(monthly.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in _counters(prs, as_of)],
        F.slice(F.sort_array(F.collect_list(month), asc=False), 1, fixed.PROMPT_MONTHS).alias("monthly_activity")))
    return totals.select(*keys, _summary().alias("summary"), "monthly_activity").join(repositories, keys, "left")


def first_parts(activity: DataFrame) -> DataFrame:
    """One row per author of an ``activity_report``; ``activity_summaries`` has no other."""
    return activity.filter(F.col("part") == 0) if "part" in activity.columns else activity


def _summary() -> Column:
    def window(days: int) -> Column:
        return F.struct(
            F.col(f"total_{days}d").alias("total_prs"),
            F.col(f"merged_{days}d").alias("merged_prs"),
            F.col(f"merge_rate_{days}d").alias("merge_rate"),
        ).alias(f"last_{days}_days")

    return F.struct(
        "total_prs", "open_prs", "closed_prs", "merged_prs", "merge_rate",
        *[window(days) for days in fixed.REPORT_WINDOW_DAYS])


def _plus(keys: Sequence[str], column: str) -> list[str]:
    return list(dict.fromkeys([*keys, column]))
