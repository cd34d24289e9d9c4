"""Ranks within a group that may be far too large for one task.

``row_number`` over a whole author sorts all of that author's rows in one task.
For "first n" with a small n Spark cuts each map task's rows down to n per author
before the shuffle, so nothing more is needed. For full ranks, large n and "all
but the last n" the group is cut into buckets that follow the order: rows per
bucket are counted (combined map-side), running totals over the short bucket list
give each bucket's first rank, and rows are numbered only inside their bucket.

Where no value bounds a bucket (one day's thousands of repositories), ``with_ranges`` cuts
it into ranges of its order. Their edges come from a sample that is combined map-side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Up to this many rows per group Spark prunes before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold, which session.configure sets).
SMALL_N = 1000

# Most rows that are gathered into one array; larger groups go on in further parts.
# Pull requests with their texts are wide, names with counts are not.
PART_ROWS = 10_000
WIDE_PART_ROWS = 1_000


@dataclass(frozen=True)
class Level:
    """One bucketing step: a value that follows the order, and its direction."""

    value: Column
    descending: bool


# Rows that a bucket may have before it is cut into ranges, and the rows sampled for their edges.
RANGE_ROWS = 8192
SAMPLES = 4096
# Samples behind each range: so its size varies by a third or so.
SAMPLES_PER_RANGE = 8

# Shares that a group is cut into before its first rows are taken.
SHARES = 32


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str, spread: Sequence[str] = ()
) -> DataFrame:
    """The first ``n`` rows per group with their rank; for ``n`` up to ``SMALL_N``.

    Each map task hands on ``n`` rows of a group, which for one large group over very many tasks would be
    too much for the one that takes the first of all. With ``spread``, columns that tell its rows apart, the
    first are taken from each of ``SHARES`` shares and then from these.
    """
    if spread:
        share = F.pmod(F.xxhash64(*spread), F.lit(SHARES))
        shares = numbered(df.withColumn("_share", share), [*keys, "_share"], order, rank)
        df = shares.filter(F.col(rank) <= n).drop("_share", rank)
    first = numbered(df, keys, order, rank).filter(F.col(rank) <= n)
    # Ranks are BIGINT everywhere; cast behind the filter, which is what prunes.
    return first.withColumn(rank, F.col(rank).cast("bigint"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str) -> DataFrame:
    """Plain ranks, only for inputs whose groups are short by nature (months of an author)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def with_ranges(df: DataFrame, keys: Sequence[str], bucket: Column, place: Column, name: str) -> DataFrame:
    """Adds ``name``, a number that follows ``place`` (ascending) within each bucket of a group; for a last ``Level``.

    Buckets of more than ``RANGE_ROWS`` rows are cut into ranges of about that many, at most ``SAMPLES`` /
    ``SAMPLES_PER_RANGE``; all others are 0. A bucket's sample holds the place with the lowest hash of each of
    ``SAMPLES`` slots, so map tasks combine theirs and no bucket is gathered. The same rows give the same ranges.
    """
    rows = df.withColumns({"_bucket": bucket, "_place": place})
    order = F.xxhash64("_place")
    rows = rows.withColumn("_share", F.pmod(order, F.lit(SHARES)).cast("int"))
    # Large buckets are few and mostly none. Their rows meet them in shares, so that no task gets all of them.
    large = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > RANGE_ROWS)
    shares = large.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    inside = rows.join(shares, [*keys, "_bucket", "_share"])
    slots = inside.groupBy(*keys, "_bucket", F.pmod(order, F.lit(SAMPLES)).alias("_slot")).agg(
        F.max("_rows").alias("_rows"), F.min_by("_place", order).alias("_sample"))
    samples = slots.groupBy(*keys, "_bucket").agg(F.max("_rows").alias("_rows"), F.array_sort(F.collect_list("_sample")).alias("_sorted"))
    ranges = F.least(F.ceil(F.col("_rows") / RANGE_ROWS), F.ceil(F.size("_sorted") / SAMPLES_PER_RANGE)).cast("int")
    edges = F.expr("transform(sequence(1, _ranges), k -> get(_sorted, cast(floor(k * size(_sorted) / _ranges) as int)))")
    cut = samples.withColumn("_ranges", ranges).select(*keys, "_bucket", F.slice(edges, 1, F.col("_ranges") - 1).alias("_edges"))
    copies = cut.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = rows.join(copies, [*keys, "_bucket", "_share"], "left")
    # The number of edges at or before the place, by halving steps.
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((SAMPLES // SAMPLES_PER_RANGE).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_edges", at + step - 1) <= F.col("_place"), at + step).otherwise(at))
    return met.withColumn(name, F.when(F.col("_edges").isNull(), 0).otherwise(found)).select(*df.columns, name)


def _running_totals(
    counts: DataFrame, keys: Sequence[str], names: Sequence[str], depth: int, level: Level
) -> DataFrame:
    """Rows ahead of each bucket of one depth, within the bucket that holds it."""
    outer = [*keys, *names[:depth]]
    bucket = F.col(names[depth])
    order = bucket.desc() if level.descending else bucket.asc()
    before = Window.partitionBy(*outer).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    added = {f"_ahead{depth}": F.coalesce(F.sum("_rows").over(before), F.lit(0))}
    if depth == 0:
        added["_group_rows"] = F.sum("_rows").over(Window.partitionBy(*outer))
    return counts.withColumns(added)


def bucket_offsets(df: DataFrame, keys: Sequence[str], levels: Sequence[Level]) -> DataFrame:
    """Per group and bucket: rows ahead of the bucket, in it, and in the group."""
    names = [f"_b{i}" for i in range(len(levels))]
    columns = [level.value.alias(name) for level, name in zip(levels, names)]
    counts = df.select(*keys, *columns).groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_rows"))

    last = len(levels) - 1
    placed = _running_totals(counts, keys, names, last, levels[last])
    for depth in range(last):
        at_depth = counts.groupBy(*keys, *names[: depth + 1]).agg(F.sum("_rows").alias("_rows"))
        totals = _running_totals(at_depth, keys, names, depth, levels[depth]).drop("_rows")
        placed = placed.join(totals, [*keys, *names[: depth + 1]])
    ahead = sum((F.col(f"_ahead{depth}") for depth in range(1, last + 1)), F.col("_ahead0"))
    return placed.select(*keys, *names, ahead.alias("_ahead"), "_rows", "_group_rows")


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    levels: Sequence[Level],
    rank: str,
    first: int | None = None,
    without_last: int = 0,
) -> DataFrame:
    """Exact rank per group, for groups of any size.

    ``levels`` must follow ``order``: rows of an earlier bucket precede all rows of
    a later one. ``first`` keeps ranks up to that number, ``without_last`` drops the
    highest ranks; both drop whole buckets before any row is sorted.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    offsets = bucket_offsets(df, keys, levels)
    rows = df.withColumns({name: level.value for level, name in zip(levels, names)})
    placed = rows.join(offsets, [*keys, *names])
    if first is not None:
        placed = placed.filter(F.col("_ahead") < first)
    if without_last:
        placed = placed.filter(F.col("_ahead") < F.col("_group_rows") - without_last)
    inside = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    result = placed.withColumn(rank, F.col("_ahead") + inside)
    if first is not None:
        result = result.filter(F.col(rank) <= first)
    if without_last:
        result = result.filter(F.col(rank) <= F.col("_group_rows") - without_last)
    return result.drop(*names, "_ahead", "_rows", "_group_rows")


def first_of_all(df: DataFrame, order: Sequence[Column], levels: Sequence[Level], n: int) -> DataFrame:
    """The first ``n`` of all rows. Only the bucket that holds the last of them is sorted; those before it are kept whole.

    The first level must have few values (years), as their totals are added up in one task.
    """
    names = [f"_b{i}" for i in range(len(levels))]
    kept = bucket_offsets(df, [], levels).filter(F.col("_ahead") < n)
    rows = df.withColumns({name: level.value for level, name in zip(levels, names)})
    whole = kept.filter(F.col("_ahead") + F.col("_rows") <= n)
    last = kept.filter(F.col("_ahead") + F.col("_rows") > n).select(*names, "_ahead")
    cut = rows.join(last, names).withColumn("_rank", F.row_number().over(Window.partitionBy(*names).orderBy(*order)))
    cut = cut.filter(F.col("_ahead") + F.col("_rank") <= n)
    return rows.join(whole, names, "left_semi").select(*df.columns).union(cut.select(*df.columns))


def gather_parts(
    df: DataFrame, keys: Sequence[str], rank: str, item: Column, name: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Arrays of ``item`` in rank order, at most ``part_rows`` long, one row per group and part.

    Parts count from 0 and follow on from one another, so a group that fits in one
    array is one row and a larger one is several; nothing is left out.
    """
    part = F.floor((F.col(rank) - 1) / part_rows).alias("part")
    pairs = df.select(*keys, part, F.struct(F.col(rank).alias("rank"), item.alias("item")).alias("pair"))
    gathered = pairs.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("pair")).alias("pairs"))
    return gathered.select(*keys, "part", F.col("pairs.item").alias(name))
