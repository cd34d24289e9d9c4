"""Per-PR metrics: diff line counts joined with sizes.

A diff is large and its counts are three integers, so lines are always counted
where the diff is read. Only keys and counts are shuffled, never texts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions.diff_lines import LINE_TESTS, added_lines, fold, is_added
from pulltally.functions.moments import microseconds

SIZES = ("additions", "deletions", "changed_files")

# Keys that may be broadcast: by number and by the bytes of their texts.
BROADCAST_KEYS = 200_000
BROADCAST_BYTES = 32 << 20


def diff_line_counts(diffs: DataFrame, on: Sequence[str] = schema.PR_KEY) -> DataFrame:
    """Test, documentation and security lines of each diff (one diff per row). No shuffle.

    A pull request without a diff has no counts, so null diffs give no row.
    """
    # A column of its own, so that the three counts share one split.
    rows = diffs.filter(F.col("diff").isNotNull()).select(*on, added_lines(F.col("diff")).alias("added"))
    counts = [F.size(F.filter("added", test)).cast("bigint").alias(name) for name, test in LINE_TESTS.items()]
    return rows.select(*on, *counts)


def diff_line_counts_by_line(diff_lines: DataFrame, on: Sequence[str] = schema.PR_KEY) -> DataFrame:
    """The same counts from one row per line; for diffs that are read line by line."""
    rows = diff_lines.select(*on, fold(F.col("line")).alias("line"))
    line = F.col("line")
    return rows.groupBy(*on).agg(
        *[F.count_if(is_added(line) & test(line)).alias(name) for name, test in LINE_TESTS.items()])


def diff_line_counts_by_chunk(chunks: DataFrame, on: Sequence[str] = schema.PR_KEY) -> DataFrame:
    """The same counts from diffs cut into numbered chunks (``chunk``, ``data`` BINARY), wherever the cuts are.

    Whole lines are counted in their chunk. What stands before a chunk's first line end and after its last is
    joined with its neighbours' to whole lines, as bytes, since a cut may fall inside a character. So only ends of
    chunks are shuffled, and no task needs a whole diff, whatever its size. Chunks of a diff are numbered in
    their order; null ones count as empty.
    """
    data = F.coalesce("data", F.lit(b""))
    rows = chunks.select(*on, "chunk", data.alias("data"))
    # A line end is one byte, which no other character holds; so it is found in any bytes.
    plain = F.col("data").cast("string")
    sizes = rows.withColumns({
        "_head": F.octet_length(F.substring_index(plain, "\n", 1)), "_tail": F.octet_length(F.substring_index(plain, "\n", -1)),
        "_ends": plain.contains("\n")})
    middle = F.expr("substring(data, _head + 2, length(data) - _head - _tail - 2)")
    whole = F.when(F.col("_ends") & (F.length("data") > F.col("_head") + F.col("_tail") + 1), middle.cast("string"))
    tail = F.expr("substring(data, length(data) - _tail + 1, _tail)")
    head = F.when(F.col("_ends"), F.expr("substring(data, 1, _head)")).otherwise(F.col("data"))
    cut = sizes.select(
        *on, "chunk", "_ends", head.alias("_first"), F.when(F.col("_ends"), tail).alias("_last"), added_lines(whole).alias("added"))
    inner = {name: F.coalesce(F.size(F.filter("added", test)), F.lit(0)).cast("bigint") for name, test in LINE_TESTS.items()}
    # Counts of whole lines go on with the ends of their chunk, so that chunks are read once.
    ends = cut.withColumns(inner).drop("added")

    # A line's number is that of the chunks with a line end before it; one with an end gives the rest of a line and the start of the next.
    before = Window.partitionBy(*on).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_line", F.coalesce(F.sum(F.col("_ends").cast("bigint")).over(before), F.lit(0)))

    def piece(part: int, data: str) -> Column:
        counts = [(F.col(name) if part == 0 else F.lit(0).cast("bigint")).alias(name) for name in LINE_TESTS]
        return F.struct(
            (F.col("_line") + part).alias("_line"), F.struct("chunk", F.lit(part).alias("part"), F.hex(data).alias("hex")).alias("piece"), *counts)

    pieces = F.when(F.col("_ends"), F.array(piece(0, "_first"), piece(1, "_last"))).otherwise(F.array(piece(0, "_first")))
    joined = ends.select(*on, F.inline(pieces)).groupBy(*on, "_line").agg(
        F.array_join(F.sort_array(F.collect_list("piece"))["hex"], "").alias("hex"), *[F.sum(name).alias(name) for name in LINE_TESTS])
    # As many rows with a line as there are lines across chunks; all of a diff are in one task already.
    lines = joined.select(*on, *LINE_TESTS, fold(F.unhex("hex").cast("string")).alias("_text"))
    text = F.col("_text")
    return lines.groupBy(*on).agg(
        *[F.sum(F.col(name) + (is_added(text) & test(text)).cast("bigint")).alias(name) for name, test in LINE_TESTS.items()])


def with_details(prs: DataFrame, details: DataFrame, on: Sequence[str] = schema.PR_KEY) -> DataFrame:
    """Pull requests with the sizes from their details; all pull requests stay."""
    sizes = _one_per_key(details, on, list(SIZES))
    names = [name for name in prs.columns if name not in SIZES]
    return prs.select(*names).join(sizes, list(on), "left")


def pr_metrics(
    details: DataFrame,
    diffs: DataFrame,
    selected: DataFrame | None = None,
    broadcast_selected: bool = False,
    on: Sequence[str] = schema.PR_KEY,
) -> DataFrame:
    """Metrics of every pull request that has both details and a diff, one row per key.

    With ``selected`` only those pull requests count: all diffs are counted on the
    spot and the narrow results joined. ``broadcast_selected``, for selections that
    pass ``few_rows``, drops the other diffs before their lines are counted.
    ``diffs`` has whole texts (``diff``), one ``line`` per row, or numbered chunks (``chunk``, ``data``).
    """
    keys = None if selected is None else selected.select(*on)
    if keys is not None and broadcast_selected:
        diffs = diffs.join(F.broadcast(keys.distinct()), list(on), "left_semi")
    count = diff_line_counts_by_line if "line" in diffs.columns else diff_line_counts_by_chunk if "chunk" in diffs.columns else diff_line_counts
    counted = count(diffs, on)

    counts = _one_per_key(counted, on, list(LINE_TESTS))
    sizes = _one_per_key(details, on, list(SIZES))
    both = sizes.join(counts, list(on))
    if keys is not None:
        both = both.join(keys, list(on), "left_semi")
    zero = F.lit(0).cast("bigint")
    return both.select(
        *on, *LINE_TESTS,
        F.coalesce("additions", zero).alias("total_additions"),
        F.coalesce("deletions", zero).alias("total_deletions"),
        F.coalesce("changed_files", zero).alias("files_changed"),
    )


def few_rows(
    df: DataFrame, most: int = BROADCAST_KEYS, most_bytes: int = BROADCAST_BYTES, on: Sequence[str] = schema.PR_KEY
) -> bool:
    """Whether ``df`` has at most ``most`` rows, whose keys take at most ``most_bytes``.

    Runs a job that counts no further than that many rows.
    """
    size = sum((F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0)) for name in on), F.lit(0))
    seen = df.select(size.alias("size")).limit(most + 1).agg(F.count("size").alias("n"), F.sum("size").alias("size")).first()
    return seen["n"] <= most and (seen["size"] or 0) <= most_bytes


def _one_per_key(df: DataFrame, on: Sequence[str], values: list[str]) -> DataFrame:
    """One record per key. Copies are combined map-side; of differing ones the same stays on every run.

    The latest export stays (``exported_at``), of those of one time, or where there is none, the record with
    the highest hash. The order is a number of fixed width, so that this is a hash aggregation, which does not sort.
    """
    order = F.xxhash64(*values)
    if "exported_at" in df.columns:
        time = microseconds(F.col("exported_at"), df.schema["exported_at"].dataType)
        # 64 bits of time, the lowest where there is none, and 60 of the hash: less than 38 digits.
        time = F.coalesce(time, F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)")
        order = (time + F.shiftright(order, 4)).cast("decimal(38,0)")
    hashed = df.withColumn("_order", order)
    return hashed.groupBy(*on).agg(*[F.max_by(name, "_order").alias(name) for name in values])
