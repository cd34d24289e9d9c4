"""Everything an analysis used and gave, as one nested record per author."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions.prs import pr_key
from pulltally.operators.activity import AUTHOR, newest_first, newest_levels
from pulltally.operators.ranking import WIDE_PART_ROWS, gather_parts, ranked
from pulltally.operators.select import RANK

# Selection columns a bundle shows when the selection has them.
SHOWN = ("repo", "number", "state", "title", "body", "created_at", "closed_at", "merged_at",
         "additions", "deletions", "changed_files", "labels", "url")


def analysis_bundle(
    analysis: DataFrame,
    selected: DataFrame,
    metrics: DataFrame,
    config: Column,
    keys: Sequence[str] = AUTHOR,
    on: Sequence[str] = schema.PR_KEY,
    part_rows: int = WIDE_PART_ROWS,
) -> DataFrame:
    """``config``, ``selected_prs``, ``metrics`` (by ``owner/repo#number``) and ``report`` per author.

    Each row holds at most ``part_rows`` pull requests. A longer selection goes on
    in rows with part 1 and up, whose ``report`` is null. An author with nothing
    selected has one row with empty lists.
    """
    keys = list(keys)
    if RANK in selected.columns:
        placed = selected
    else:
        placed = ranked(selected, keys, newest_first(), newest_levels(), RANK)

    measured = metrics.select(*on, F.struct(*schema.METRIC_COLUMNS).alias("m"))
    sizes = {"additions": "m.total_additions", "deletions": "m.total_deletions", "changed_files": "m.files_changed"}
    placed = placed.join(measured, list(on), "left")
    placed = placed.withColumns({
        name: F.coalesce(F.col(measure), F.col(name)) if name in selected.columns else F.col(measure)
        for name, measure in sizes.items()})
    shown = [name for name in SHOWN if name in placed.columns]
    item = F.struct(
        F.struct(*shown).alias("pr"),
        F.struct(pr_key(F.col("repo"), F.col("number")).alias("key"), F.col("m").alias("value")).alias("entry"))
    parts = gather_parts(placed, keys, RANK, item, "items", part_rows)

    measured_only = F.filter("items", lambda i: i["entry"]["value"].isNotNull())
    entries = F.array_distinct(F.transform(measured_only, lambda i: i["entry"]))
    filled = parts.select(
        *keys, "part", F.col("items.pr").alias("selected_prs"), F.map_from_entries(entries).alias("metrics"))

    report = F.struct(*[name for name in analysis.columns if name not in keys]).alias("report")
    heads = analysis.select(*keys, F.lit(0).cast("bigint").alias("part"), report)
    joined = filled.join(heads, [*keys, "part"], "full_outer")
    empty_prs = F.array().cast(filled.schema["selected_prs"].dataType)
    empty_metrics = F.create_map().cast(filled.schema["metrics"].dataType)
    return joined.select(
        *keys, "part", config.alias("config"),
        F.coalesce("selected_prs", empty_prs).alias("selected_prs"),
        F.coalesce("metrics", empty_metrics).alias("metrics"),
        "report")
