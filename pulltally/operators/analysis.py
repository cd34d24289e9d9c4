"""Roll-up of selected pull requests per author, and the threshold rules over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally import schema
from pulltally.functions.moments import Moment, report_date
from pulltally.functions.prs import pr_size, share
from pulltally.functions.text import fill, fixed_one, percent, rate_number, rate_short
from pulltally.operators.activity import AUTHOR, first_parts

COUNTERS = (
    "total_prs", "merged_prs", "total_size", "large_prs", "metric_prs", "total_additions",
    "total_deletions", "total_test_additions", "total_doc_additions", "security_prs",
)


def analysis_metrics(
    selected: DataFrame,
    metrics: DataFrame,
    authors: DataFrame | None = None,
    keys: Sequence[str] = AUTHOR,
    on: Sequence[str] = schema.PR_KEY,
) -> DataFrame:
    """Totals, rates and ratios of each author's selected pull requests.

    Sizes come from the metrics where there are any, else from the selection.
    Pull requests without metrics still count in totals, merge rate and average
    size. ``authors`` adds rows of zeros for authors with nothing selected.
    """
    measures = ("total_additions", "total_deletions", "test_additions", "doc_additions", "security_pattern_matches")
    measured = metrics.select(*on, F.lit(1).alias("measured"), *measures)
    own = {name: F.col(name) if name in selected.columns else F.lit(None).cast("bigint")
           for name in ("additions", "deletions")}
    rows = selected.select(
        *dict.fromkeys([*keys, *on]), "state", pr_size(own["additions"], own["deletions"]).alias("own_size"))
    size = F.coalesce(F.col("total_additions") + F.col("total_deletions"), F.col("own_size"))

    # First per pull request: partitioned by the join's keys, so without a
    # shuffle, and a repeated selection row cannot count its metrics twice.
    per_pr = (
        rows.join(measured, list(on), "left")
        .withColumn("size", size)
        .groupBy(*dict.fromkeys([*keys, *on]))
        .agg(
            F.count(F.lit(1)).alias("total_prs"),
            F.count_if(F.col("state") == "MERGED").alias("merged_prs"),
            F.sum("size").alias("total_size"),
            F.count_if(F.col("size") > fixed.LARGE_PR_CHANGES).alias("large_prs"),
            *[F.max(name).alias(name) for name in ("measured", *measures)],
        )
    )
    totals = per_pr.groupBy(*keys).agg(
        *[F.sum(name).alias(name) for name in ("total_prs", "merged_prs", "total_size", "large_prs")],
        F.count("measured").alias("metric_prs"),
        F.sum("total_additions").alias("total_additions"),
        F.sum("total_deletions").alias("total_deletions"),
        F.sum("test_additions").alias("total_test_additions"),
        F.sum("doc_additions").alias("total_doc_additions"),
        F.count_if(F.col("security_pattern_matches") > 0).alias("security_prs"),
        _exact_sum(share(F.col("test_additions"), F.col("total_additions"))).alias("test_shares"),
        _exact_sum(share(F.col("doc_additions"), F.col("total_additions"))).alias("doc_shares"),
    )
    if authors is not None:
        totals = authors.select(*keys).distinct().join(totals, list(keys), "left")
    return _with_ratios(totals.fillna(0, [*COUNTERS, "test_shares", "doc_shares"]), keys)


def _exact_sum(ratio: Column) -> Column:
    """A sum that does not depend on the order of rows.

    Sums of doubles do, and so could flip a rule or a printed digit when a lost
    executor's rows are computed again. Twelve decimals are added up exactly.
    """
    return F.sum(ratio.cast("decimal(28,12)")).cast("double")


def _with_ratios(totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    selected, measured = F.col("total_prs"), F.col("metric_prs")
    additions = F.col("total_additions")
    return totals.select(
        *keys, *COUNTERS,
        percent(F.col("merged_prs"), selected).alias("merge_rate"),
        share(F.col("total_size"), selected).alias("average_pr_size"),
        percent(F.col("total_test_additions"), additions).alias("test_to_code_ratio"),
        # No value without metrics: the test rule does not apply then.
        F.when(measured > 0, F.col("test_shares") / measured).alias("average_test_ratio"),
        share(F.col("doc_shares"), measured).alias("average_doc_ratio"),
        (F.col("total_doc_additions") / F.greatest(additions, F.lit(1)) * 100.0).alias("documentation_percent"),
    )


def _rules() -> list[tuple[Column, Column, str, tuple[str, str] | None]]:
    """Condition, finding, recommendation and risk of each rule, in report order."""
    count = F.col("total_prs")
    return [
        (F.col("merge_rate") < fixed.LOW_MERGE_RATE,
         fill(fixed.LOW_MERGE_FINDING, rate=fixed_one(F.col("merge_rate"))),
         fixed.LOW_MERGE_ADVICE, fixed.LOW_MERGE_RISK),
        (F.col("average_test_ratio") < fixed.LOW_TEST_RATIO,
         fill(fixed.LOW_TEST_FINDING, ratio=fixed_one(F.col("average_test_ratio") * 100.0)),
         fixed.LOW_TEST_ADVICE, fixed.LOW_TEST_RISK),
        (F.col("large_prs") > count * fixed.LARGE_PR_SHARE,
         fill(fixed.LARGE_PR_FINDING, count=F.col("large_prs")),
         fixed.LARGE_PR_ADVICE, fixed.LARGE_PR_RISK),
        (F.col("average_doc_ratio") < fixed.LOW_DOC_RATIO,
         F.lit(fixed.LOW_DOC_FINDING), fixed.LOW_DOC_ADVICE, None),
        (F.col("security_prs") > 0,
         fill(fixed.SECURITY_FINDING, count=F.col("security_prs")),
         fixed.SECURITY_ADVICE, None),
    ]


def _fired(pairs: list[tuple[Column, Column]]) -> Column:
    return F.array_compact(F.array(*[F.when(condition, value) for condition, value in pairs]))


def analyze_patterns(rollup: DataFrame) -> DataFrame:
    """``findings``, ``recommendations`` and ``risks`` from ``analysis_metrics`` rows."""
    rules = _rules()

    def risk(level: str, description: str) -> Column:
        return F.struct(F.lit(level).alias("level"), F.lit(description).alias("description"))

    return rollup.withColumns({
        "findings": _fired([(condition, finding) for condition, finding, _, _ in rules]),
        "recommendations": _fired([(condition, F.lit(advice)) for condition, _, advice, _ in rules]),
        "risks": _fired([(condition, risk(*danger)) for condition, _, _, danger in rules if danger]),
    })


def trend_findings(summary: Column) -> Column:
    """Findings on the change of merge rate and on low activity, from a report's ``summary``.

    Without a report there are none.
    """
    rate_30, rate_90 = summary["last_30_days"]["merge_rate"], summary["last_90_days"]["merge_rate"]
    number_30, number_90 = rate_number(rate_30), rate_number(rate_90)
    texts = {"rate_30": rate_short(rate_30), "rate_90": rate_short(rate_90)}
    declining = number_30 < number_90 - fixed.TREND_POINTS
    improving = number_30 > number_90 + fixed.TREND_POINTS
    findings = _fired([
        (declining, fill(fixed.DECLINING_FINDING, **texts)),
        (improving, fill(fixed.IMPROVING_FINDING, **texts)),
        (summary["last_30_days"]["total_prs"] < fixed.LOW_ACTIVITY_PRS, F.lit(fixed.LOW_ACTIVITY_FINDING)),
    ])
    return F.when(summary.isNotNull(), findings).otherwise(F.array().cast("array<string>"))


def analysis_result(
    rollup: DataFrame,
    activity: DataFrame | None = None,
    review_focus: str = fixed.DEFAULT_FOCUS,
    criteria: str = fixed.DEFAULT_CRITERIA,
    as_of: Moment = None,
    keys: Sequence[str] = AUTHOR,
) -> DataFrame:
    """The analysis of each author: metrics, findings, recommendations and risks.

    ``rollup`` comes from ``analysis_metrics``. ``activity`` (an ``activity_report``
    or ``activity_summaries``) adds the trend findings behind the others.
    """
    analyzed = analyze_patterns(rollup)
    if activity is not None:
        summaries = first_parts(activity).select(*keys, "summary")
        analyzed = (
            analyzed.join(summaries, list(keys), "left")
            .withColumn("findings", F.concat("findings", trend_findings(F.col("summary"))))
        )
    return analyzed.select(
        *keys,
        F.col("total_prs").alias("total_prs_analyzed"),
        F.lit(review_focus).alias("review_focus"),
        F.lit(criteria).alias("selection_criteria"),
        F.lit(report_date(as_of)).alias("analysis_date"),
        F.struct(
            "total_additions", "total_deletions", "total_test_additions", "total_doc_additions",
            "test_to_code_ratio", "merge_rate", "average_pr_size",
        ).alias("metrics"),
        "findings", "recommendations", "risks",
    )
