"""Prompt and report texts, one column per author row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally import schema
from pulltally.functions.moments import Moment, report_date, short_date
from pulltally.functions.text import (
    fill,
    fixed_one,
    fixed_zero,
    lines,
    or_not_available,
    or_text,
)
from pulltally.operators.activity import AUTHOR, first_parts


def _with_report(
    analysis: DataFrame, activity: DataFrame | None, columns: Sequence[str], keys: Sequence[str]
) -> DataFrame:
    """Analyses with ``columns`` of their activity report, null where there is none."""
    if activity is None:
        return analysis.withColumns(
            {name: F.lit(None).cast(layout) for name, layout in schema.REPORT_COLUMNS.items() if name in columns})
    return analysis.join(first_parts(activity).select(*keys, *columns), list(keys), "left")


def insight_prompts(analysis: DataFrame, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """The question for further insights, in column ``prompt``."""
    m = F.col("metrics")
    doc_ratio = m["total_doc_additions"] / F.greatest(m["total_additions"], F.lit(1)) * 100.0
    prompt = fill(
        fixed.INSIGHT_PROMPT,
        review_focus=F.col("review_focus"),
        total_prs=F.col("total_prs_analyzed"),
        merge_rate=fixed_one(m["merge_rate"]),
        average_size=fixed_zero(m["average_pr_size"]),
        test_ratio=fixed_one(m["test_to_code_ratio"]),
        doc_ratio=fixed_one(doc_ratio),
        findings=F.array_join("findings", "\n"),
    )
    return analysis.select(*keys, prompt.alias("prompt"))


def coaching_prompts(
    analysis: DataFrame, activity: DataFrame | None = None, as_of: Moment = None, keys: Sequence[str] = AUTHOR
) -> DataFrame:
    """The request for a coaching letter, in column ``prompt``."""
    m, summary = F.col("metrics"), F.col("summary")

    def count(name: str) -> Column:
        return F.coalesce(summary[name], F.lit(0))

    def first(name: str, n: int, field: str) -> Column:
        return lines(F.slice(name, 1, n), fixed.COUNT_LINE, name=field, count="count")

    period = F.when(summary.isNotNull(), F.lit(short_date(as_of))).otherwise(F.lit(fixed.NO_PERIOD))
    prompt = fill(
        fixed.COACHING_PROMPT,
        user=F.col(keys[0]),
        period=period,
        total_prs=count("total_prs"),
        merge_rate=or_text(summary["merge_rate"], "0"),
        open_prs=count("open_prs"),
        closed_prs=count("closed_prs"),
        merged_prs=count("merged_prs"),
        repositories=or_text(first("repositories", fixed.PROMPT_REPOSITORIES, "repo"), fixed.NO_REPOSITORIES),
        months=or_text(first("monthly_activity", fixed.PROMPT_MONTHS, "month"), fixed.NO_MONTHS),
        test_ratio=fixed_one(m["test_to_code_ratio"]),
        doc_lines=m["total_doc_additions"],
        average_size=fixed_zero(m["average_pr_size"]),
        additions=m["total_additions"],
        deletions=m["total_deletions"],
        findings=F.array_join("findings", "\n"),
        risks=_risks(fixed.RISK_LINE),
    )
    report = _with_report(analysis, activity, ("summary", "repositories", "monthly_activity"), keys)
    return report.select(*keys, prompt.alias("prompt"))


def assessments(
    analysis: DataFrame,
    activity: DataFrame | None = None,
    as_of: Moment = None,
    footer: str = fixed.REPORT_FOOTER,
    keys: Sequence[str] = AUTHOR,
) -> DataFrame:
    """The assessment as Markdown, in column ``assessment``.

    Of ``activity`` it needs the summaries only.
    """
    m = F.col("metrics")
    summary = F.col("summary")
    periods = {"all": summary, "90": summary["last_90_days"], "30": summary["last_30_days"]}
    trend = {}
    for name, period in periods.items():
        trend[f"total_{name}"] = or_not_available(period["total_prs"])
        trend[f"merged_{name}"] = or_not_available(period["merged_prs"])
        trend[f"rate_{name}"] = or_text(period["merge_rate"], fixed.NOT_AVAILABLE)

    def numbered(text: Column, i: Column) -> Column:
        return fill(fixed.NUMBERED_LINE, number=i + 1, text=text)

    text = fill(
        fixed.ASSESSMENT_REPORT,
        date=F.lit(report_date(as_of)),
        user=or_text(F.col(keys[0]), fixed.NO_USER),
        review_focus=F.col("review_focus"),
        total_prs=F.col("total_prs_analyzed"),
        criteria=F.col("selection_criteria"),
        merge_rate=fixed_one(m["merge_rate"]),
        average_size=fixed_zero(m["average_pr_size"]),
        test_ratio=fixed_one(m["test_to_code_ratio"]),
        doc_lines=m["total_doc_additions"],
        additions=m["total_additions"],
        deletions=m["total_deletions"],
        findings=F.array_join(F.transform("findings", lambda f: fill(fixed.FINDING_BULLET, text=f)), "\n"),
        risks=_risks(fixed.RISK_BULLET),
        recommendations=F.array_join(F.transform("recommendations", numbered), "\n"),
        footer=F.lit(footer),
        **trend,
    )
    return _with_report(analysis, activity, ("summary",), keys).select(*keys, text.alias("assessment"))


def _risks(template: str) -> Column:
    def line(risk: Column) -> Column:
        return fill(template, level=F.upper(risk["level"]), description=risk["description"])

    return F.array_join(F.transform("risks", line), "\n")


def coaching_reports(advice: DataFrame, as_of: Moment = None, keys: Sequence[str] = AUTHOR) -> DataFrame:
    """Given advice texts (column ``advice``) inside their report frame, in column ``coaching``."""
    text = fill(
        fixed.COACHING_REPORT,
        user=F.col(keys[0]), date=F.lit(report_date(as_of)), advice=F.col("advice"))
    return advice.select(*keys, text.alias("coaching"))
