"""Pull-request analytics for every author and repository in one Spark job."""

from pulltally.operators.activity import (
    activity_report,
    activity_summary,
    monthly_counts,
    recent_prs,
    repo_counts,
)
from pulltally.operators.analysis import analysis_result, analyze_patterns
from pulltally.operators.metrics import diff_line_counts, pr_metrics
from pulltally.operators.select import search, select_prs
from pulltally.plans.assessment import AssessmentConfig, assess, finish, save
from pulltally.session import configure

__all__ = [
    "AssessmentConfig",
    "activity_report",
    "activity_summary",
    "analysis_result",
    "analyze_patterns",
    "assess",
    "configure",
    "diff_line_counts",
    "finish",
    "monthly_counts",
    "pr_metrics",
    "recent_prs",
    "repo_counts",
    "save",
    "search",
    "select_prs",
]
