"""The whole assessment: overview, selection, metrics, analysis, texts and files.

``assess`` gives the tables and the prompts. A model answers the prompts outside
this package; ``finish`` takes the answers in and gives the texts; ``save`` writes.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally import schema
from pulltally.functions.moments import Moment, utc
from pulltally.operators.activity import activity_report, first_parts
from pulltally.operators.analysis import analysis_metrics, analysis_result
from pulltally.operators.bundle import analysis_bundle
from pulltally.operators.insights import answered, split_answered
from pulltally.operators.languages import language_filter
from pulltally.operators.metrics import SIZES, few_rows, pr_metrics, with_details
from pulltally.operators.select import parse_criteria, search, select_prs
from pulltally.operators.texts import (
    assessments,
    coaching_prompts,
    coaching_reports,
    insight_prompts,
)
from pulltally.session import materialize, run_folder
from pulltally.sinks.writers import (
    BY_DATE,
    write_activity_reports,
    write_assessments,
    write_bundles,
    write_coaching,
)


@dataclass(frozen=True)
class AssessmentConfig:
    """What to look at. Without ``username`` every author gets a report."""

    review_focus: str = fixed.DEFAULT_FOCUS
    pr_selection: str = fixed.DEFAULT_CRITERIA
    username: str | None = None
    repo_filter: str | None = None
    language_filter: str | None = None
    output_dir: str = fixed.DEFAULT_OUTPUT

    @classmethod
    def quick(cls, username: str | None = None, repo_filter: str | None = None) -> AssessmentConfig:
        """The newest ten pull requests, all aspects."""
        return cls(fixed.QUICK_FOCUS, fixed.DEFAULT_CRITERIA, username, repo_filter)

    def as_column(self) -> Column:
        names = {"review_focus": "reviewFocus", "pr_selection": "prSelection", "username": "username",
                 "repo_filter": "repoFilter", "language_filter": "languageFilter", "output_dir": "outputDir"}
        return F.struct(*[
            F.lit(getattr(self, field.name)).cast("string").alias(names[field.name]) for field in fields(self)])


@dataclass(frozen=True)
class Assessment:
    """Tables of one run, each with one row per author unless said otherwise."""

    config: AssessmentConfig
    as_of: Moment
    activity: DataFrame
    selected: DataFrame  # one row per selected pull request
    metrics: DataFrame  # one row per measured pull request
    analysis: DataFrame
    insight_prompts: DataFrame
    run: str  # the folder of the tables written for this run


@dataclass(frozen=True)
class FinishedAssessment:
    analysis: DataFrame
    rejected: DataFrame  # authors whose model answer was missing or unusable
    coaching_prompts: DataFrame
    assessments: DataFrame
    bundles: DataFrame
    activity: DataFrame
    config: AssessmentConfig
    as_of: Moment
    run: str


def assess(
    prs: DataFrame,
    details: DataFrame,
    diffs: DataFrame,
    config: AssessmentConfig = AssessmentConfig(),
    as_of: Moment = None,
    files: DataFrame | None = None,
    folder: str | None = None,
) -> Assessment:
    """Overview, selection, metrics and analysis of every author in ``prs``.

    The activity reports, the selection and the metrics are written once to the
    shared folder: the analysis, the texts and the bundles all read them, and the
    diffs are scanned a single time. ``folder`` is the shared folder, by default that of the session;
    ``session.discard(spark, assessment.run)`` removes the tables when all is saved.
    """
    as_of = utc(as_of)
    run = run_folder(prs.sparkSession, folder)
    activity = materialize(activity_report(search(prs, config.username), as_of), "activity", run)

    candidates = search(prs, config.username, config.repo_filter)
    if config.language_filter:
        if files is None:
            raise ValueError("a language filter needs the table of changed files")
        candidates = language_filter(candidates, files, config.language_filter)
    selected = materialize(selected_prs(candidates, details, config.pr_selection, as_of), "selected", run)

    metrics = materialize(
        pr_metrics(details, diffs, selected, broadcast_selected=few_rows(selected)), "metrics", run)
    authors = first_parts(activity).select("author")
    analysis = analysis_result(
        analysis_metrics(selected, metrics, authors), activity, config.review_focus, config.pr_selection, as_of)
    return Assessment(config, as_of, activity, selected, metrics, analysis, insight_prompts(analysis), run)


def selected_prs(
    candidates: DataFrame, details: DataFrame, criteria: str, as_of: Moment, on: Sequence[str] = schema.PR_KEY
) -> DataFrame:
    """The selection. Sizes from details only choose the largest: what a pull request measures is for its metrics to say."""
    if parse_criteria(criteria).kind != "largest":
        return select_prs(candidates, criteria, as_of)
    own = {name: f"_own_{name}" for name in SIZES if name in candidates.columns}
    sized = with_details(candidates.withColumns({kept: F.col(name) for name, kept in own.items()}), details, on)
    return select_prs(sized, criteria, as_of).drop(*SIZES).withColumnsRenamed({kept: name for name, kept in own.items()})


def finish(assessment: Assessment, responses: DataFrame) -> FinishedAssessment:
    """Take in the model's answers (``author``, ``content``) and make the texts."""
    a = assessment
    # Joined and parsed once; all texts, bundles and the rejected answers read the result.
    parsed = materialize(answered(a.analysis, responses), f"answered-{uuid.uuid4().hex}", a.run)
    merged, rejected = split_answered(parsed, a.analysis.columns)
    return FinishedAssessment(
        analysis=merged,
        rejected=rejected,
        coaching_prompts=coaching_prompts(merged, a.activity, a.as_of),
        assessments=assessments(merged, a.activity, a.as_of),
        bundles=analysis_bundle(merged, a.selected, a.metrics, a.config.as_column()),
        activity=a.activity,
        config=a.config,
        as_of=a.as_of,
        run=a.run,
    )


def save(
    finished: FinishedAssessment,
    advice: DataFrame | None = None,
    layout: str = BY_DATE,
    files: int | None = None,
) -> None:
    """Write reports, assessments, coaching letters (``author``, ``advice``) and bundles.

    Folders ``activity``, ``assessments``, ``coaching`` and ``bundles`` under the
    configured output folder.
    """
    out, as_of = finished.config.output_dir.rstrip("/"), finished.as_of
    write_activity_reports(finished.activity, f"{out}/activity", as_of, layout, files)
    write_assessments(finished.assessments, f"{out}/assessments", as_of, layout, files)
    if advice is not None:
        write_coaching(coaching_reports(advice, as_of), f"{out}/coaching", as_of, layout, files)
    write_bundles(finished.bundles, f"{out}/bundles", as_of, layout, files)
