"""Every operator over the sample tables. Nested results are flattened so that SQL can be compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions import prs as pr
from pulltally.functions import text
from pulltally.operators import activity, analysis, insights, languages, metrics, texts
from pulltally.operators.bundle import analysis_bundle
from pulltally.operators.select import search, select_prs
from pulltally.plans.assessment import AssessmentConfig, selected_prs
from pulltally.samples import tables as t
from pulltally.sinks import writers
from pulltally.sources import exports
from pulltally.sources.reports import activity_reports, report_from_document

FOCUS = "test coverage, security"
CRITERIA = "last 10"
SELECTED = ("author", "repo", "number", "state", "created_at")

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(*names: str) -> list[Column]:
    """Ratios summed in any order agree to this many places."""
    return [F.round(F.col(name), 6).alias(name) for name in names]


# Activity -------------------------------------------------------------------


def activity_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = activity.activity_summary(t.pull_requests(spark, sf), t.AS_OF)
    values = ["merge_rate_value", "merge_rate_value_30d", "merge_rate_value_90d"]
    return summary.select(*[c for c in summary.columns if c not in values], *_rounded(*values))


def repo_activity_summary(spark: SparkSession, sf: str) -> DataFrame:
    summary = activity.activity_summary(t.pull_requests(spark, sf), t.AS_OF, keys=("repo",))
    return summary.drop("merge_rate_value", "merge_rate_value_30d", "merge_rate_value_90d")


def repo_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.repo_counts(t.pull_requests(spark, sf))


def top_repositories(spark: SparkSession, sf: str) -> DataFrame:
    return activity.top_repositories(t.pull_requests(spark, sf), 3)


def monthly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return activity.monthly_counts(t.pull_requests(spark, sf))


def latest_months(spark: SparkSession, sf: str) -> DataFrame:
    return activity.latest_months(t.pull_requests(spark, sf))


def recent_prs(spark: SparkSession, sf: str) -> DataFrame:
    return activity.recent_prs(t.pull_requests(spark, sf))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return activity.activity_report(t.pull_requests(spark, sf), t.AS_OF)


def _flat_report(report: DataFrame) -> DataFrame:
    def listing(name: str, *fields: str) -> Column:
        line = F.transform(name, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))
        return F.array_join(line, " ").alias(name)

    s = F.col("summary")
    return report.select(
        "author", "part", "generated_at",
        *[s[name].alias(name) for name in ("total_prs", "open_prs", "closed_prs", "merged_prs", "merge_rate")],
        *[s[f"last_{days}_days"][name].alias(f"{name}_{days}d")
          for days in (30, 90) for name in ("total_prs", "merged_prs", "merge_rate")],
        listing("repositories", "repo", "count"),
        listing("monthly_activity", "month", "count"),
        listing("recent_prs", "repo", "number", "title", "state"))


def activity_report(spark: SparkSession, sf: str) -> DataFrame:
    return _flat_report(_report(spark, sf))


def stored_activity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Reports made into the stored JSON documents and read back."""
    document = writers.report_document(_report(spark, sf))
    stored = document.select(F.to_json(F.struct("*")).alias("json"))
    parsed = stored.select(F.from_json("json", schema.REPORT_DOCUMENT).alias("report")).select("report.*")
    return _flat_report(report_from_document(parsed))


def stored_report_rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents of which every author's whose name ends in 3 is cut off."""
    document = writers.report_document(_report(spark, sf))
    text = F.to_json(F.struct("*"))
    cut = F.when(F.col("user").endswith("3"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    texts = document.withColumn("text", text).withColumn("text", cut).select(F.lit("report.json").alias("file"), "text", "user")
    rejected = activity_reports(texts.select("file", "text")).rejected
    user = F.regexp_extract("text", '"user":"([^"]*)"', 1)
    return rejected.select(user.alias("author"), "file", "reason")


def stored_report_rest(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of these documents."""
    document = writers.report_document(_report(spark, sf))
    text = F.to_json(F.struct("*"))
    cut = F.when(F.col("user").endswith("3"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    texts = document.withColumn("text", text).withColumn("text", cut).select(F.lit("report.json").alias("file"), "text")
    return _flat_report(activity_reports(texts).rows)


# Selection ------------------------------------------------------------------


def search_author_repo(spark: SparkSession, sf: str) -> DataFrame:
    return search(t.pull_requests(spark, sf), "user-1", "org/repo-1")


def search_newest(spark: SparkSession, sf: str) -> DataFrame:
    return search(t.pull_requests(spark, sf), limit=100)


def search_newest_many(spark: SparkSession, sf: str) -> DataFrame:
    return search(t.pull_requests(spark, sf), limit=1234)


def search_newest_per_author(spark: SparkSession, sf: str) -> DataFrame:
    return search(t.pull_requests(spark, sf), limit=4, keys=("author",))


def _selection(criteria: str, sized: bool = False) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        prs = t.pull_requests(spark, sf)
        if sized:
            prs = metrics.with_details(prs, t.pr_details(spark, sf), on=t.KEY)
        chosen = select_prs(prs, criteria, t.AS_OF)
        extra = [c for c in ("additions", "deletions", "selection_rank") if c in chosen.columns]
        return chosen.select(*SELECTED, *extra)

    return query


# Metrics --------------------------------------------------------------------


def diff_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.diff_line_counts(t.pr_diffs(spark, sf), on=t.KEY)


def diff_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of diffs that are cut into chunks, most cuts being inside a line."""
    return metrics.diff_line_counts_by_chunk(exports.diff_chunks(t.pr_diffs(spark, sf), 1000, t.KEY), on=t.KEY)


def diff_records(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of diffs that are stored as records."""
    return metrics.diff_line_counts(exports.diff_records(t.diff_texts(spark, sf)).rows, on=t.KEY)


def diff_records_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rejected = exports.diff_records(t.diff_texts(spark, sf)).rejected
    number = F.regexp_extract("text", '"number":([0-9]+)', 1).cast("bigint")
    return rejected.select(number.alias("number"), "file", "reason")


def diff_files(spark: SparkSession, sf: str) -> DataFrame:
    """Diffs that are stored one to a file, with the key from the file's address."""
    return t.diff_paths(spark, sf).select(
        *exports.key_from_path(F.col("path")), F.length("diff").cast("bigint").alias("length"))


def diff_line_counts_by_line(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.diff_line_counts_by_line(t.pr_diff_lines(spark, sf), on=t.KEY)


def _metrics(spark: SparkSession, sf: str, selected: DataFrame | None = None) -> DataFrame:
    return metrics.pr_metrics(t.pr_details(spark, sf), t.pr_diffs(spark, sf), selected, on=t.KEY)


def pr_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf)


def selected_pr_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, _selected(spark, sf))


# Analysis -------------------------------------------------------------------


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    return select_prs(t.pull_requests(spark, sf), CRITERIA, t.AS_OF)


def _rollup(spark: SparkSession, sf: str) -> DataFrame:
    # No selection for the metrics: the roll-up joins them to the selection anyway.
    return analysis.analysis_metrics(_selected(spark, sf), _metrics(spark, sf), on=t.KEY)


def _summaries(spark: SparkSession, sf: str) -> DataFrame:
    return activity.activity_summaries(t.pull_requests(spark, sf), t.AS_OF)


def _analysis(spark: SparkSession, sf: str, report: DataFrame) -> DataFrame:
    return analysis.analysis_result(_rollup(spark, sf), report, FOCUS, CRITERIA, t.AS_OF)


def analysis_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rollup = _rollup(spark, sf)
    ratios = ["merge_rate", "average_pr_size", "test_to_code_ratio", "average_test_ratio",
              "average_doc_ratio", "documentation_percent"]
    return rollup.select(*[c for c in rollup.columns if c not in ratios], *_rounded(*ratios))


def recent_analysis_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A selection that leaves most authors without pull requests; all of them get a row."""
    prs = t.pull_requests(spark, sf)
    selected = select_prs(prs, "last-90-days", t.AS_OF)
    rollup = analysis.analysis_metrics(
        selected, _metrics(spark, sf), authors=prs.select("author"), on=t.KEY)
    return rollup.select(
        "author", "total_prs", "metric_prs", "total_size", "security_prs",
        *_rounded("merge_rate", "average_pr_size", "average_doc_ratio"))


def largest_analysis_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The largest pull requests, some of them without a diff: these have no size, as with any other selection."""
    candidates = t.pull_requests(spark, sf)
    selected = selected_prs(candidates, t.pr_details(spark, sf), "largest 10", t.AS_OF, on=t.KEY)
    rollup = analysis.analysis_metrics(selected, _metrics(spark, sf), on=t.KEY)
    return rollup.select("author", "total_prs", "metric_prs", "total_size", "large_prs", *_rounded("average_pr_size"))


def _listed(name: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        patterns = analysis.analyze_patterns(_rollup(spark, sf))
        if name == "risks":
            return patterns.select("author", F.inline("risks"))
        return patterns.select("author", F.posexplode(name).alias("position", "text"))

    return query


def trend_findings(spark: SparkSession, sf: str) -> DataFrame:
    # The list is a column of its own before it is exploded: exploding an expression
    # over struct fields directly loses all rows in Spark 4.1 (nested column pruning).
    found = _summaries(spark, sf).withColumn("found", analysis.trend_findings(F.col("summary")))
    return found.select("author", F.explode("found").alias("text"))


def analysis_result(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("metrics")
    return _analysis(spark, sf, _summaries(spark, sf)).select(
        "author", "total_prs_analyzed", "review_focus", "selection_criteria", "analysis_date",
        *[m[name].alias(name) for name in (
            "total_additions", "total_deletions", "total_test_additions", "total_doc_additions")],
        *[F.round(m[name], 6).alias(name) for name in ("test_to_code_ratio", "merge_rate", "average_pr_size")],
        F.array_join("findings", "|").alias("findings"),
        F.array_join("recommendations", "|").alias("recommendations"),
        F.array_join(F.transform("risks", lambda r: F.concat(r["level"], F.lit(":"), r["description"])), "|")
        .alias("risks"))


def analysis_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles in parts of 3 pull requests, so that most authors have several."""
    selected = select_prs(t.pull_requests(spark, sf), "open", t.AS_OF)
    measured = _metrics(spark, sf)
    rollup = analysis.analysis_metrics(
        selected, measured, authors=t.pull_requests(spark, sf).select("author"), on=t.KEY)
    result = analysis.analysis_result(rollup, None, FOCUS, "open", t.AS_OF)
    config = F.struct(F.lit(FOCUS).alias("reviewFocus"))
    bundles = analysis_bundle(result, selected, measured, config, on=t.KEY, part_rows=3)
    return bundles.select(
        "author", "part",
        F.col("config.reviewFocus").alias("review_focus"),
        F.array_join(F.transform("selected_prs", lambda p: p["number"].cast("string")), " ").alias("numbers"),
        F.array_join(F.array_sort(F.map_keys("metrics")), " ").alias("measured"),
        F.col("report.total_prs_analyzed").alias("total_prs_analyzed"))


def bundle_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Bundles under their stored names."""
    selected, measured = _selected(spark, sf), _metrics(spark, sf)
    result = analysis.analysis_result(
        analysis.analysis_metrics(selected, measured, on=t.KEY), None, FOCUS, CRITERIA, t.AS_OF)
    config = AssessmentConfig(FOCUS, CRITERIA).as_column()
    document = writers.bundle_document(analysis_bundle(result, selected, measured, config, on=t.KEY))
    names = F.transform("selectedPRs", lambda p: F.concat(
        p["repository"]["nameWithOwner"], F.lit("#"), p["number"], F.lit("@"), p["createdAt"]))
    tested = F.aggregate(F.map_values("metrics"), F.lit(0).cast("bigint"), lambda n, m: n + m["testAdditions"])
    return document.select(
        "user", "part", F.col("config.prSelection").alias("selection"), F.array_join(names, " ").alias("selected"),
        F.size("metrics").cast("bigint").alias("measured"), tested.alias("test_lines"),
        F.col("report.totalPRsAnalyzed").alias("total_prs"),
        F.col("report.metrics.totalAdditions").alias("additions"))


# Sources --------------------------------------------------------------------


def pr_fields(spark: SparkSession, sf: str) -> DataFrame:
    """The expressions over one pull request."""
    prs = metrics.with_details(t.pull_requests(spark, sf), t.pr_details(spark, sf), on=t.KEY)
    return prs.select(
        "number",
        pr.repo_owner(F.col("repo")).alias("owner"),
        pr.repo_name(F.col("repo")).alias("name"),
        pr.pr_key(F.col("repo"), F.col("number")).alias("key"),
        pr.month_key(F.col("created_at")).alias("month"),
        pr.pr_size(F.col("additions"), F.col("deletions")).alias("size"),
        text.fixed_one(pr.share(F.col("deletions"), F.col("additions")) * 100).alias("deleted_percent"))


def api_pull_requests(spark: SparkSession, sf: str) -> DataFrame:
    prs = exports.prs_from_api_items(t.api_items(spark, sf))
    return prs.withColumn("labels", F.array_join("labels.name", ",")).withColumns(
        {name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in ("created_at", "closed_at", "merged_at")})


def api_pull_requests_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rejected = exports.api_search(t.api_texts(spark, sf)).rejected
    number = F.regexp_extract("text", '"number":([0-9]+)', 1).cast("bigint")
    return rejected.select(number.alias("number"), "file", "reason")


def api_activity_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over a broken export."""
    prs = exports.api_search(t.api_texts(spark, sf)).rows
    summary = activity.activity_summary(prs, t.AS_OF)
    return summary.select("author", "total_prs", "open_prs", "closed_prs", "merged_prs", "merge_rate")


def api_pull_requests_only(spark: SparkSession, sf: str) -> DataFrame:
    items = exports.pull_requests_only(t.api_items(spark, sf))
    return exports.prs_from_api_items(items).select("repo", "number", "state")


def merge_status_enrich(spark: SparkSession, sf: str) -> DataFrame:
    prs = exports.prs_from_cli_records(t.cli_records(spark, sf), t.merge_status(spark, sf))
    return prs.select("repo", "number", "author", "state",
                      F.date_format("merged_at", "yyyy-MM-dd HH:mm:ss").alias("merged_at"))


def api_pr_details(spark: SparkSession, sf: str) -> DataFrame:
    return exports.details_from_api(t.api_details(spark, sf)).select(
        "repo", "number", "body", "additions", "deletions", "changed_files", "author",
        "head_ref_name", "base_ref_name", "is_draft")


def cli_pr_details(spark: SparkSession, sf: str) -> DataFrame:
    return exports.details_from_cli(t.cli_details(spark, sf)).select(
        "repo", "number", "body", "additions", "deletions", "changed_files", "author",
        F.col("assignees")[0]["login"].alias("assignee"), "head_ref_name", "is_draft")


def pr_files(spark: SparkSession, sf: str) -> DataFrame:
    return exports.files_from_lists(t.file_lists(spark, sf)).drop("repo")


def language_filter(spark: SparkSession, sf: str) -> DataFrame:
    files = t.pr_files(spark, sf)
    prs = languages.language_filter(t.pull_requests(spark, sf), files, "TypeScript, python", on=t.KEY)
    return prs.select(*SELECTED)


# Texts ----------------------------------------------------------------------


def insight_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return texts.insight_prompts(_analysis(spark, sf, _summaries(spark, sf)))


def coaching_prompt(spark: SparkSession, sf: str) -> DataFrame:
    overview = activity.prompt_overview(t.pull_requests(spark, sf), t.AS_OF)
    return texts.coaching_prompts(_analysis(spark, sf, _summaries(spark, sf)), overview, t.AS_OF)


def assessment_markdown(spark: SparkSession, sf: str) -> DataFrame:
    summaries = _summaries(spark, sf)
    return texts.assessments(_analysis(spark, sf, summaries), summaries, t.AS_OF)


def coaching_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = t.pull_requests(spark, sf).groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    advice = counts.select("author", F.concat(F.lit("Well done: "), "n", F.lit(" so far.")).alias("advice"))
    return texts.coaching_reports(advice, t.AS_OF)


def assessment_records(spark: SparkSession, sf: str) -> DataFrame:
    """Assessments as they are stored."""
    summaries = _summaries(spark, sf)
    return writers.assessment_records(texts.assessments(_analysis(spark, sf, summaries), summaries, t.AS_OF), t.AS_OF)


def coaching_records(spark: SparkSession, sf: str) -> DataFrame:
    """Coaching reports as they are stored; authors whose number ends in 0 got no advice."""
    authors = t.pull_requests(spark, sf).select("author").distinct()
    advice = F.when(~F.col("author").endswith("0"), F.lit("Keep going."))
    coaching = texts.coaching_reports(authors.select("author", advice.alias("advice")), t.AS_OF)
    return writers.coaching_records(coaching, t.AS_OF)


def _merged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    patterns = analysis.analyze_patterns(_rollup(spark, sf))
    return insights.merge_insights(patterns, t.responses(t.pull_requests(spark, sf)))


def merge_insights(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)[0].select(
        "author", F.array_join("findings", "|").alias("findings"),
        F.array_join("recommendations", "|").alias("recommendations"))


def rejected_insights(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf)[1].select("author", "content", "problem")


QUERIES: dict[str, Query] = {
    "activity_summary": activity_summary,
    "repo_activity_summary": repo_activity_summary,
    "repo_counts": repo_counts,
    "top_repositories": top_repositories,
    "monthly_counts": monthly_counts,
    "latest_months": latest_months,
    "recent_prs": recent_prs,
    "activity_report": activity_report,
    "stored_activity_report": stored_activity_report,
    "stored_report_rejected": stored_report_rejected,
    "stored_report_rest": stored_report_rest,
    "search_author_repo": search_author_repo,
    "search_newest": search_newest,
    "search_newest_many": search_newest_many,
    "search_newest_per_author": search_newest_per_author,
    "select_last_n": _selection("last 3"),
    "select_last_many": _selection("last 2000"),
    "select_last_negative": _selection("last -3"),
    "select_largest_n": _selection("largest 3", sized=True),
    "select_largest_negative": _selection("largest -2", sized=True),
    "select_unreviewed": _selection("unreviewed"),
    "select_last_week": _selection("last-week"),
    "select_last_30d": _selection("last-30-days"),
    "select_last_90d": _selection("last-90-days"),
    "select_open": _selection("open"),
    "select_default": _selection("custom"),
    "diff_line_counts": diff_line_counts,
    "diff_chunk_counts": diff_chunk_counts,
    "diff_records": diff_records,
    "diff_records_rejected": diff_records_rejected,
    "diff_files": diff_files,
    "diff_line_counts_by_line": diff_line_counts_by_line,
    "pr_metrics": pr_metrics,
    "selected_pr_metrics": selected_pr_metrics,
    "analysis_metrics": analysis_metrics,
    "largest_analysis_metrics": largest_analysis_metrics,
    "recent_analysis_metrics": recent_analysis_metrics,
    "pattern_findings": _listed("findings"),
    "pattern_recommendations": _listed("recommendations"),
    "pattern_risks": _listed("risks"),
    "trend_findings": trend_findings,
    "analysis_result": analysis_result,
    "analysis_bundles": analysis_bundles,
    "bundle_documents": bundle_documents,
    "pr_fields": pr_fields,
    "api_pull_requests": api_pull_requests,
    "api_pull_requests_rejected": api_pull_requests_rejected,
    "api_activity_summary": api_activity_summary,
    "api_pull_requests_only": api_pull_requests_only,
    "merge_status_enrich": merge_status_enrich,
    "api_pr_details": api_pr_details,
    "cli_pr_details": cli_pr_details,
    "pr_files": pr_files,
    "language_filter": language_filter,
    "insight_prompt": insight_prompt,
    "coaching_prompt": coaching_prompt,
    "assessment_markdown": assessment_markdown,
    "coaching_report": coaching_report,
    "assessment_records": assessment_records,
    "coaching_records": coaching_records,
    "merge_insights": merge_insights,
    "rejected_insights": rejected_insights,
}
