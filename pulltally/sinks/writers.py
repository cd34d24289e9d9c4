"""Storing reports as JSON and Markdown.

Two layouts:

``by_date`` (default)
    Folders per day (and run), users hashed over a number of files that the caller
    sets. Every record names its user. Holds any number of users.
``per_user``
    ``user=<user>/date=<date>[/run=<run>]``, one folder per user as a single
    developer expects it. A folder each costs the file system dearly beyond some
    ten thousand users; this layout is for teams.

``key`` is the column whose value a record is stored under as its user, for reports made by other
columns than ``author``; ``sources.reports`` reads them back under that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally.functions.moments import Moment, iso_seconds, report_date, run_name

BY_DATE, PER_USER = "by_date", "per_user"


def write_activity_reports(
    activity: DataFrame, path: str, as_of: Moment = None, layout: str = BY_DATE, files: int | None = None,
    key: str = "author",
) -> None:
    document = report_document(activity, key).withColumn("date", F.lit(report_date(as_of)))
    _write(document, path, ["date"], layout, files, "json")


def write_assessments(
    texts: DataFrame, path: str, as_of: Moment = None, layout: str = BY_DATE, files: int | None = None,
    key: str = "author",
) -> None:
    """Markdown assessments (columns ``author``, ``assessment``); a missing one is an error."""
    _write_texts(assessment_records(texts, as_of, key), path, layout, files)


def assessment_records(texts: DataFrame, as_of: Moment = None, key: str = "author") -> DataFrame:
    """Assessments as they are stored: user, text, date and run."""
    text = F.coalesce("assessment", F.raise_error(F.concat(F.lit("no assessment for "), key)))
    return _text_records(texts.withColumn("assessment", text), "assessment", as_of, key)


def write_coaching(
    texts: DataFrame, path: str, as_of: Moment = None, layout: str = BY_DATE, files: int | None = None,
    key: str = "author",
) -> None:
    """Coaching reports (columns ``author``, ``coaching``), where there is one."""
    _write_texts(coaching_records(texts, as_of, key), path, layout, files)


def coaching_records(texts: DataFrame, as_of: Moment = None, key: str = "author") -> DataFrame:
    """Coaching reports as they are stored: user, text, date and run; none for authors without advice."""
    return _text_records(texts.filter(F.col("coaching").isNotNull()), "coaching", as_of, key)


def write_bundles(
    bundles: DataFrame, path: str, as_of: Moment = None, layout: str = BY_DATE, files: int | None = None,
    key: str = "author",
) -> None:
    document = bundle_document(bundles, key)
    _write(_placed(document, as_of), path, ["date", "run"], layout, files, "json")


def _placed(df: DataFrame, as_of: Moment) -> DataFrame:
    return df.withColumns({"date": F.lit(report_date(as_of)), "run": F.lit(run_name(as_of))})


def _text_records(texts: DataFrame, column: str, as_of: Moment, key: str) -> DataFrame:
    return _placed(texts.select(F.col(key).alias("user"), column), as_of)


def _write_texts(rows: DataFrame, path: str, layout: str, files: int | None) -> None:
    # A text file of many users could not tell them apart, so by_date stores records.
    _write(rows, path, ["date", "run"], layout, files, "text" if layout == PER_USER else "json")


def _write(
    df: DataFrame, path: str, folders: list[str], layout: str, files: int | None, form: str
) -> None:
    if layout == PER_USER:
        # One file per user and folder; the parts of a large record spread over tasks.
        keys = [name for name in ("user", "part") if name in df.columns]
        df = df.repartition(*keys) if files is None else df.repartition(files, *keys)
        folders = ["user", *folders]
    elif files is not None:
        df = df.repartition(files, "user")
    # Replace the folders written now and keep other days and runs.
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders)
    if form == "json":
        writer.option("ignoreNullFields", "false").json(path)
    else:
        writer.text(path)


def report_document(activity: DataFrame, key: str = "author") -> DataFrame:
    """Reports under the names their readers know."""
    s = F.col("summary")

    def window(name: str, alias: str) -> Column:
        return F.struct(
            s[name]["total_prs"].alias("totalPRs"), s[name]["merged_prs"].alias("mergedPRs"),
            s[name]["merge_rate"].alias("mergeRate")).alias(alias)

    summary = F.struct(
        s["total_prs"].alias("totalPRs"), s["open_prs"].alias("openPRs"), s["closed_prs"].alias("closedPRs"),
        s["merged_prs"].alias("mergedPRs"), s["merge_rate"].alias("mergeRate"),
        window("last_30_days", "last30Days"), window("last_90_days", "last90Days"))
    created = activity.schema["recent_prs"].dataType.elementType["created_at"].dataType
    recent = F.transform("recent_prs", lambda pr: F.struct(
        pr["repo"].alias("repo"), pr["number"].alias("number"), pr["title"].alias("title"),
        pr["state"].alias("state"), iso_seconds(pr["created_at"], created).alias("createdAt")))
    return activity.select(
        F.col(key).alias("user"), "part", F.col("generated_at").alias("generatedAt"),
        F.when(s.isNotNull(), summary).alias("summary"), "repositories",
        F.col("monthly_activity").alias("monthlyActivity"), recent.alias("recentPRs"))


def bundle_document(bundles: DataFrame, key: str = "author") -> DataFrame:
    """Bundles under the names their readers know."""
    r, m = F.col("report"), F.col("report")["metrics"]
    report = F.struct(
        r["total_prs_analyzed"].alias("totalPRsAnalyzed"), r["review_focus"].alias("reviewFocus"),
        r["selection_criteria"].alias("selectionCriteria"), r["analysis_date"].alias("analysisDate"),
        F.struct(
            m["total_additions"].alias("totalAdditions"), m["total_deletions"].alias("totalDeletions"),
            m["total_test_additions"].alias("totalTestAdditions"),
            m["total_doc_additions"].alias("totalDocAdditions"),
            m["test_to_code_ratio"].alias("testToCodeRatio"), m["merge_rate"].alias("mergeRate"),
            m["average_pr_size"].alias("averagePRSize")).alias("metrics"),
        r["findings"].alias("findings"), r["recommendations"].alias("recommendations"), r["risks"].alias("risks"))
    renamed = {"created_at": "createdAt", "closed_at": "closedAt", "merged_at": "mergedAt",
               "changed_files": "changedFiles"}
    shown = bundles.schema["selected_prs"].dataType.elementType

    def pull_request(pr: Column) -> Column:
        fields = []
        login = pr["author"] if "author" in shown.names else F.col(key)
        for name in shown.names:
            if name == "author":
                continue
            if name == "repo":
                fields.append(F.struct(pr[name].alias("nameWithOwner")).alias("repository"))
            else:
                value = iso_seconds(pr[name], shown[name].dataType) if name.endswith("_at") else pr[name]
                fields.append(value.alias(renamed.get(name, name)))
        return F.struct(*fields, F.struct(login.alias("login")).alias("author"))

    def measures(key: Column, v: Column) -> Column:
        return F.struct(
            v["test_additions"].alias("testAdditions"), v["doc_additions"].alias("docAdditions"),
            v["security_pattern_matches"].alias("securityPatternMatches"),
            v["total_additions"].alias("totalAdditions"), v["total_deletions"].alias("totalDeletions"),
            v["files_changed"].alias("filesChanged"))

    return bundles.select(
        F.col(key).alias("user"), "part", "config",
        F.transform("selected_prs", pull_request).alias("selectedPRs"),
        F.transform_values("metrics", measures).alias("metrics"),
        F.when(r.isNotNull(), report).alias("report"))
