"""Reading stored activity reports back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions.prs import utc_timestamp
from pulltally.sources.records import Read, decoded, missing, read_records, stored_texts


def read_activity_reports(
    spark: SparkSession, path: str, date: str | None = None, multi_line: bool = False, run: str | None = None,
    key: str = "author",
) -> Read:
    """Reports that ``write_activity_reports`` stored, as ``activity_report`` gives them.

    ``date`` reads one day only; other days' folders are not opened. ``multi_line`` reads documents that are
    indented over many lines, one to a file. What cannot be read is rejected, and its author goes on
    without a report. Reports of an author with very many repositories have several rows; ``part`` tells them apart. ``key`` is the column that the stored user is given as.
    """
    texts = stored_texts(spark, path, multi_line)
    if date is not None:
        texts = texts.filter(F.col("date").cast("string") == date)
    return activity_reports(texts.select("file", "text"), run, key)


def activity_reports(texts: DataFrame, run: str | None = None, key: str = "author") -> Read:
    """Reports from texts (``file``, ``text``). A document without ``user`` has it in its folder's name ``user=``."""
    user = user_of(F.col("user"), F.col("_file"))
    found = read_records(texts.withColumn("_file", F.col("file")), schema.REPORT_DOCUMENT, missing(user=user), run=run)
    return Read(report_from_document(found.rows.withColumn("user", user), key), found.rejected)


def user_of(user: Column, file: Column) -> Column:
    """The document's user, else the one that its folder ``user=`` names."""
    folder = F.nullif(F.regexp_extract(file, r"/user=([^/]+)/", 1), F.lit(""))
    # Spark encodes the name for the folder, and the folder for the address.
    return F.coalesce(user, decoded(decoded(folder)))


def report_from_document(stored: DataFrame, key: str = "author") -> DataFrame:
    def window(name: str, alias: str) -> Column:
        w = F.col("summary")[name]
        return F.struct(
            w["totalPRs"].alias("total_prs"), w["mergedPRs"].alias("merged_prs"),
            w["mergeRate"].alias("merge_rate")).alias(alias)

    s = F.col("summary")
    summary = F.struct(
        s["totalPRs"].alias("total_prs"), s["openPRs"].alias("open_prs"),
        s["closedPRs"].alias("closed_prs"), s["mergedPRs"].alias("merged_prs"),
        s["mergeRate"].alias("merge_rate"),
        window("last30Days", "last_30_days"), window("last90Days", "last_90_days"))
    recent = F.transform("recentPRs", lambda pr: F.struct(
        pr["repo"].alias("repo"), pr["number"].alias("number"), pr["title"].alias("title"),
        pr["state"].alias("state"), utc_timestamp(pr["createdAt"]).alias("created_at")))
    return stored.filter(F.col("user").isNotNull()).select(
        F.col("user").alias(key),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.col("generatedAt").alias("generated_at"),
        F.when(s.isNotNull(), summary).alias("summary"),
        "repositories",
        F.col("monthlyActivity").alias("monthly_activity"),
        recent.alias("recent_prs"),
    )
