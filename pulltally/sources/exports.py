"""Reading exported pull requests, details, diffs and file lists.

``read_*`` functions scan files and give ``Read(rows, rejected)``: the records with a given
layout (nothing is inferred), and the texts that are no such record or lack what makes them one.
``*_from_*`` functions turn raw records into the tables of ``schema``. Exports are JSON lines, which
Spark can split; ``pages=True`` reads stored answer pages (``{"items": [...]}``) instead, and
``multi_line=True`` records or pages that are indented over many lines, one to a file. Rows and rejected
texts are two results of one parse: with a ``run`` folder (``session.run_folder``) it is stored there and
done once, without one each of the two reads the export.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally import schema
from pulltally.functions.prs import (
    author_or_unknown,
    key_from_url,
    label_names,
    pr_state,
    present,
    repo_from_url,
    text_or_empty,
    utc_timestamp,
)
from pulltally.sources.pages import read_pages
from pulltally.sources.records import Read, decoded, missing, read_records, stored_texts


# Pull requests, search-API shape ------------------------------------------


def read_api_search(
    spark: SparkSession, path: str, pages: bool = False, multi_line: bool = False, run: str | None = None
) -> Read:
    """Pull requests from exported search items. Indented pages (``multi_line``) may have any size."""
    if multi_line:
        found = read_pages(spark, path, schema.RAW_API_ITEM, "items", _item_problem(), run=run)
        return Read(prs_from_api_items(found.rows), found.rejected)
    return api_search(stored_texts(spark, path), "items" if pages else None, run)


def api_search(texts: DataFrame, items: str | None = None, run: str | None = None) -> Read:
    """Pull requests from texts (``file``, ``text``) of search items, or of pages with a list of them."""
    found = read_records(texts, schema.RAW_API_ITEM, _item_problem(), items, run)
    return Read(prs_from_api_items(found.rows), found.rejected)


def _item_problem() -> Column:
    return missing(repository=present(F.col("repository_url")), number=F.col("number"))


def prs_from_api_items(items: DataFrame) -> DataFrame:
    merged_at = F.col("pull_request.merged_at")
    return items.select(
        repo_from_url(F.col("repository_url")).alias("repo"),
        "number",
        pr_state(F.col("state"), merged_at).alias("state"),
        "title",
        text_or_empty(F.col("body")).alias("body"),
        utc_timestamp(F.col("created_at")).alias("created_at"),
        utc_timestamp(F.col("closed_at")).alias("closed_at"),
        utc_timestamp(merged_at).alias("merged_at"),
        author_or_unknown(F.col("user.login")).alias("author"),
        label_names(F.col("labels")).alias("labels"),
        F.col("html_url").alias("url"),
    )


def pull_requests_only(items: DataFrame) -> DataFrame:
    """Of raw search items that mix issues and pull requests, the pull requests."""
    return items.filter(F.col("pull_request").isNotNull())


# Pull requests, command-line shape ----------------------------------------


def read_cli_search(spark: SparkSession, path: str, status_path: str, run: str | None = None) -> Read:
    """Pull requests from exported command-line records and their merge states."""
    repo = present(F.col("repository.nameWithOwner"))
    records = read_records(
        stored_texts(spark, path), schema.RAW_CLI_RECORD, missing(repository=repo, number=F.col("number")), run=run)
    key = missing(repository=present(F.col("repo")), number=F.col("number"))
    status = read_records(stored_texts(spark, status_path), schema.RAW_MERGE_STATUS, key, run=run)
    return Read(prs_from_cli_records(records.rows, status.rows), records.rejected.union(status.rejected))


def prs_from_cli_records(records: DataFrame, status: DataFrame) -> DataFrame:
    named = records.select(
        F.col("repository.nameWithOwner").alias("repo"),
        "number", "state", "title", "body",
        utc_timestamp(F.col("createdAt")).alias("created_at"),
        utc_timestamp(F.col("closedAt")).alias("closed_at"),
        author_or_unknown(F.col("author.login")).alias("author"),
        label_names(F.col("labels")).alias("labels"),
        "url",
    )
    return with_merge_status(named, status)


def with_merge_status(prs: DataFrame, status: DataFrame) -> DataFrame:
    """Set ``state`` and ``merged_at`` from the merge states looked up per pull request.

    A pull request without one keeps its own state, in capitals.
    """
    merged = status.groupBy(*schema.PR_KEY).agg(F.max(present(F.col("mergedAt"))).alias("_merged"))
    joined = prs.join(merged, list(schema.PR_KEY), "left")
    return joined.withColumns({
        "state": pr_state(F.col("state"), F.col("_merged")),
        "merged_at": utc_timestamp(F.col("_merged")),
    }).drop("_merged")


# Details -------------------------------------------------------------------


def read_details(
    spark: SparkSession, path: str, shape: str = "api", multi_line: bool = False, run: str | None = None
) -> Read:
    """Details from exported payloads, ``shape`` being ``api`` or ``cli``; indented ones (``multi_line``) one to a file.

    ``exported_at`` is the time of the file; of several copies of a record the latest counts.
    """
    layout, url, convert = {
        "api": (schema.RAW_API_DETAIL, "html_url", details_from_api),
        "cli": (schema.RAW_CLI_DETAIL, "url", details_from_cli),
    }[shape]
    repo, number = key_from_url(F.col(url))
    found = read_records(stored_texts(spark, path, multi_line), layout, missing(repository=repo, number=number), run=run)
    return Read(convert(found.rows), found.rejected)


def details_from_api(payloads: DataFrame) -> DataFrame:
    return _details(
        payloads, url="html_url", created_at="created_at", closed_at="closed_at",
        changed_files="changed_files", author="user.login", head="head.ref", base="base.ref", draft="draft",
        body=text_or_empty(F.col("body")))


def details_from_cli(payloads: DataFrame) -> DataFrame:
    return _details(
        payloads, url="url", created_at="createdAt", closed_at="closedAt",
        changed_files="changedFiles", author="author.login", head="headRefName", base="baseRefName",
        draft="isDraft", body=F.col("body"))


def _details(payloads: DataFrame, body: Column, **names: str) -> DataFrame:
    repo, number = key_from_url(F.col(names["url"]))
    return payloads.select(
        repo.alias("repo"),
        number.alias("number"),
        F.col(names["url"]).alias("url"),
        body.alias("body"),
        utc_timestamp(F.col(names["created_at"])).alias("created_at"),
        utc_timestamp(F.col(names["closed_at"])).alias("closed_at"),
        "additions",
        "deletions",
        F.col(names["changed_files"]).alias("changed_files"),
        F.col(names["author"]).alias("author"),
        "assignees",
        label_names(F.col("labels")).alias("labels"),
        F.col(names["head"]).alias("head_ref_name"),
        F.col(names["base"]).alias("base_ref_name"),
        F.col(names["draft"]).alias("is_draft"),
        *([F.col("modified").alias("exported_at")] if "modified" in payloads.columns else []),
    )


# Diffs ----------------------------------------------------------------------


def read_diff_records(spark: SparkSession, path: str, form: str = "json") -> Read:
    """Diffs as records ``repo, number, diff``, in JSON lines or ``form="parquet"``; the way to keep many of them.

    An empty diff counts as one; a record without ``diff`` is rejected.
    """
    key = {"repository": present(F.col("repo")), "number": F.col("number"), "diff": F.col("diff")}
    if form == "json":
        return diff_records(stored_texts(spark, path))
    stored = spark.read.schema(schema.PR_DIFFS).parquet(path).withColumn("reason", missing(**key))
    bad = stored.filter(F.col("reason").isNotNull())
    text = F.to_json(F.struct("repo", "number", "diff"))
    rejected = bad.select(F.col("_metadata.file_path").alias("file"), text.alias("text"), "reason")
    return Read(stored.filter(F.col("reason").isNull()).drop("reason"), rejected)


def diff_records(texts: DataFrame) -> Read:
    """Diffs from texts (``file``, ``text``) of records ``repo, number, diff``."""
    key = missing(repository=present(F.col("repo")), number=F.col("number"), diff=F.col("diff"))
    found = read_records(texts, schema.PR_DIFFS, key)
    return Read(found.rows.select("repo", "number", "diff"), found.rejected)


def read_diff_chunks(spark: SparkSession, path: str, form: str = "parquet") -> Read:
    """Diffs of any size as chunks ``repo, number, chunk, data``; in JSON lines (``form="json"``) data is base 64.

    Chunks of a diff are numbered from 0. A record without one of the four is rejected, as is text that isn't base 64.
    """
    if form == "json":
        layout = schema.PR_DIFF_CHUNKS.replace("BINARY", "STRING")
        data = F.try_to_binary(F.col("data"), F.lit("base64"))
        problem = missing(repository=present(F.col("repo")), number=F.col("number"), chunk=F.col("chunk"), data=data)
        found = read_records(stored_texts(spark, path), layout, problem)
        return Read(found.rows.select("repo", "number", "chunk", data.alias("data")), found.rejected)
    problem = missing(repository=present(F.col("repo")), number=F.col("number"), chunk=F.col("chunk"), data=F.col("data"))
    stored = spark.read.schema(schema.PR_DIFF_CHUNKS).parquet(path).withColumn("reason", problem)
    text = F.to_json(F.struct("repo", "number", "chunk"))
    rejected = stored.filter("reason is not null").select(F.col("_metadata.file_path").alias("file"), text.alias("text"), "reason")
    return Read(stored.filter("reason is null").drop("reason"), rejected)


def diff_chunks(diffs: DataFrame, chunk_bytes: int = 1 << 20, on: Sequence[str] = schema.PR_KEY) -> DataFrame:
    """Whole diffs cut into chunks of that many bytes, wherever that is; an empty diff has one empty chunk."""
    data = F.col("diff").cast("binary")
    last = F.floor((F.greatest(F.length(data), F.lit(1)) - 1) / chunk_bytes).cast("bigint")
    rows = diffs.filter(F.col("diff").isNotNull()).select(*on, data.alias("_data"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk"))
    part = F.substring("_data", (F.col("chunk") * chunk_bytes + 1).cast("int"), F.lit(chunk_bytes))
    return rows.select(*on, "chunk", part.alias("data"))


def read_diffs(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Whole diffs from files ``<owner>/<repo>/<number>.diff`` below ``path``.

    Spark lists folder by folder, many of them on the executors, but passes over empty files whatever the reader. With a
    ``manifest`` (``path``, ``bytes``) the empty diffs are those that it names with 0 bytes, and the driver lists nothing
    itself; without one it looks for them, which suits small sets. For very many diffs use ``read_diff_records`` or
    ``read_diff_chunks``, which hold many in a file.
    """
    texts = _diff_texts(spark, path, wholetext=True)
    return texts.withColumnRenamed("text", "diff").union(_empty_diffs(spark, path, manifest))


def read_diff_lines(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """The same files one line per row, so that Spark can split a large diff. An empty file has one empty line."""
    texts = _diff_texts(spark, path, lineSep="\n")
    return texts.withColumnRenamed("text", "line").union(_empty_diffs(spark, path, manifest))


def missing_diffs(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Manifest rows whose diff wasn't read: files that are gone, or whose place names no pull request."""
    listed = manifest.select(*key_from_path(F.col("path")), *manifest.columns)
    keys = found.select(*[F.col(name).alias(f"_{name}") for name in schema.PR_KEY]).distinct()
    same = (F.col("repo") == F.col("_repo")) & (F.col("number") == F.col("_number"))
    return listed.join(keys, same, "left_anti").select(*manifest.columns)


def _diff_texts(spark: SparkSession, path: str, **options) -> DataFrame:
    texts = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.diff").text(path, **options)
    return _keyed(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def _keyed(texts: DataFrame) -> DataFrame:
    """``repo, number, text`` of those whose ``path`` is a diff's place."""
    return texts.select(*key_from_path(F.col("path")), "text").filter(F.col("number").isNotNull())


def _empty_diffs(spark: SparkSession, path: str, manifest: DataFrame | None) -> DataFrame:
    """Files of length 0, from the manifest or as the driver finds them."""
    if manifest is not None:
        return _keyed(manifest.filter("bytes = 0").select("path", F.lit("").alias("text")))
    return _keyed(spark.createDataFrame([(place, "") for place in _empty_files(spark, path)], "path STRING, text STRING"))


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """Addresses of empty diff files, listed by the driver."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/*/*/*.diff")
    listed = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return [f.getPath().toUri().getRawPath() for f in listed or [] if f.getLen() == 0]


def key_from_path(path: Column) -> list[Column]:
    """Repository and number from a diff's place; null where it is none."""
    place = r"([^/]+/[^/]+)/(\d+)[.]diff$"
    file = decoded(path)
    return [
        F.nullif(F.regexp_extract(file, place, 1), F.lit("")).alias("repo"),
        F.nullif(F.regexp_extract(file, place, 2), F.lit("")).try_cast("bigint").alias("number"),
    ]


# Files ----------------------------------------------------------------------


def read_files(spark: SparkSession, path: str, multi_line: bool = False, run: str | None = None) -> Read:
    """Changed files from exported lists, one record per pull request; indented ones (``multi_line``) one to a file."""
    key = missing(repository=present(F.col("repo")), number=F.col("number"), files=F.col("files"))
    found = read_records(stored_texts(spark, path, multi_line), schema.RAW_FILES, key, run=run)
    return Read(files_from_lists(found.rows), found.rejected)


def files_from_lists(lists: DataFrame) -> DataFrame:
    """One row per file; both naming styles are understood."""
    rows = lists.select(*schema.PR_KEY, F.explode("files").alias("file"))
    return rows.select(
        *schema.PR_KEY,
        F.coalesce("file.path", "file.filename").alias("path"),
        F.col("file.additions").alias("additions"),
        F.col("file.deletions").alias("deletions"),
        F.coalesce("file.changeType", "file.status").alias("change_type"),
    )
