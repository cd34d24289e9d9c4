"""The sample star schema read as pull requests, details, diffs and file lists.

Orders stand for pull requests, their line items for sizes and changed files, and
documents for diff texts. The sample details carry no repository, so the key here
is ``number`` alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally import schema

# The day after the last order.
AS_OF = "2001-08-02"
KEY = ("number",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pull_requests(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("number"),
        F.concat(F.lit("user-"), "o_custkey").alias("author"),
        F.concat(F.lit("org/repo-"), F.substring("o_orderpriority", 1, 1)).alias("repo"),
        F.when(F.col("o_orderstatus") == "F", "MERGED").when(F.col("o_orderstatus") == "O", "OPEN")
        .otherwise("CLOSED").alias("state"),
        F.col("o_orderdate").alias("created_at"),
        F.concat(F.lit("PR "), "o_orderkey").alias("title"),
    )


def pr_details(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes per order; every third order's are scaled up, the others down, to get large and small ones."""
    wide = F.col("l_orderkey") % 3 == 0

    def lines_where(condition: Column) -> Column:
        quantity = F.sum(F.when(condition, F.col("l_quantity")).otherwise(0.0))
        scaled = quantity * F.max(F.when(wide, 20).otherwise(1)) / F.max(F.when(wide, 1).otherwise(20))
        return F.floor(scaled)

    returned = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(
        lines_where(~returned).alias("additions"),
        lines_where(returned).alias("deletions"),
        F.count(F.lit(1)).alias("changed_files"),
    )


def pr_diffs(spark: SparkSession, folder: str) -> DataFrame:
    """A file header and the lines of one document per order, every third line a deletion.

    Documents repeat over the orders in turn; one turn in 17 has no document, so
    these orders have no diff. Every 29th order's diff is empty.
    """
    documents = table(spark, folder, "documents").select("doc_id", "text")
    held = documents.select(F.count(F.lit(1))).scalar()
    body = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.concat(F.when(i % 3 == 2, F.lit("-")).otherwise(F.lit("+")), line))
    # Lines are marked before the join, once a document. Behind it there is far more text than is shuffled,
    # by whose size Spark would merge partitions to one for each core; with a number given it keeps them.
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    documents = documents.repartition(spread, "doc_id").select("doc_id", F.array_join(body, "\n").alias("body"))
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders").select(
        key.alias("number"), (key % (held + F.floor(held / 16))).alias("doc_id"))
    path = F.element_at(
        F.array(*[F.lit(p) for p in ("src/app.py", "tests/app.test.ts", "README.md", "src/auth.ts", "src/core.go")]),
        (F.col("number") % 5 + 1).cast("int"))
    diff = F.concat(F.lit("+++ b/"), path, F.lit("\n"), F.col("body"))
    empty = F.col("number") % 29 == 0
    return orders.join(documents, "doc_id").select(
        "number", F.when(empty, F.lit("")).otherwise(F.coalesce(diff, F.lit(""))).alias("diff"))


def diff_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The diffs as they lie in files, one to a file, with their addresses."""
    path = F.concat(F.lit("s3://exports/a%20b/org/re%20po-"), F.col("number") % 7, F.lit("/"), "number", F.lit(".diff"))
    return pr_diffs(spark, folder).select(path.alias("path"), "diff")


def diff_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The diffs as JSON lines. Every 13th line is cut off, every 17th has no diff."""
    number = F.col("number")
    record = F.to_json(F.struct(F.lit("org/repo").alias("repo"), "number", F.when(number % 17 != 0, F.col("diff")).alias("diff")))
    return _cut_off(pr_diffs(spark, folder).select("number", record.alias("text")), 13)


def _cut_off(texts: DataFrame, every: int) -> DataFrame:
    """``file`` and ``text``; the texts of every so many numbers end early."""
    text = F.when(F.col("number") % every == 0, F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    return texts.select(F.lit("export.json").alias("file"), text.alias("text"))


def pr_diff_lines(spark: SparkSession, folder: str) -> DataFrame:
    return pr_diffs(spark, folder).select("number", F.explode(F.split("diff", "\n", -1)).alias("line"))


def _changed_file() -> dict[str, Column]:
    """One changed file per line item."""
    part = F.col("l_partkey")
    ending = F.when(part % 3 == 0, ".ts").when(part % 3 == 1, ".py").otherwise(".go")
    returned = F.col("l_returnflag") == "R"
    changed = F.col("l_quantity").cast("bigint")
    return {
        "path": F.concat(F.lit("src/f"), part, ending),
        "additions": F.when(returned, F.lit(0)).otherwise(changed),
        "deletions": F.when(returned, changed).otherwise(F.lit(0)),
        "change_type": F.when(F.col("l_linestatus") == "O", "modified").otherwise("added"),
    }


def pr_files(spark: SparkSession, folder: str) -> DataFrame:
    columns = [column.alias(name) for name, column in _changed_file().items()]
    return table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("number"), *columns)


def file_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as an export holds them: a JSON list per pull request, in both naming styles."""
    file = _changed_file()
    api_named = F.col("l_linenumber") % 2 == 0
    entry = F.struct(
        F.when(~api_named, file["path"]).alias("path"),
        F.when(api_named, file["path"]).alias("filename"),
        file["additions"].alias("additions"),
        file["deletions"].alias("deletions"),
        F.when(~api_named, file["change_type"]).alias("changeType"),
        F.when(api_named, file["change_type"]).alias("status"))
    lists = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("number")).agg(F.collect_list(entry).alias("files"))
    record = F.to_json(F.struct(F.lit("org/repo").alias("repo"), "number", "files"))
    return _parsed(lists.select(record.alias("json")), schema.RAW_FILES)


def api_items(spark: SparkSession, folder: str) -> DataFrame:
    """Pull requests as raw search items: made into JSON and parsed as an export is."""
    return _parsed(_api_records(spark, folder).select(F.col("text").alias("json")), schema.RAW_API_ITEM)


def api_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The items as lines of an export. Every 11th is cut off, every 23rd has no address of its repository."""
    return _cut_off(_api_records(spark, folder, without_repository=23), 11)


def _api_records(spark: SparkSession, folder: str, without_repository: int | None = None) -> DataFrame:
    prs = pull_requests(spark, folder)
    merged = F.when(F.col("state") == "MERGED", F.lit("2001-08-01T12:00:00Z"))
    login = F.when(F.col("author").endswith("7"), F.lit("")).otherwise(F.col("author"))
    address = F.concat(F.lit(fixed.API_REPO_PREFIX), "repo")
    labels = F.array(F.lit("plain"), F.to_json(F.struct(F.col("repo").alias("name"))), F.lit('{"id":1}'))
    item = F.to_json(F.struct(
        "number",
        F.when(F.col("state") == "OPEN", "open").otherwise("closed").alias("state"),
        "title",
        F.when(F.col("number") % 2 == 0, F.concat(F.lit("Body of "), "title")).alias("body"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.col("state") != "OPEN", F.lit("2001-08-01T12:00:00Z")).alias("closed_at"),
        (F.when(F.col("number") % without_repository != 0, address) if without_repository else address).alias("repository_url"),
        F.struct(login.alias("login")).alias("user"),
        labels.alias("labels"),
        F.when(F.col("state") != "OPEN", F.struct(merged.alias("merged_at"))).alias("pull_request"),
        F.concat(F.lit("https://github.com/"), "repo", F.lit("/pull/"), "number").alias("html_url")))
    return prs.select("number", item.alias("text"))


def cli_records(spark: SparkSession, folder: str) -> DataFrame:
    prs = pull_requests(spark, folder)
    record = F.to_json(F.struct(
        F.struct(F.col("repo").alias("nameWithOwner")).alias("repository"),
        "number",
        F.when(F.col("state") == "OPEN", "open").otherwise("closed").alias("state"),
        "title",
        F.lit("").alias("body"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.struct(F.col("author").alias("login")).alias("author")))
    return _parsed(prs.select(record.alias("json")), schema.RAW_CLI_RECORD)


def merge_status(spark: SparkSession, folder: str) -> DataFrame:
    """Merge states of the pull requests that have details, the others' lookup having failed."""
    prs = pull_requests(spark, folder)
    known = prs.join(pr_details(spark, folder).select("number"), "number", "left_semi")
    merged_at = F.when(F.col("state") == "MERGED", F.lit("2001-08-01T12:00:00Z")).otherwise(F.lit(""))
    return known.select("repo", "number", "state", merged_at.alias("mergedAt"))


def api_details(spark: SparkSession, folder: str) -> DataFrame:
    joined = pull_requests(spark, folder).join(pr_details(spark, folder), "number")
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://github.com/"), "repo", F.lit("/pull/"), "number").alias("html_url"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        "additions", "deletions", "changed_files",
        F.struct(F.col("author").alias("login")).alias("user"),
        F.struct(F.concat(F.lit("branch-"), "number").alias("ref")).alias("head"),
        F.struct(F.lit("main").alias("ref")).alias("base"),
        (F.col("state") == "OPEN").alias("draft")))
    return _parsed(joined.select(payload.alias("json")), schema.RAW_API_DETAIL)


def cli_details(spark: SparkSession, folder: str) -> DataFrame:
    joined = pull_requests(spark, folder).join(pr_details(spark, folder), "number")
    payload = F.to_json(F.struct(
        F.concat(F.lit("https://github.com/"), "repo", F.lit("/pull/"), "number").alias("url"),
        F.col("title").alias("body"),
        "additions", "deletions",
        F.col("changed_files").alias("changedFiles"),
        F.struct(F.col("author").alias("login")).alias("author"),
        F.array(F.struct(F.col("author").alias("login"))).alias("assignees"),
        F.lit("feature").alias("headRefName"),
        F.lit("main").alias("baseRefName"),
        (F.col("state") == "OPEN").alias("isDraft")))
    return _parsed(joined.select(payload.alias("json")), schema.RAW_CLI_DETAIL)


def responses(prs: DataFrame) -> DataFrame:
    """Answers per author, by last digit: plain JSON, fenced JSON, JSON without recommendations, or no JSON.

    Digits 0 and 5 answer twice the same. Of numbers in the tens, 1 adds a null item, 2 adds another
    answer, 3 goes on after the object.
    """
    last, tens = F.substring("author", -1, 1), F.substring("author", -2, 1)
    full = F.concat(F.lit('{"insights": ["Insight for '), "author", F.lit('"], "recommendations": ["Advice A", "Advice B"]}'))
    content = (
        F.when(last.isin("0", "1", "2", "3"), full)
        .when(last.isin("4", "5", "6"), F.concat(F.lit("```json\n"), full, F.lit("\n```\n")))
        .when(last == "7", F.lit('{"insights": ["only insights"]}'))
        .when(last == "8", F.lit("Sorry, no analysis today."))
    )
    content = (
        F.when(last.isin("7", "8"), content)
        .when(tens == "1", F.replace(content, F.lit('"Advice B"]'), F.lit('null, "Advice B"]')))
        .when(tens == "3", F.concat(content, F.lit(" {}")))
        .otherwise(content)
    )
    again = F.when(last.isin("0", "5"), content)
    other = F.when(tens == "2", F.lit('{"insights": [], "recommendations": []}'))
    authors = prs.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    answers = F.array_compact(F.array(content, again, other))
    return authors.filter(last != "9").select("author", F.explode(answers).alias("content"))


def _parsed(df: DataFrame, layout: str) -> DataFrame:
    return df.select(F.from_json("json", layout).alias("record")).select("record.*")
