"""Indented answer pages of any size, item by item.

``JSON.stringify(page, null, 2)`` and its like put every item of a top-level list on lines of its own, between lines
that hold nothing but a bracket at a fixed indentation. No JSON string holds a raw line end, so lines alone tell where
an item begins and ends. Spark splits a page's file into blocks, whose counts of beginnings and ends are added up; so no
task needs a whole page. What is no item (the rest of the page, or a page in another layout) is read as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulltally.functions.strict_json import struct_fields, with_object
from pulltally.sources.records import NOT_JSON, Read, parse_records, split


def read_pages(
    spark: SparkSession, path: str, fields: str, items: str, problem: Column | None = None, indent: int = 2, run: str | None = None
) -> Read:
    """The items of pages, one page to a file, as ``read_records`` gives them, and with the same rejects.

    A page of which any part is no JSON is rejected as a whole, with the text around its items. ``run`` as there.
    """
    lines = _numbered(_lines(spark, path), items, indent)
    parts = lines.groupBy("file", "modified", "element").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("lines"))
    texts = parts.select("file", "modified", "element", F.array_join("lines.line", "\n").alias("text"))
    rest = texts.filter("element = 0").drop("element")
    found = _elements(texts.filter("element > 0"), fields, items)
    no_list = f"no {items}"

    # All items but the last are followed by a comma.
    commas = found.groupBy("file").agg(F.count_if(~F.col("comma")).alias("open"), F.max_by("comma", "element").alias("last"), F.bool_or(F.coalesce(F.col("_bad") == NOT_JSON, F.lit(False))).alias("bad"), F.bool_or(F.coalesce(F.col("_bad") == no_list, F.lit(False))).alias("other"))
    reason = F.when(F.expr("bad or open != 1 or last"), F.lit(NOT_JSON)).when(F.col("other"), F.lit(no_list))
    broken = commas.select("file", reason.alias("reason")).filter("reason is not null")
    around = parse_records(rest.filter(F.col("text").rlike(r"\S")), fields, items)
    broken = broken.union(around.filter(F.col("_bad") == NOT_JSON).select("file", F.lit(NOT_JSON))).groupBy("file").agg(F.max("reason").alias("reason"))
    good = found.drop("element", "comma").unionByName(around).join(broken, "file", "left_anti")
    whole = rest.join(broken, "file").withColumnRenamed("reason", "_bad")
    whole = whole.withColumn("record", F.lit(None).cast(good.schema["record"].dataType))
    return split(good.select("file", "text", "_bad", "modified", "record").unionByName(whole), problem, run)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``modified``, ``block``, ``at`` (follows the order within a block) and ``line``."""
    metadata = F.col("_metadata")
    return spark.read.text(path).select(
        metadata["file_path"].alias("file"), metadata["file_modification_time"].alias("modified"),
        metadata["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _numbered(lines: DataFrame, items: str, indent: int) -> DataFrame:
    """Adds ``element``, the number of the item that a line belongs to; 0 for lines around the items."""
    line = F.col("line")
    margin = " " * indent
    top = F.when(line.rlike(f"^{margin}[^ ]"), F.regexp_extract(line, f'^{margin}"([^"\\\\]*)": ?\\[$', 1))
    # An item is on one line, or between a line that opens and one that closes it.
    opens = line.rlike(f"^{margin * 2}[^ \\]}}]")
    closes = line.rlike(f"^{margin * 2}[\\]}}],?$") | (opens & ~line.rlike(f"^{margin * 2}[\\[{{]$"))
    marked = lines.withColumns({"top": top, "opens": opens.cast("int"), "closes": closes.cast("int")})

    last = F.max_by("top", F.when(F.col("top").isNotNull(), F.col("at")))
    blocks = marked.groupBy("file", "block").agg(last.alias("last"), F.sum("opens").alias("opened"), F.sum("closes").alias("closed"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "file", "block", F.last("last", ignorenulls=True).over(earlier).alias("before"),
        *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in ("opened", "closed")])
    inside = Window.partitionBy("file", "block").orderBy("at")
    so_far, until = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumns({
        "top": F.last("top", ignorenulls=True).over(so_far), "opens": F.sum("opens").over(so_far),
        "closes": F.coalesce(F.sum("closes").over(until), F.lit(0))}).join(blocks, ["file", "block"])
    opened, closed = F.col("opens") + F.col("opened"), F.col("closes") + F.col("closed")
    inner = (F.coalesce("top", "before") == items) & (opened > closed)
    return placed.select("file", "modified", "block", "at", "line", F.when(inner, opened).otherwise(0).alias("element"))


def _elements(texts: DataFrame, fields: str, items: str) -> DataFrame:
    """The items parsed, as ``parse_records`` does with a list, and whether a comma follows."""
    bare = F.regexp_replace("text", r"\s*,\s*$", "")
    cut = texts.withColumns({"comma": F.col("text").rlike(r",\s*$"), "text": bare})
    layout = struct_fields(fields)
    parsed = with_object(cut, "_parsed", F.col("text"), layout)
    known = [f for f in parsed.schema["_parsed"].dataType.names if not f.startswith("_end")]
    record = F.when(F.col("_parsed").isNotNull(), F.struct(*[F.col("_parsed")[f].alias(f) for f in known]))
    # A null is rejected alone; a list with other JSON that is no object is none that can be read.
    value = F.when(F.col("_parsed").isNull(), F.concat(F.lit('{"value": '), F.col("text"), F.lit("}")))
    parsed = with_object(parsed, "_value", value, "value: STRING")
    other = F.when(F.col("_value").isNotNull() & ~F.ltrim("text").startswith("{"), F.lit(f"no {items}")).otherwise(F.lit(NOT_JSON))
    none = F.trim("text") == "null"
    bad = F.when(F.col("_parsed").isNull(), F.when(none, F.lit(f"no object among {items}")).otherwise(other))
    return parsed.select(
        "file", F.coalesce(F.to_json(record), F.lit("null")).alias("text"), bad.alias("_bad"), "modified", record.alias("record"), "element", "comma")
