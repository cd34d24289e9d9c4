"""Stored JSON records, and the texts among them that cannot be used."""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally.functions.strict_json import struct_fields, with_object
from pulltally.session import materialize

NOT_JSON = "not JSON"
REJECTED = ("file", "text", "reason")


class Read(NamedTuple):
    """What a source gave: its rows, and the rejected texts (``file``, ``text``, ``reason``)."""

    rows: DataFrame
    rejected: DataFrame


def stored_texts(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """``file`` and ``text`` of each line, or with ``multi_line`` of each whole file; blank ones are left out.

    ``modified`` is the file's time, by which later exports of a record are told from earlier ones.
    """
    texts = spark.read.text(path, wholetext=multi_line)
    metadata = F.col("_metadata")
    columns = [metadata["file_path"].alias("file"), metadata["file_modification_time"].alias("modified"), F.col("value").alias("text")]
    folders = [name for name in texts.columns if name != "value"]
    return texts.select(*columns, *folders).filter(F.col("text").rlike(r"\S"))


def read_records(
    texts: DataFrame, fields: str, problem: Column | None = None, items: str | None = None, run: str | None = None
) -> Read:
    """Records of ``texts`` (``file``, ``text``; others stay), each a JSON object with these ``fields``.

    ``problem`` is a text, over the fields, for records that can't be used; null for good ones.
    ``items`` names a list that each text holds instead: its items are the records. With a ``run`` folder the texts
    are parsed once and stored there, so that using both rows and rejected texts reads the export once.
    """
    return split(parse_records(texts, fields, items), problem, run)


def parse_records(texts: DataFrame, fields: str, items: str | None = None) -> DataFrame:
    """``file``, ``text``, ``record`` and ``_bad`` (why it is none, or null) of each record; other columns stay."""
    kept = [name for name in texts.columns if name not in ("file", "text")]
    layout = struct_fields(fields)
    if items is None:
        parsed = with_object(texts, "record", F.col("text"), layout)
        parsed = parsed.withColumn("_bad", F.when(F.col("record").isNull(), F.lit(NOT_JSON)))
    else:
        stored = with_object(texts, "_page", F.col("text"), f"{items}: ARRAY<STRUCT<{layout}>>")
        listed = F.col("_page")[items]
        parsed = stored.select(
            "file", *kept, F.explode_outer(listed).alias("record"),
            F.when(listed.isNull(), F.col("text")).alias("text"),
            (F.col("_page").isNotNull() & (F.size(F.coalesce(listed, F.array())) == 0) & listed.isNotNull()).alias("_none"),
            F.when(F.col("_page").isNull(), F.lit(NOT_JSON)).when(listed.isNull(), F.lit(f"no {items}")).alias("_bad"))
        parsed = parsed.filter(~F.col("_none")).drop("_none").withColumns({
            "_bad": F.coalesce("_bad", F.when(F.col("record").isNull(), F.lit(f"no object among {items}"))),
            "text": F.coalesce("text", F.to_json("record"), F.lit("null"))})
    names = [name for name in parsed.select("record.*").columns if not name.startswith("_end")]
    record = F.when(F.col("record").isNotNull(), F.struct(*[F.col("record")[name].alias(name) for name in names]))
    return parsed.select("file", "text", "_bad", *kept, record.alias("record"))


def split(parsed: DataFrame, problem: Column | None = None, run: str | None = None) -> Read:
    """Good rows of ``parse_records``, and those that are rejected; parsed once and stored where there is a ``run`` folder."""
    reason = F.coalesce("_bad", problem) if problem is not None else F.col("_bad")
    kept = [name for name in parsed.columns if name != "record"]
    judged = parsed.select(*kept, "record.*").withColumn("reason", reason)
    if run is not None:
        judged = materialize(judged, f"records-{uuid.uuid4().hex}", run)
    good = judged.filter(F.col("reason").isNull()).drop("file", "text", "_bad", "reason")
    return Read(good, judged.filter(F.col("reason").isNotNull()).select(*REJECTED))


def decoded(address: Column) -> Column:
    """An address with its %XX turned back; a plus sign stays one."""
    return F.url_decode(F.replace(address, F.lit("+"), F.lit("%2B")))


def missing(**values: Column) -> Column:
    """A reason that names the missing values, or null."""
    names = [F.when(value.isNull(), F.lit(name)) for name, value in values.items()]
    found = F.concat_ws(", ", *names)
    return F.when(found != "", F.concat(F.lit("no "), found))
