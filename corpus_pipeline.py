"""The corpus pipeline over `documents`: toxicity, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of docs, whatever
they are besides doc_id and text, so a stage can be run on any table of documents. Rows without doc_id can't be
found as copies or contaminated; they are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally.llm import decontaminate, near_dedup, packing, pii, toxicity
from pulltally.llm.scratch import Scratch
from pulltally.llm.shipping import ship_package
from pulltally.llm.tokens import public_tokenizer

#: Documents with at least this toxicity go.
TOXIC = 0.5


#: Up to this number (8 MB) of ids that go are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _without(docs: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs whose doc_id and text aren't among ids (doc_id, text_key). Rows without doc_id stay."""
    ids = ids.where("doc_id is not null").select(F.col("doc_id").alias("_left_out"), F.col("text_key").alias("_text_key")).distinct()
    ids = scratch.save(ids, "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    same = (docs["doc_id"] == side["_left_out"]) & (_text_key(docs) == side["_text_key"])
    return docs.join(side, same, "left_anti")


def _text_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the documents that `labels` marks and drops those that score as toxic.

    A text without any toxic term can't score as toxic for what it says, so it stays, however common toxic labels are.
    """
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    toxic = (F.col("score") >= TOXIC) & (F.col("n_segments") > 0)
    clean = toxicity.toxic_scores(docs, model).where(~toxic)
    return clean.select(*[F.col("kept")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near duplicates, in one row.

    Rows that repeat a doc_id are one document only where their texts are near duplicates (or, without words, equal);
    of those the row with the smallest text stays. Others of that id stay too.
    """
    ship_package(spark)
    classes = near_dedup.near_duplicate_classes(docs)
    scratch = Scratch(spark, "copies")
    classes = scratch.save(classes.select("doc_id", "text_key", "kept", "class"), "classes")
    kept = _without(docs, classes.where("not kept"), scratch)
    # Of kept rows that share doc_id and class one stays: each class has one id that is kept, so these are few.
    several = classes.where("kept and doc_id is not null").groupBy("doc_id", F.coalesce("class", "text_key").alias("class")).agg(F.count("*").alias("n"), F.collect_set("text_key").alias("keys"))
    several = scratch.save(several.where("n > 1").select("doc_id", "class", F.explode("keys").alias("text_key")), "repeated")
    if several.isEmpty():
        return kept
    named = several.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("class").alias("_class"))
    again = kept.join(named, (kept["doc_id"] == named["_id"]) & (_text_key(kept) == named["_key"]))
    row = F.struct(*[kept[c].alias(c) for c in docs.columns])
    first = again.groupBy("_id", "_class").agg(F.min_by(row, F.coalesce(kept["text"], F.lit(""))).alias("row"))
    return _without(kept, several, Scratch(spark, "repeated")).unionByName(first.select("row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of `benchmark`; null and empty texts hold none. A doc_id that repeats goes
    with all its rows where one of them holds an item; rows without doc_id stay. An empty benchmark drops nothing."""
    ship_package(spark)
    found = decontaminate.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    ids = Scratch(spark, "leaks").save(found.select(F.col("doc_id").alias("_left_out")).where("_left_out is not null").distinct(), "ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(side, docs["doc_id"] == side["_left_out"], "left_anti")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by marks; all else stays as it is: null texts null, every row (repeated ones too) and column."""
    ship_package(spark)
    found = pii.personal_data(docs)
    return found.select(*[(F.col("redacted") if c == "text" else F.col("kept")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences: one row per piece, with its ids and place. Each row counts, also one that repeats
    another; a null or empty text is a piece of its end id alone. Of an empty table there is no piece."""
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: Learned toxicity and tokenization can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
