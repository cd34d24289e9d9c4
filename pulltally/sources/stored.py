"""Tables kept in buckets by pull request, so that runs over them join and group without a shuffle.

Metrics, sizes, merge states and file lists all meet by repository and number. Stored once with the same number of
buckets, each bucket of one table meets the same bucket of the others, in every later run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally import schema


def store_by_key(
    df: DataFrame, table: str, buckets: int, path: str | None = None, on: Sequence[str] = schema.PR_KEY
) -> None:
    """Write ``df`` as the table ``table`` of the session's catalog, in buckets by ``on``; one of that name is replaced.

    Tables that are to meet without a shuffle need the same ``buckets``: about the size of the largest table over
    128 MB. Rows are dealt to their buckets before they are written, so a bucket is one file. Its rows are sorted by the key.
    ``path`` is the folder for the files, else the warehouse.
    """
    writer = df.repartition(buckets, *on).write.bucketBy(buckets, *on).sortBy(*on).format("parquet").mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def stored_by_key(spark: SparkSession, table: str) -> DataFrame:
    """A table that ``store_by_key`` wrote."""
    return spark.table(table)


def add_to_stored(spark: SparkSession, new: DataFrame, table: str, into: str, buckets: int, path: str | None = None, on: Sequence[str] = schema.PR_KEY) -> None:
    """Write ``table`` with ``new`` rows as the table ``into``; keys that are in both have the new rows.

    ``table`` is read where it lies, bucket by bucket; only the new rows are shuffled.
    """
    old = stored_by_key(spark, table)
    keys = new.select(*[F.col(name).alias(f"_{name}") for name in on]).distinct().repartition(buckets, *[f"_{name}" for name in on])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in on]
    kept = old.join(keys, same, "left_anti")
    store_by_key(kept.unionByName(new.select(*old.columns)), into, buckets, path, on)
