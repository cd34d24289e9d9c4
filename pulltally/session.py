"""Session settings and the shared folder that intermediate tables are written to."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

SETTINGS = {
    # Months, report dates and windows are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # First-n selections of up to ranking.SMALL_N rows are cut down before the shuffle.
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Add the settings the operators count on; cluster sizing stays with the caller."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def shared_folder(spark: SparkSession, folder: str | None = None) -> str:
    """``folder``, else the cluster's ``spark.checkpoint.dir``, else the session's own checkpoint folder.

    It must be one that all machines share, so none is made up where nothing is set.
    """
    if folder:
        return folder
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    raise ValueError(f"name a folder, or set {CHECKPOINT_DIR} to one that all machines share")


def run_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder for the tables of one run."""
    return f"{shared_folder(spark, folder).rstrip('/')}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, run: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Several sinks read the same per-PR metrics; without this each sink would
    scan all diffs again. The written table outlives lost executors and, being
    parquet, still gives column pruning.
    """
    spark = df.sparkSession
    path = f"{run or run_folder(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, run: str) -> None:
    """Remove the tables of a run; its DataFrames can't be read afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
