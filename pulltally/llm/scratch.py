"""Intermediate tables, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_made: list[tuple[str, str]] = []  # application and folder


class Scratch:
    """A new folder below `spark.checkpoint.dir`; each saved table cuts the lineage.

    The tables outlive the call, as results are read from them lazily; `discard` removes them. Where the setting is
    missing, the session's checkpoint folder is used, and on a purely local session a temporary one.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        top = spark.conf.get(CHECKPOINT_DIR, None)
        if not top:
            own = spark.sparkContext._jsc.sc().getCheckpointDir()
            top = own.get() if own.isDefined() else None
        if not top:
            if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
                raise ValueError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="llm-")
        self.spark = spark
        self.path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        _made.append((spark.sparkContext.applicationId, self.path))

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> None:
    """Removes the tables that operators have stored in this application; results that come from them can't be read afterwards."""
    for made in [m for m in _made if m[0] == spark.sparkContext.applicationId]:
        path = spark._jvm.org.apache.hadoop.fs.Path(made[1])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _made.remove(made)
