"""Readies a session: the package for the executors' Python workers, and Arrow batches of bounded size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import pulltally

#: Texts are long: batches of Spark's usual 10,000 rows would take much memory on both sides of the pipe.
BATCH_ROWS = 512
BATCH_BYTES = 8 << 20

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Adds a zip of this package to the application's Python files, once per application, and bounds Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(pulltally.__file__).parent
    archive = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(top.rglob("*.py")):
            out.write(path, path.relative_to(top.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
