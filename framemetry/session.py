"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import zipfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Batch sizes for Arrow are left to the byte limit (spark.sql.execution.arrow.maxBytesPerBatch):
# one row may hold a whole frame, so a limit in rows alone would not bound memory.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # plans are built from many small expressions; recording a call site for each is costly
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A session for tests and local benchmarks; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("framemetry")
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, wherever they start; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="framemetry-"), "framemetry.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def pickled_by_value(module: str) -> None:
    """Send the code of a module along with what refers to it. The workers that plan data sources and state on
    the driver's side do not get the archive of ``ship``."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


_local_root: list[str] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh sub-folder of ``spark.checkpoint.dir``, the folder every executor can reach.

    Only a local session that names no such folder (a test) falls back to a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        if not _local_root:
            _local_root.append(tempfile.mkdtemp(prefix="framemetry-"))
        root = _local_root[0]
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and safe from lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
