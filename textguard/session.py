"""Sends the package to the Python workers."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()

#: Arrow batches are bounded by bytes, so that long texts don't make large ones; a value that the session has stays.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "4000"}


def ship(spark: SparkSession) -> SparkSession:
    """Adds a zip of the package to the application once, so that workers on any machine can import it."""
    sc = spark.sparkContext
    for key, value in BATCH.items():
        if not sc.getConf().contains(key):
            spark.conf.set(key, value)
    if sc.applicationId not in _SENT:
        root = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as folder:
            at = Path(folder, "src", root.name)
            shutil.copytree(root, at, ignore=shutil.ignore_patterns("__pycache__"))
            name = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="textguard-"), "textguard")), "zip", at.parent)
        sc.addPyFile(name)
        _SENT.add(sc.applicationId)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Small inputs over all cores: a file of one row group comes to one task, however many the scan has. Inputs of
    more than a split a core stay as they are read."""
    sc = df.sparkSession.sparkContext
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(sc.defaultParallelism) if size < sc.defaultParallelism << 27 else df


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir); a temporary one only in local mode
    without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="textguard-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/{label}-{uuid.uuid4().hex}"
