"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where it is unset and driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder under it, removed with the driver's process."""
    path = f"{shared_dir(spark)}/ctxforge/{label}-{uuid.uuid4().hex}"
    local = path.removeprefix("file://")
    if local.startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside are removed when the writing ends, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table that is read again: steps that share it compute it once, and none depends on the executors that made it."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
