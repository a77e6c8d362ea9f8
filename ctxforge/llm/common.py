"""Shared pieces: intermediate tables in the cluster's shared folder, Arrow settings, word rules."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import sys
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as every contract of this subpackage reads it.
SPACE = "\\x20\\x09-\\x0D"
#: Bytes of a table that may be broadcast to a join.
SENT_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where both are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/ctxforge/{label}-{uuid.uuid4().hex}"
    local = path.removeprefix("file://")
    if local.startswith("/"):
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later stages do not depend on
    the executors that made it, and its partitioning is forgotten, so that joins on it can be
    split by adaptive execution where a key is hot. Its shuffle files go when it is written."""
    path = fresh_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def forget(*tables: DataFrame) -> None:
    """Delete what materialize() wrote for tables that nothing will read again."""
    for table in tables:
        jvm, session = table.sparkSession._jvm, table.sparkSession._jsparkSession
        path = jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of what is written inside are removed when the writing ends, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds at once when texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(column, mod: int):
    """crc32 of an id written as text, modulo mod."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def free_name(df: DataFrame, name: str) -> str:
    """name, or one that starts with it and is no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as SQL reads it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def all_columns(df: DataFrame) -> list:
    return [F.col(quoted(c)) for c in df.columns]


def sent_if_small(table: DataFrame, row_bytes: int, most: int = SENT_BYTES) -> DataFrame:
    """table with a broadcast hint if its rows, counted, take at most that many bytes; else as it is, to be shuffled."""
    return F.broadcast(table) if table.count() * row_bytes <= most else table


def per_worker(key: tuple, make):
    """make(), kept for later tasks of the same Python worker. Functions reach workers by value, so a global
    of this package would be new in each task; a module of its own in sys.modules is not."""
    held = sys.modules.setdefault("_ctxforge_worker", types.ModuleType("_ctxforge_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def give_back() -> None:
    """Return memory that this Python worker has freed to the system: a worker lives on for later stages, and what its
    allocator keeps would count beside theirs. Nothing happens where the C library has no such call."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
