"""Scanning source trees: executors list the folders and read the contents; the driver sees folder names alone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.sources.tree import SourceTree

# Folders that are not entered (any other that starts with a dot is left out too).
DENIED = frozenset("node_modules .git dist build .next .nuxt coverage .cache __pycache__ .pytest_cache vendor .turbo .parcel-cache".split())
DENIED_RELEVANCE = frozenset("node_modules .git dist build .next coverage __pycache__ .cache vendor".split())
# Extensions of source files, case counts.
EXTENSIONS = frozenset(".ts .tsx .js .jsx .mjs .cjs .py .rs .go .java .kt .swift .rb .php .cpp .cc .c .h".split())
RELEVANCE_EXTENSIONS = frozenset(".ts .tsx .js .jsx .py .go .rs".split())
TESTS = re.compile(r"\.(test|spec)\.|__tests__|_test\.|tests/")
DIRECTORY_BYTES, RELEVANCE_BYTES = 200 * 1024, 100 * 1024


#: Stands between folders in the order of a listing: depth first, by name, files among folders.
_BELOW = "\0"


def _place(path: str):
    return F.replace(F.col(path), F.lit("/"), F.lit(_BELOW))


def list_tree(
    spark: SparkSession, base: str, extensions: frozenset[str] = EXTENSIONS, denied: frozenset[str] = DENIED, include_tests: bool = False, most: int | None = 100, soft: bool = False, max_bytes: int | None = None
) -> DataFrame:
    """(ord, full_path, path, size_bytes), depth first in name order; ord grows along the listing. At most the given number of files,
    of which those that are too large (max_bytes) are then left out. A soft limit only keeps further folders from being entered: the
    files of one that was entered are all listed. Folders are listed on the executors."""
    spark.dataSource.register(SourceTree)
    reader = spark.read.format("source_tree").option("extensions", " ".join(sorted(extensions))).option("denied", " ".join(sorted(denied)))
    if not include_tests:
        reader = reader.option("skipped", TESTS.pattern)
    if most is None and max_bytes is not None:
        reader = reader.option("maxBytes", max_bytes)
    files = reader.load(base)
    if most is not None and not soft:
        files = files.orderBy(_place("path")).limit(most)
    elif most is not None:
        # A folder is entered while fewer files were found: if it stands before the last of that many.
        last = files.orderBy(_place("path")).limit(most).agg(F.max(_place("path")), F.count(F.lit(1))).first()
        if last[1] == most:
            files = files.where((F.col("folder") == "") | (_place("folder") < F.lit(last[0])))
    listed = files.orderBy(_place("path")).select(F.monotonically_increasing_id().alias("ord"), "full_path", "path", "size_bytes")
    return listed.where(F.col("size_bytes") <= max_bytes) if max_bytes is not None else listed


def read_tree(spark: SparkSession, base: str, max_bytes: int = DIRECTORY_BYTES, **options) -> DataFrame:
    """(ord, full_path, path, size_bytes, content) of a tree; files that are too large or unreadable have no row."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with open(row["full_path"], encoding="utf-8", errors="replace", newline="") as file:
                        content = file.read()
                except OSError:
                    continue
                yield pa.record_batch([*(pa.array([row[n]], batch.schema.field(n).type) for n in batch.schema.names), pa.array([content], pa.string())], [*batch.schema.names, "content"])

    schema = "ord long, full_path string, path string, size_bytes long, content string"
    return list_tree(spark, base, max_bytes=max_bytes, **options).mapInArrow(read, schema)


def read_for_relevance(spark: SparkSession, base: str, extensions: frozenset[str] = RELEVANCE_EXTENSIONS, most: int = 500) -> DataFrame:
    """The files that relevance ranking looks at: fewer kinds, smaller ones, tests too, and a soft limit."""
    return read_tree(spark, base, RELEVANCE_BYTES, extensions=extensions, denied=DENIED_RELEVANCE, include_tests=True, most=most, soft=True)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).toDF("content")
