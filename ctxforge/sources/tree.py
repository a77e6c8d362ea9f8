"""Source trees as a Spark data source: folders are the partitions, and executors list and filter the files below them.

The driver lists folders alone, level by level, until there are enough of them to deal out; a partition is either a folder with all
that lies below it or, for one that was opened on the driver, its own files. Extensions, test files and sizes are options of
the reader, so a file that is not wanted never becomes a row. Spark's own file index leaves out names that start with "_"."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "full_path string, path string, folder string, size_bytes long"
#: Folders that are enough to deal out, files of a batch.
FOLDERS, BATCH = 256, 4096


@dataclass
class Folder(InputPartition):
    path: str
    deep: bool


def entered(name: str, denied: frozenset[str]) -> bool:
    return name not in denied and not name.startswith(".")


def _entries(folder: str) -> list[os.DirEntry]:
    try:
        with os.scandir(folder) as found:
            return list(found)
    except OSError:
        return []


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.base = options["path"]
        self.extensions = frozenset(options.get("extensions", "").split())
        self.denied = frozenset(options.get("denied", "").split())
        self.skipped = options.get("skipped", "")
        self.most = int(options.get("maxbytes", str(2**62)))
        self.folders = int(options.get("folders", str(FOLDERS)))

    def partitions(self) -> list[Folder]:
        opened, level = [], [self.base]
        while level and len(opened) + len(level) < self.folders:
            opened += level
            level = [e.path for folder in level for e in _entries(folder) if e.is_dir(follow_symlinks=False) and entered(e.name, self.denied)]
        return [Folder(p, False) for p in opened] + [Folder(p, True) for p in level] or [Folder(self.base, False)]

    def _files(self, folder: str, deep: bool) -> Iterator[tuple]:
        import re

        skipped = re.compile(self.skipped) if self.skipped else None
        stack = [folder]
        while stack:
            own = stack.pop()
            for e in _entries(own):
                if e.is_dir(follow_symlinks=False):
                    if deep and entered(e.name, self.denied):
                        stack.append(e.path)
                elif e.is_file(follow_symlinks=False) and os.path.splitext(e.name)[1] in self.extensions and not (skipped and skipped.search(e.path)):
                    try:
                        size = e.stat().st_size
                    except OSError:
                        continue
                    if size <= self.most:
                        path = os.path.relpath(e.path, self.base)
                        yield e.path, path, os.path.dirname(path), size

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        names, held = ["full_path", "path", "folder", "size_bytes"], []
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        for row in self._files(partition.path, partition.deep):
            held.append(row)
            if len(held) == BATCH:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


class SourceTree(DataSource):
    """spark.read.format("source_tree").option("extensions", ".py .ts").load(folder); also denied (names of folders that are not
    entered), skipped (a pattern of full paths that are left out), maxBytes, folders."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})
