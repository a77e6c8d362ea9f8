"""Tables kept by key from the batches of a stream: hash buckets, of which a batch rewrites those that it touches.

Under a path lie data/v<batch>/kept_in=<bucket>/ and manifests/<batch>.json. A manifest names the folder of every bucket, and a batch
counts once its manifest has been renamed into place; a batch that is run again finds it and changes nothing, and one that was
stopped before writes its own folder anew. The number of buckets bounds what a batch reads besides its own rows, and the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Combine = Callable[[DataFrame], DataFrame]


def latest(keys: list[str], order: list[str]) -> Combine:
    """Of each key the row of the largest order; ties go to the largest row."""

    def combine(rows: DataFrame) -> DataFrame:
        row = F.struct(*rows.columns)
        return rows.groupBy(*keys).agg(F.max_by(row, F.struct(*order, row)).alias("r")).select("r.*")

    return combine


def sums(keys: list[str], columns: list[str]) -> Combine:
    """The sums of the columns by key."""
    return lambda rows: rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in columns))


def most_recent(n: int, order: list[str]) -> Combine:
    """The n rows of the largest order."""
    return lambda rows: rows.orderBy(*(F.desc(c) for c in order)).limit(n)


class _Files:
    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = path.rstrip("/")
        self.system = self.at("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        found = self.at(folder)
        return [s.getPath().getName() for s in self.system.listStatus(found)] if self.system.exists(found) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        self.system.delete(self.at(name + ".tmp"), True)
        stream = self.system.create(self.at(name + ".tmp"))
        stream.write(bytearray(text.encode()))
        stream.close()
        if not self.system.rename(self.at(name + ".tmp"), self.at(name)):
            raise OSError(f"{name} was written by another run")

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json"))


def merge_into(path: str, keys: list[str], combine: Combine, buckets: int = 64, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges batches into the table under path. combine: what becomes of rows of the same key; it must
    give the same rows for a + (b + c) as for (a + b) + c. Without keys there is one bucket. The last keep versions stay readable."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files = _Files(spark, path)
        versions = files.versions()
        if batch_id in versions:
            return
        before = [v for v in versions if v < batch_id]
        held = json.loads(files.read(f"manifests/{before[-1]}.json"))["buckets"] if before else {}
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)) if keys else F.lit(0).cast("long")
        # Written first: the batch may not be computed twice, and what it touches is to be known.
        own = f"{files.root}/incoming/v{batch_id}"
        combine(batch).withColumn("kept_in", bucket).write.mode("overwrite").parquet(own)
        new = spark.read.parquet(own)
        touched = [r[0] for r in new.select("kept_in").distinct().collect()]
        rows = new.drop("kept_in")
        old = [f"{files.root}/data/v{held[str(b)]}/kept_in={b}" for b in touched if str(b) in held]
        if old:
            rows = combine(spark.read.schema(rows.schema).parquet(*old).unionByName(rows))
        rows.withColumn("kept_in", bucket).repartition("kept_in").write.mode("overwrite").partitionBy("kept_in").parquet(f"{files.root}/data/v{batch_id}")
        manifest = {"schema": rows.schema.jsonValue(), "buckets": held | {str(b): batch_id for b in touched}}
        files.commit(f"manifests/{batch_id}.json", json.dumps(manifest))
        files.remove(f"incoming/v{batch_id}")
        _clean(files, keep)

    return write


def _clean(files: _Files, keep: int) -> None:
    """Remove manifests but the last, and folders of buckets that none of those names."""
    versions = files.versions()
    for v in versions[:-keep]:
        files.remove(f"manifests/{v}.json")
    used = {(v, b) for kept in versions[-keep:] for b, v in json.loads(files.read(f"manifests/{kept}.json"))["buckets"].items()}
    for name in files.names("data"):
        v, left = int(name[1:]), 0
        for b in files.names(f"data/{name}"):
            if b.startswith("kept_in="):
                if (v, b.removeprefix("kept_in=")) in used or v > versions[-1]:
                    left += 1
                else:
                    files.remove(f"data/{name}/{b}")
        if not left and v <= versions[-1]:
            files.remove(f"data/{name}")


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as of a version, the last one by default; None before the first batch."""
    files = _Files(spark, path)
    versions = [v for v in files.versions() if version is None or v <= version]
    if not versions:
        return None
    manifest = json.loads(files.read(f"manifests/{versions[-1]}.json"))
    schema = T.StructType.fromJson(manifest["schema"])
    folders = [f"{files.root}/data/v{v}/kept_in={b}" for b, v in manifest["buckets"].items()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
