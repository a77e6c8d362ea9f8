"""Exact de-duplication against a persistent digest index.

The index is a table of one row per digest, bucketed and sorted by digest. A batch of documents is
reduced to (digest, id) pairs, then to one row per digest; a sort-merge anti-join keeps the digests
the index lacks, which are appended under the batch's name. The index side of that join is not shuffled;
while a bucket has several files (one for each batch, until compact()) its rows are sorted again. Texts
themselves never enter a shuffle.

A batch may be run again, say after a job that was lost before its output was written: digests that the index
holds under the batch's own name count as new, so every run of a batch gives the same rows and the index grows
once. The caller names the batch: the same contents that arrive a second time, under another name, are duplicates.

Edge cases: a null text counts as empty; a null id sorts after every other id and can only be kept
when no copy has an id; repeated (id, text) rows count one each in group_size and exactly one of
them is kept; an empty batch gives no rows and leaves the index as it is; columns other than the
id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import SPACE, documents, fresh_path, materialize, quoted, shuffle_partitions

#: Copies of one row that are numbered from one array.
COPIES = 100_000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text after each run of white space became one space."""
    text = F.regexp_replace(F.coalesce(F.col(quoted(text_col)), F.lit("")), f"[{SPACE}]+", " ")
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far with the id that stays for each; survives as a bucketed, sorted table.

    With the same name and path a later run finds the index of an earlier one; without, it is a scratch table."""

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or shuffle_partitions(spark)

    def _write(self, groups: DataFrame, name: str, path: str) -> None:
        ordered = groups.select("digest", "keep_id", "n", "batch").repartition(self.buckets, "digest").sortWithinPartitions("digest")
        ordered.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)

    def append(self, groups: DataFrame) -> None:
        """Add (digest, keep_id, n, batch) rows whose digests are new."""
        self._write(groups, self.name, self.path)

    def table(self) -> DataFrame:
        if not self.spark.catalog.tableExists(self.name):
            self.append(self.spark.createDataFrame([], "digest binary, keep_id long, n long, batch string"))
        return self.spark.table(self.name)

    def compact(self) -> None:
        """Rewrite the index with one sorted file per bucket, beside the old files, and use the new ones."""
        name, path = f"{self.name}_{uuid.uuid4().hex[:8]}", f"{self.path.rstrip('/')}-{uuid.uuid4().hex[:8]}"
        self._write(self.table(), name, path)
        self.drop()
        self.spark.sql(f"ALTER TABLE {name} RENAME TO {self.name}")
        self.path = path

    def drop(self) -> None:
        """Take the index out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def dedup(self, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Deduplicate a batch and append it under its name. One row per document:
        doc_id, keep_id, group_size (copies in this batch), kept, text_sha256.

        A digest that another batch brought keeps that batch's id, so no copy of it is kept."""
        rows = materialize(digests(docs, id_col, text_col), "digests")
        # Grouped by digest and id first: a hot digest is spread over its ids.
        own = rows.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
        own = own.select("digest", F.col("doc_id").cast("long").alias("doc_id"), "times")
        groups = own.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("n"))
        groups = materialize(groups, "digest-groups")
        # One row per digest on either side.
        index = self.table().where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("known_id"), F.lit(True).alias("known"))
        found = materialize(groups.join(index.hint("merge"), "digest", "left"), "digest-found")
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        self.append(new.withColumn("batch", F.lit(batch)))
        keep = F.when(F.col("known"), F.col("known_id")).otherwise(F.col("keep_id"))
        found = found.select("digest", keep.alias("keep_id"), F.col("n").alias("group_size"), F.coalesce("known", F.lit(False)).alias("known"))
        # Copies are numbered in two steps, so that no array grows with their number.
        both = own.join(found, "digest").withColumn("from", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(COPIES))))
        copies = both.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, "times") - 1)))
        stays = ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)
        return copies.select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    found = index.dedup(documents(spark, sf_dir), "documents")
    index.drop()  # what was found is in tables of its own
    return found


OP10_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
