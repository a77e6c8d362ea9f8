"""Line de-duplication by overlapping three-line windows.

Every three consecutive lines of a document form a window. A window that occurs more than once
in the corpus stays at its first occurrence, by (doc_id, line number), and the lines that any later
occurrence covers are removed; overlapping occurrences merge because positions form a set.

Windows are hashed on the JVM inside an array expression, so no window function and no shuffle of
lines is needed; only (hash, document, position) rows of 16-byte hashes are exchanged. The table
of repeated windows is written out before it is joined, which lets adaptive execution split a hot
window over tasks. Places to remove go to the texts where they take little room; else both are shuffled.

Edge cases: a null text counts as empty and gives an empty text; documents of fewer than three
lines, and windows of lines without a character but spaces, are left alone; documents are told apart by id and text,
so repeated (id, text) rows are one document and get the same result; null ids sort first; an empty
table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import documents, forget, materialize, quoted, sent_if_small


def _identity(docs: DataFrame, id_col: str, text_col: str):
    """(text, id, key): columns that tell documents apart."""
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    return text, F.col(quoted(id_col)).cast("long").alias("_id"), F.xxhash64(text).alias("_key")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text, own, key = _identity(docs, id_col, text_col)
    return docs.select(own, key, F.split(text, "\n", -1).alias("_lines"))


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, pos, h1, h2): a 128-bit hash of each window that has a line with a character."""
    lines = _keyed(docs, id_col, text_col).where(F.size("_lines") >= 3)

    def window(first):
        a, b, c = (F.element_at("_lines", first + i) for i in (0, 1, 2))
        blank = F.length(F.trim(F.concat(a, b, c))) == 0
        return F.when(~blank, F.struct((first - 1).alias("pos"), F.xxhash64(a, b, c).alias("h1"), F.xxhash64(F.lit("w"), c, F.lit("\n"), a, b).alias("h2")))

    found = F.filter(F.transform(F.sequence(F.lit(1), F.size("_lines") - 2), window), lambda w: w.isNotNull())
    return lines.select("_id", "_key", F.explode(found).alias("w")).select("_id", "_key", "w.pos", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, _starts): positions of windows to remove, per document that has any."""
    found = materialize(windows(docs, id_col, text_col), "line-windows")
    place = F.struct("_id", "_key", "pos")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = materialize(repeated.where(~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first"), "line-repeats")
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = materialize(later.groupBy("_id", "_key").agg(F.collect_set("pos").alias("_starts")), "line-starts")
    forget(found, repeated)
    return starts


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", added: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """docs with the covered lines cut from the text, plus their numbers of lines and of removed lines (long) under
    the names added. Columns that have these names are replaced."""
    starts = covered_lines(docs, id_col, text_col)
    width = starts.agg(F.avg(F.size("_starts"))).first()[0] or 0
    # Ids, a list of places, and what a hash table adds.
    starts = sent_if_small(starts.withColumnsRenamed({"_id": "_sid", "_key": "_skey"}), int(64 + 8 * width))
    others = [c for c in docs.columns if c.lower() not in {a.lower() for a in added} or c == text_col]
    _, own, key = _identity(docs, id_col, text_col)
    keyed = docs.select(F.struct(*(F.col(quoted(c)) for c in others)).alias("_row"), own, key)
    both = keyed.join(starts, F.col("_id").eqNullSafe(F.col("_sid")) & (F.col("_key") == F.col("_skey")), "left")
    text = F.coalesce(F.col(f"_row.{quoted(text_col)}"), F.lit(""))
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda p: F.array(p, p + 1, p + 2))))
    both = both.select("_row", F.split(text, "\n", -1).alias("_lines"), gone.alias("_gone"))
    both = both.withColumn("_kept", F.when(F.col("_gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")))
    out = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(F.transform("_kept", lambda i: F.get("_lines", i)), "\n"))
    columns = [(out if c == text_col else F.col(f"_row.{quoted(c)}")).alias(c) for c in others]
    removed = F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone"))
    return both.select(*columns, F.size("_lines").cast("long").alias(added[0]), removed.cast("long").alias(added[1]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d),
w AS (SELECT doc_id, pos, line AS a, lead(line) OVER o AS b, lead(line, 2) OVER o AS c
      FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
v AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth
      FROM w WHERE c IS NOT NULL AND length(trim(a || b || c)) > 0),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM v, (SELECT unnest([0, 1, 2]) AS k) WHERE nth > 1)
SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
       coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
"""
