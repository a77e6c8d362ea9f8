"""Ranking of files (ord, path, content, size_bytes) against a query by its words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxforge.functions.text import basename, js_round, lines_of, word
from ctxforge.functions.tokens import count_tokens, tokens_of_bytes

# Words that a query's terms leave out.
STOP_WORDS = frozenset(
    "a an the is are was were be been being have has had do does did will would could should may might shall can "
    "of in to for on at by from with about into through and or but not this that it its".split()
)
MAX_BYTES = 100 * 1024


def query_terms(query: str) -> list[str]:
    """Terms in order, repeats kept."""
    return [w for w in re.sub(r"[^a-z0-9\s_-]", " ", query.lower()).split() if len(w) > 2 and w not in STOP_WORDS]


def score(files: DataFrame, query: str) -> DataFrame:
    """files with score, reasons."""
    path, content = F.lower("path"), F.coalesce("content", F.lit(""))
    low = F.lower(content)
    files = files.withColumns({"_path": path, "_name": basename(path), "_low": low, "_log": F.log2(F.size(lines_of(low)) + F.lit(2))})

    def judge(term: str) -> Column:
        # Terms hold letters, digits, _ and - only, so they stand for themselves in a pattern.
        in_path, in_name = F.col("_path").contains(term), F.col("_name").contains(term)
        seen = F.regexp_count("_low", F.lit(word(term)))
        declared = content.rlike(rf"(?i)export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+\w*{term}\w*|def\s+\w*{term}\w*|func\s+\w*{term}\w*")
        often = F.least(js_round(seen / F.col("_log") * 4), F.lit(20).cast("long")).cast("int")
        points = F.when(in_path, 10).otherwise(0) + F.when(in_name, 15).otherwise(0) + F.when(seen > 0, often).otherwise(0) + F.when(declared, 20).otherwise(0)
        notes = F.array(
            F.when(in_path, F.lit(f'Path contains "{term}"')),
            F.when(seen >= 3, F.concat(F.lit(f'"{term}" appears '), seen.cast("string"), F.lit("x"))),
            F.when(declared, F.lit(f'Exports symbol matching "{term}"')),
        )
        return F.struct(points.alias("points"), notes.alias("notes"))

    terms = query_terms(query)
    none = F.array().cast("array<struct<points:int,notes:array<string>>>")
    files = files.withColumn("_judged", F.array(*map(judge, terms)) if terms else none)
    total = F.aggregate("_judged", F.lit(0), lambda s, j: s + j["points"])
    total = total + F.when(F.col("path").rlike(r"index\.(ts|js|py)$"), 5).otherwise(0) + F.when(F.col("path").startswith("src/"), 3).otherwise(0)
    listed = F.array_distinct(F.filter(F.flatten(F.transform("_judged", lambda j: j["notes"])), lambda r: r.isNotNull()))
    return files.withColumns({"score": total.cast("int"), "reasons": listed}).drop("_path", "_name", "_low", "_log", "_judged")


def rank(files: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k best files with a positive score, ties in the listing's order."""
    small = files.where(F.col("size_bytes") <= MAX_BYTES)
    # The best k first, so that scores are computed once and not again for a filter below the sort.
    return score(small, query).orderBy(F.desc("score"), "ord").limit(k).where("score > 0").select("ord", "path", "score", "reasons")


def ranking_savings(files: DataFrame, query: str, k: int = 10) -> DataFrame:
    """Tokens of what was read against tokens of the ranking; the percentage may be negative."""
    small = files.where(F.col("size_bytes") <= MAX_BYTES)
    read = small.agg(F.coalesce(F.sum(tokens_of_bytes(F.col("size_bytes"))), F.lit(0)).alias("read"))
    line: Column = F.concat("path", F.lit(": "), F.array_join("reasons", ", "))
    shown = rank(files, query, k).agg(F.array_join(F.collect_list(line), "\n").alias("shown"))
    both = read.crossJoin(shown)  # one row each
    original, optimized = F.col("read") + (len(query) + 3) // 4, count_tokens(F.col("shown"))
    percent = F.when(original > 0, js_round((original - optimized) * 100 / original)).otherwise(0).cast("int")
    return both.select(original.cast("long").alias("original"), optimized.alias("optimized"), F.greatest(original - optimized, F.lit(0)).cast("long").alias("saved"), percent.alias("saved_percent"))
