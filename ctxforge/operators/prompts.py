"""Fenced blocks of prompts (prompt_id, prompt): their kind, and prompts with long blocks summarised.

Blocks are cut and summarised by the native log and source operators; putting the summaries back is an ordered
replacement of first occurrences, folded within the row; `$` marks in a summary act as in the replacements it matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxforge.functions.text import DOT, lines_of, replace_first, word
from ctxforge.functions.tokens import count_tokens
from ctxforge.operators import code, logs
from ctxforge.sources.scratch import written

# What a fenced block is.
FENCE = r"```([A-Za-z0-9_]*)\n([\s\S]*?)```"
# What makes a line look like a log's.
LOG_LINE = f"(?i){word('error|warn(?:ing)?|info|debug|fatal|stdout|stderr')}{DOT}*:"
TIME = r"\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}"
LEAST_LINES, LEAST_PERCENT = 30, 20


def looks_like_log(content: Column) -> Column:
    first = F.slice(lines_of(content), 1, 20)
    seen = F.size(F.filter(first, lambda x: x.rlike(LOG_LINE) | x.rlike(TIME)))
    return seen >= F.least(F.lit(3.0), F.size(first) * F.lit(0.3))


def blocks(prompts: DataFrame) -> DataFrame:
    """(prompt_id, place, lang, content, full, n_lines, kind)."""
    parts = F.arrays_zip(*(F.regexp_extract_all("prompt", F.lit(FENCE), F.lit(g)).alias(n) for g, n in enumerate(("full", "lang", "content"))))
    rows = prompts.select("prompt_id", F.posexplode(parts).alias("place", "b")).select("prompt_id", "place", "b.lang", "b.content", "b.full")
    return rows.withColumns({"n_lines": F.size(lines_of(F.col("content"))), "kind": F.when(looks_like_log(F.col("content")), "log").otherwise("code")})


def _summaries(long: DataFrame, parser=code.parse) -> DataFrame:
    """(prompt_id, place, summary, percent)."""
    key = F.struct("prompt_id", "place")
    as_log = logs.summarize(long.where("kind = 'log'").select(key.alias("log_id"), "content"))
    advice = F.when(F.size("actions") > 0, F.concat(F.lit("Recommended: "), F.array_join("actions", "; ")))
    head = F.concat(F.lit("[log compressed — "), F.col("status"), F.lit(", "), F.least("n_errors", F.lit(10)).cast("string"), F.lit(" errors, "), F.least("n_warnings", F.lit(10)).cast("string"), F.lit(" warnings]"))
    as_log = as_log.select("log_id.prompt_id", "log_id.place", F.concat_ws("\n", head, "compressed", advice).alias("summary"), F.col("tokens.saved_percent").alias("percent"))
    path = F.when(F.col("lang") == "", "file.ts").otherwise(F.concat(F.lit("file."), F.col("lang")))
    as_code = code.compress(long.where("kind = 'code'").select("prompt_id", "place", path.alias("path"), "content"), parser)
    names = lambda label, array: F.when(F.size(array) > 0, F.concat(F.lit(f"{label}: "), F.array_join(array, ", ")))
    symbols = F.transform("symbols", lambda s: F.concat(F.when(s["exported"], "export ").otherwise(""), F.when(F.coalesce(s["is_async"], F.lit(False)), "async ").otherwise(""), s["kind"], F.lit(" "), s["name"]))
    head = F.concat(F.lit("[code compressed — "), F.col("language"), F.lit(", "), F.size("symbols").cast("string"), F.lit(" symbols, "), F.col("tokens.saved_percent").cast("string"), F.lit("% saved]"))
    lines = F.concat_ws("\n", head, F.concat(F.lit("Purpose: "), F.col("purpose")), names("Imports", F.transform("imports", lambda i: i["source"])), names("Exports", F.col("exports")), names("Symbols", symbols))
    as_code = as_code.select("prompt_id", "place", lines.alias("summary"), F.col("tokens.saved_percent").alias("percent"))
    return as_log.unionByName(as_code)


def compress(prompts: DataFrame, parser=code.parse) -> DataFrame:
    """(prompt_id, compressed, saved_tokens); prompts that save nothing keep their text and 0. parser: as in code.compress()."""
    long = written(blocks(prompts).where(F.col("n_lines") >= LEAST_LINES), "long-blocks")  # read by three steps
    done = long.join(written(_summaries(long, parser), "block-summaries"), ["prompt_id", "place"]).where(F.col("percent") >= LEAST_PERCENT)
    swap = F.concat(F.lit("```"), F.col("lang"), F.lit("\n"), F.col("summary"), F.lit("\n```"))
    saved = F.greatest(count_tokens(F.col("content")) - count_tokens(F.col("summary")), F.lit(0).cast("long"))
    per = done.groupBy("prompt_id").agg(F.sort_array(F.collect_list(F.struct("place", "full", swap.alias("swap")))).alias("swaps"), F.sum(saved).alias("saved"))

    both = prompts.join(per, "prompt_id", "left")
    useful = F.coalesce("saved", F.lit(0)) > 0
    out = F.when(useful, F.aggregate("swaps", F.col("prompt"), lambda text, s: replace_first(text, s["full"], s["swap"]))).otherwise(F.col("prompt"))
    return both.select("prompt_id", out.alias("compressed"), F.when(useful, F.col("saved")).otherwise(0).cast("long").alias("saved_tokens"))
