"""Log compression: (log_id, content) -> unique errors and warnings with counts, and advice.

An error line takes the run of stack frames after it. That scan is a gaps-and-islands problem: lines that are
not frames number the islands, and within an island everything from its error line on is one block. Islands are
numbered in blocks of lines with a carry, so a long log is the work of many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxforge.functions.text import WS, js_trim, plural, word
from ctxforge.functions.tokens import text_savings
from ctxforge.operators.prefix import running

# The words that give a line its level, first match wins.
LEVELS = (("error", "error|err|fatal|exception|traceback|panic"), ("warn", "warn|warning"), ("info", "info|success|done|complete"), ("debug", "debug|trace|verbose"))
# What an error's lower-cased message is looked up for, in this order, and the advice.
ADVICE = (
    ("cannot find module|module not found|no such file", "Run `npm install` or check import paths"),
    ("permission denied|eacces", "Check file permissions"),
    ("econnrefused|connection refused", "Verify service is running and port is correct"),
    ("out of memory|heap|oom", "Increase Node.js heap with `--max-old-space-size`"),
    ("type error|typeerror", "Fix TypeScript type error — check function signatures"),
    ("syntax error", "Fix syntax error in source file"),
    ("timeout|timed out", "Check network/service availability or increase timeout"),
    ("undefined|null", "Add null check or verify data is populated before access"),
)
DEPRECATED = "Update deprecated APIs"
#: Frames that are kept and shown.
KEPT, SHOWN = 5, 3
#: Lines of a log that are scanned as one block.
BLOCK = 4096


def level(line: Column) -> Column:
    low = F.lower(line)
    out = F.lit(None).cast("string")
    for name, words in reversed(LEVELS):
        out = F.when(low.rlike(word(words)), name).otherwise(out)
    return out


def is_frame(line: Column) -> Column:
    return line.rlike(rf"\A(?:at[{WS}]+|File[{WS}]+\")")


def log_lines(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, line, level) of trimmed lines; blank lines stay, they end a run of frames."""
    split = logs.select("log_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "raw"))
    return split.select("log_id", "line_no", js_trim(F.col("raw")).alias("line")).withColumn("level", level(F.col("line")))


def log_blocks(logs: DataFrame) -> DataFrame:
    """(log_id, line_no, level, message, key): an error with its frames, or a warning."""
    block = F.floor(F.col("line_no") / BLOCK)
    marked = running(log_lines(logs), "log_id", block, ["line_no"], {"island": F.when(is_frame(F.col("line")), 0).otherwise(1)})
    island = Window.partitionBy("log_id", "island")
    start = F.min(F.when(F.col("level") == "error", F.col("line_no"))).over(island)
    blocks = marked.withColumn("start", start).where(((F.col("line_no") >= F.col("start"))) | (F.col("level") == "warn"))
    head = F.when(F.col("line_no") >= F.col("start"), F.col("start")).otherwise(F.col("line_no"))
    blocks = blocks.where(F.col("line_no") - head <= KEPT)  # an error's frames follow it line by line
    parts = blocks.groupBy("log_id", head.alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line", "level"))).alias("parts"))
    frames = F.transform(F.slice("parts", 2, KEPT), lambda p: p["line"])
    first = F.element_at("parts", 1)
    more = F.size("frames") - SHOWN
    message = F.concat(
        first["line"],
        F.when(F.size("frames") > 0, F.concat(F.lit("\n  "), F.array_join(F.slice("frames", 1, SHOWN), "\n  "))).otherwise(""),
        F.when(more > 0, F.concat(F.lit("\n  … ("), more.cast("string"), F.lit(" more frames)"))).otherwise(""),
    )
    found = parts.withColumn("frames", frames).select("log_id", "line_no", first["level"].alias("level"), message.alias("message"), first["line"].alias("line"))
    key = F.col("line")
    # What is taken out of a line before lines are compared.
    for pattern, mark in ((r"\d{4}-\d{2}-\d{2}T[\d:.Z+-]+", "<ts>"), ("0x[0-9a-fA-F]+", "<addr>"), (r":\d+", ":<n>"), (f"[{WS}]+", " ")):
        key = F.regexp_replace(key, pattern, mark)
    return found.withColumn("key", js_trim(F.lower(key))).drop("line")


def unique_entries(blocks: DataFrame) -> DataFrame:
    """(log_id, level, key, message, count, first_line): equal keys are one entry, the first message stays."""
    return blocks.groupBy("log_id", "level", "key").agg(F.min_by("message", "line_no").alias("message"), F.count(F.lit(1)).alias("count"), F.min("line_no").alias("first_line"))


def advice(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(None).cast("string")
    for pattern, text in reversed(ADVICE):
        out = F.when(low.rlike(pattern), text).otherwise(out)
    return out


def status(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("success")


def summarize(logs: DataFrame) -> DataFrame:
    """One row per log: status, n_errors, n_warnings, errors and warnings (the first ten), summary,
    actions, and the compressed text's savings."""
    entries = unique_entries(log_blocks(logs))
    rows = lambda name: F.sort_array(F.collect_list(F.when(F.col("level") == name, F.struct("first_line", "message", "count"))))
    per_log = entries.groupBy("log_id").agg(rows("error").alias("e"), rows("warn").alias("w"))
    found = logs.select("log_id", "content").join(per_log, "log_id", "left")
    empty = F.array().cast("array<struct<first_line:int,message:string,count:bigint>>")
    found = found.withColumns({k: F.coalesce(k, empty) for k in "ew"})
    n_e, n_w = F.size("e"), F.size("w")
    summary = F.concat_ws(
        ". ",
        F.concat(F.lit("Status: "), status(n_e, n_w)),
        F.when(n_e > 0, plural(n_e, "unique error")).otherwise("No errors"),
        F.when(n_w > 0, plural(n_w, "unique warning")).otherwise("No warnings"),
    )
    per_error = F.filter(F.transform(F.slice("e", 1, 5), lambda x: advice(x["message"])), lambda a: a.isNotNull())
    old = F.when(F.exists("w", lambda x: F.lower(x["message"]).contains("deprecated")), F.array(F.lit(DEPRECATED))).otherwise(F.array().cast("array<string>"))

    def shown(rows, label, width):
        times = lambda x: F.when(x["count"] > 1, F.concat(F.lit(" (×"), x["count"].cast("string"), F.lit(")"))).otherwise("")
        return F.transform(F.slice(rows, 1, 3), lambda x: F.concat(F.lit(f"{label}: "), F.substring(x["message"], 1, width), times(x)))

    found = found.withColumns({"summary": summary, "actions": F.slice(F.array_distinct(F.concat(per_error, old)), 1, 5)})
    compressed = F.array_join(F.concat(F.array("summary"), shown("e", "ERROR", 200), shown("w", "WARN", 150)), "\n")
    return found.select(
        "log_id", status(n_e, n_w).alias("status"), n_e.alias("n_errors"), n_w.alias("n_warnings"), F.slice("e", 1, 10).alias("errors"), F.slice("w", 1, 10).alias("warnings"),
        "summary", "actions", compressed.alias("compressed"), text_savings(F.col("content"), compressed).alias("tokens"),
    )


def recommendations(logs: DataFrame) -> DataFrame:
    """(log_id, place, action), in order."""
    return summarize(logs).select("log_id", F.posexplode("actions").alias("place", "action"))
