"""Conversation digests: (conv_id, turn, role, text) -> goals, done, pending, decisions, blockers, context."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxforge.functions.text import DOT, WS, js_trim
from ctxforge.functions.tokens import text_savings

#: Messages at the end of a conversation that are not summarised.
PRESERVE = 3


@dataclass(frozen=True)
class Cue:
    """A list of a digest: whose messages it reads, its patterns, and bounds on an entry's length."""

    name: str
    role: str | None
    patterns: tuple[str, ...]
    longer_than: int
    most: int


def _line(cues: str, separator: str = f"[:{WS}]+") -> str:
    return rf"(?i)(?:\A|\n)(?:{cues}){separator}({DOT}+?)(?:\n|\z)"


# The cues that open an entry.
CUES = (
    Cue("goals", "user", (_line("goal|objective|task|need|want|trying|please|could you|can you"), _line("i want to|i need to|i'm trying to|help me")), 10, 8),
    Cue(
        "completed", "assistant",
        (_line("✓|✅|done|completed?|finished?|created?|added?|fixed?|updated?"), _line("i've? (?:created?|added?|fixed?|updated?|implemented?)"), _line("successfully (?:created?|added?|fixed?|updated?)")),
        5, 10,
    ),
    Cue("pending", None, (_line("todo|to-do|pending|next step|still need|haven't"), _line(r"\[ \]|☐|○", f"[{WS}]+"), _line(r"- \[ \]", f"[{WS}]+")), 5, 10),
    Cue("decisions", None, (_line("decided?|chose?|using|will use|going with|opted for"), _line("the decision is|we'll|let's use|i'll use")), 10, 8),
    Cue("blockers", "user", (_line("error|blocked?|issue|problem|fail|broken"), _line("can't|cannot|doesn't work|not working|failed")), 5, 5),
)
# What is a path and a fenced block, and what is said where no goal was.
PATHS = r"(?:[A-Za-z0-9_@][A-Za-z0-9_./-]*/[A-Za-z0-9_./-]+|\.{1,2}/[A-Za-z0-9_./-]+)\.[a-z]{1,5}"
FENCES = rf"```[A-Za-z0-9_]*\n[\s\S]*?```"
NO_GOALS = "No explicit goals detected — see key context"


def window(messages: DataFrame, preserve: int = PRESERVE) -> DataFrame:
    """All but the last messages of each conversation."""
    if preserve <= 0:
        return messages
    from_end = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("_from_end", from_end).where(F.col("_from_end") > preserve).drop("_from_end")


def _entries(text: Column, cue: Cue) -> Column:
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in cue.patterns)))
    size = lambda x: F.length(x)
    return F.filter(F.transform(found, js_trim), lambda x: (size(x) > cue.longer_than) & (size(x) < 200))


def cue_list(messages: DataFrame, name: str) -> DataFrame:
    """(conv_id, place, entry): the first distinct entries of a list, in order."""
    return gathered(messages).select("conv_id", F.posexplode(name).alias("place", "entry"))


def gathered(messages: DataFrame) -> DataFrame:
    """(conv_id, one array per list, all_text) in one pass over the messages."""
    text = F.coalesce("text", F.lit(""))
    columns = {}
    for cue in CUES:
        own = _entries(text, cue)
        columns[cue.name] = F.when(F.col("role") == cue.role, own).otherwise(F.array().cast("array<string>")) if cue.role else own
    rows = messages.select("conv_id", F.struct("turn", text.alias("text"), *(c.alias(n) for n, c in columns.items())).alias("m"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    pick = lambda name: lambda m: m[name]
    lists = [F.slice(F.array_distinct(F.flatten(F.transform("ms", pick(c.name)))), 1, c.most).alias(c.name) for c in CUES]
    return rows.select("conv_id", *lists, F.array_join(F.transform("ms", lambda m: m["text"]), "\n").alias("all_text"))


def key_context(all_text: Column) -> Column:
    paths = F.slice(F.array_distinct(F.regexp_extract_all(all_text, F.lit(PATHS), F.lit(0))), 1, 10)
    blocks = F.regexp_count(all_text, F.lit(FENCES))
    parts = F.concat_ws(". ", F.when(F.size(paths) > 0, F.concat(F.lit("Files: "), F.array_join(paths, ", "))), F.when(blocks > 0, F.concat(F.lit("Code blocks: "), blocks.cast("string"))))
    return F.when(parts == "", "General conversation").otherwise(parts)


def contexts(messages: DataFrame) -> DataFrame:
    return gathered(messages).select("conv_id", key_context(F.col("all_text")).alias("key_context"))


def summarize(messages: DataFrame, preserve: int = PRESERVE) -> DataFrame:
    """One row per conversation."""
    text = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit("")))
    original = messages.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("line")))), lambda m: m["line"]), "\n\n").alias("original"))
    found = original.join(gathered(window(messages, preserve)), "conv_id", "left")
    found = found.withColumns({c.name: F.coalesce(c.name, F.array().cast("array<string>")) for c in CUES}).withColumn("key_context", key_context(F.coalesce("all_text", F.lit(""))))
    labels = {"goals": "Goals", "completed": "Done", "pending": "Pending", "decisions": "Decisions", "blockers": "Blockers"}
    lines = [F.when(F.size(n) > 0, F.concat(F.lit(f"{label}: "), F.array_join(n, "; "))) for n, label in labels.items()]
    compressed = F.concat_ws("\n", *lines, F.concat(F.lit("Context: "), F.col("key_context")))
    goals = F.when(F.size("goals") > 0, F.col("goals")).otherwise(F.array(F.lit(NO_GOALS)))
    return found.select("conv_id", goals.alias("goals"), *(c.name for c in CUES[1:]), "key_context", compressed.alias("compressed"), text_savings(F.col("original"), compressed).alias("tokens"))
