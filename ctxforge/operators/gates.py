"""Decisions about tool events: block, shorten or pass a read, a command's output or a write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxforge.functions.text import basename, last_n, lines_of
from ctxforge.functions.tokens import count_tokens, savings, text_savings

# Extensions of files whose reads may be replaced by a skeleton.
READ_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "cpp", "c", "h", "cs", "rb", "php", "swift", "kt", "scala", "vue", "svelte")


@dataclass(frozen=True)
class ReadLimits:
    lines: int = 100
    percent: int = 15


@dataclass(frozen=True)
class OutputLimits:
    tokens: int = 200
    head: int = 40
    tail: int = 15
    slack: int = 5
    percent: int = 15


def read_decision(tool: Column, path: Column, targeted: Column, content: Column, percent: Column, limits: ReadLimits = ReadLimits()) -> Column:
    """'skip' for other tools, 'block' where a skeleton saves enough of a whole read of code, else 'pass'."""
    name = basename(path)
    extension = F.when(name.rlike(r"^.+\.[^.]*$"), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    enough = (F.size(lines_of(content)) >= limits.lines) & (percent >= limits.percent)
    return F.when(tool != "Read", "skip").when(~targeted & extension.isin(*READ_EXTENSIONS) & enough, "block").otherwise("pass")


def response_text(response: Column) -> Column:
    """Text of a JSON tool response: a string, or its output, or the joined text parts of its content."""
    parts = F.from_json(F.get_json_object(response, "$.content"), "array<struct<type:string,text:string>>")
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: F.coalesce(p["text"], F.lit(""))), "")
    is_object = F.ltrim(response).startswith("{")
    plain = F.from_json(F.concat(F.lit('{"v":'), response, F.lit("}")), "v string")["v"]
    return F.when(~is_object, F.coalesce(plain, F.lit(""))).otherwise(F.coalesce(F.get_json_object(response, "$.output"), joined, F.lit("")))


def head_tail(text: Column, limits: OutputLimits = OutputLimits()) -> Column:
    """The first and last lines around a note on what was left out; shorter texts as they are."""
    lines = lines_of(text)
    n = F.size(lines)
    middle = F.slice(lines, F.lit(limits.head + 1), F.greatest(n - limits.head - limits.tail, F.lit(0)))
    note = F.concat(
        F.lit("\n── output shortened ──\n  "), (n - limits.head - limits.tail).cast("string"), F.lit(" lines / ~"),
        count_tokens(F.array_join(middle, "\n")).cast("string"), F.lit(" tokens omitted from middle\n──\n"),
    )
    short = F.array_join(F.concat(F.slice(lines, 1, limits.head), F.array(note), last_n(lines, limits.tail)), "\n")
    return F.when(n <= limits.head + limits.tail + limits.slack, text).otherwise(short)


def unless_opted_out(decision: Column, opted_out: Column) -> Column:
    """A decision, or 'skip' for events whose caller turned gates off."""
    return F.when(F.coalesce(opted_out, F.lit(False)), "skip").otherwise(decision)


def output_decision(tool: Column, text: Column, limits: OutputLimits = OutputLimits()) -> Column:
    saved = text_savings(text, head_tail(text, limits))["saved_percent"]
    return F.when((tool != "Bash") | (text == ""), "skip").when((count_tokens(text) >= limits.tokens) & (saved >= limits.percent), "shorten").otherwise("pass")


def edit_savings(is_write: Column, file: Column, old: Column, new: Column) -> Column:
    """What an edit costs against writing the whole file; a write saves nothing; null for incomplete edits."""
    whole, edit = count_tokens(file), count_tokens(old) + count_tokens(new)
    return F.when(is_write, savings(whole, whole)).when((old != "") & (new != ""), savings(F.when(file != "", whole).otherwise(edit), edit))
