"""Column expressions that follow JavaScript's string rules where they differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that JavaScript's trim() and \s take for white space.
WS = r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: One character other than a line terminator.
DOT = r"[^\n\r\x{2028}\x{2029}]"


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def js_round(c: Column) -> Column:
    """Math.round: halves go up, also below zero."""
    return F.floor(c + F.lit(0.5)).cast("long")


def word(pattern: str) -> str:
    """A regular expression for whole ASCII words."""
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def first_n(array: Column, n: int) -> Column:
    return F.slice(array, 1, n)


def last_n(array: Column, n: int) -> Column:
    """The last n elements, or all of a shorter array."""
    return F.slice(array, F.greatest(F.size(array) - n, F.lit(0)) + 1, F.lit(n))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


#: Marks within a replacement: a dollar sign, what was found, what stands before it and what follows.
REPLACEMENT_MARK = r"\$[$&`']"


def replace_first(text: Column, found: Column, replacement: Column) -> Column:
    """text with the first occurrence of found replaced; marks in the replacement are filled in."""
    at = F.call_function("locate", found, text)
    before, after = F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(found))
    fill = lambda m: F.when(m == "$$", "$").when(m == "$&", found).when(m == "$`", before).otherwise(after)
    marks = F.transform(F.regexp_extract_all(replacement, F.lit(REPLACEMENT_MARK), F.lit(0)), fill)
    parts = F.zip_with(F.split(replacement, REPLACEMENT_MARK, -1), marks, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    return F.when(at > 0, F.concat(before, F.array_join(parts, ""), after)).otherwise(text)
