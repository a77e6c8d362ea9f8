"""Awkward documents: nulls, empty and long texts, ties, repeated rows, columns whose names operators use."""

LONG = "lorem ipsum dolor " * 4000
ROWS = [
    (0, "a b c\nd e f\ng h i", "en"), (1, "a b c\nd e f\ng h i", "en"), (2, None, None), (3, "", "en"), (4, "   ", "en"), (5, LONG, "xx"), (6, LONG, "xx"),
    (7, "token = 'abcdefghijkl'", "en"), (7, "token = 'abcdefghijkl'", "en"), (8, "ünï çödé 😀 <|endoftext|> </s>[INST]", None), (9, "1234 !!", "en"), (None, "an orphan without id", "en"), (10, "x", "en"),
]
SCHEMA = "doc_id long, text string, lang string"


def documents(spark, rows=None):
    """With columns that clash with names inside the operators."""
    frame = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    from pyspark.sql import functions as F

    names = ("a.b", "n_lines", "n_removed", "_starts", "_sid", "_i", "_m", "_number", "mark", "times", "from", "copy", "component_id", "tick`ed", "digest", "_id", "_key", "_lines", "_found", "_stays", "rep", "label", "key", "wide", "score", "found", "kept")
    return frame.select("*", *(F.lit(7).alias(n) for n in names))


def empty(spark):
    return documents(spark, [])
