"""Token counts and savings as column expressions, and a pluggable exact counter."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ctxforge.functions.text import js_round


def count_tokens(text: Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, rounded up; null counts as empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def approx_tokens(text: Column) -> Column:
    """The coarser estimate used by write gates."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(3.5)).cast("long")


def tokens_of_bytes(size: Column) -> Column:
    return F.ceil(size / 4).cast("long")


def saved_percent(original: Column, saved: Column) -> Column:
    return F.when(original > 0, js_round(saved * 100 / original)).otherwise(F.lit(0)).cast("int")


def savings(original: Column, optimized: Column) -> Column:
    """struct<original, optimized, saved, saved_percent> of two token counts."""
    saved = F.greatest(original - optimized, F.lit(0).cast("long"))
    return F.struct(original.alias("original"), optimized.alias("optimized"), saved.alias("saved"), saved_percent(original, saved).alias("saved_percent"))


def text_savings(original: Column, optimized: Column) -> Column:
    return savings(count_tokens(original), count_tokens(optimized))


def json_tokens(value: Column) -> Column:
    return count_tokens(F.to_json(value))


def to_fixed(n: Column, unit: int) -> Column:
    """n / unit of a whole number n >= 0 with one decimal, as JavaScript's toFixed(1) writes the double: by its exact value, halves up."""
    below = F.floor(n.cast("long") * 10 / F.lit(unit)).cast("long")
    # Twenty times the double against the odd number between two tenths: the sum's rounding error is added back, so the sign is exact.
    x = n.cast("double") / F.lit(float(unit))
    large, small, middle = x * 16, x * 4, (2 * below + 1).cast("double")
    total = large + small
    tenths = below + F.when((total - middle) + (small - (total - large)) >= 0, 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))


def format_tokens(n: Column) -> Column:
    """999, 1.5k, 10.0k."""
    return F.when(n >= 1000, F.concat(to_fixed(n, 1000), F.lit("k"))).otherwise(n.cast("string"))


def format_millions(n: Column) -> Column:
    """As format_tokens, with 2.5M from a million on."""
    return F.when(n >= 1_000_000, F.concat(to_fixed(n, 1_000_000), F.lit("M"))).otherwise(format_tokens(n))


def time_saved_minutes(tokens: Column) -> Column:
    """One minute of reading for every 300 tokens."""
    return js_round(tokens / 300)


def ago_label(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(minutes.cast("string"), F.lit("m ago"))).otherwise(F.concat(hours.cast("string"), F.lit("h ago")))


def exact_counter(load: Callable[[], Callable[[str], int]]):
    """A column function that counts with a tokenizer; load() runs once for each task."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = load()
        for batch in batches:
            yield batch.map(lambda t: counter(t) if t else 0).astype("int64")

    return count


def register(spark: SparkSession) -> None:
    """count_tokens(text) for SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION count_tokens(text STRING) RETURNS BIGINT RETURN CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)")


def project_port(path: Column) -> Column:
    """7100 + h % 900, h: 32-bit hash of the path, h = (h * 33) xor character code, from 5381."""
    codes = F.transform(F.filter(F.split(path, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    mask = F.lit(0xFFFFFFFF).cast("long")
    h = F.aggregate(codes, F.lit(5381).cast("long"), lambda s, c: ((s * 33).bitwiseXOR(c)).bitwiseAND(mask))
    return (h % 900 + 7100).cast("int")
