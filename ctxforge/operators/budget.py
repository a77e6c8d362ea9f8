"""Context budgets: (budget_id, ord, name, content, priority) items against a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxforge.functions.text import js_round
from ctxforge.functions.tokens import count_tokens, saved_percent

# Share of an item's tokens that compression leaves, and the models' windows.
RATIOS = {"critical": 0.9, "high": 0.6, "medium": 0.3, "low": 0.1}
WINDOWS = {"gpt-4": 128_000, "gpt-3.5": 16_385, "claude-3": 200_000, "claude-2": 100_000, "claude-haiku": 200_000, "custom": 128_000}
DEFAULT_WINDOW = 128_000


def breakdown(items: DataFrame) -> DataFrame:
    ratio = F.lit(None).cast("double")
    for name, share in RATIOS.items():
        ratio = F.when(F.col("priority") == name, F.lit(share)).otherwise(ratio)
    counted = items.withColumn("original_tokens", count_tokens(F.col("content")))
    return counted.withColumn("optimized_tokens", js_round(F.col("original_tokens") * ratio)).drop("content")


def totals(parts: DataFrame) -> DataFrame:
    sums = parts.groupBy("budget_id").agg(F.sum("original_tokens").alias("original_tokens"), F.sum("optimized_tokens").alias("optimized_tokens"))
    saved = F.greatest(F.col("original_tokens") - F.col("optimized_tokens"), F.lit(0).cast("long"))
    sums = sums.withColumn("saved_tokens", saved)
    return sums.withColumn("saved_percent", saved_percent(F.col("original_tokens"), F.col("saved_tokens")))


def _names(priority: str) -> Column:
    some = F.sort_array(F.collect_list(F.when(F.col("priority") == priority, F.struct("ord", "name"))))
    return F.array_join(F.transform(some, lambda x: x["name"]), ", ").alias(f"{priority}_names")


def recommendations(parts: DataFrame, budget: int = 8000, model: str = "claude-3") -> DataFrame:
    window = WINDOWS.get(model, DEFAULT_WINDOW)
    sums = parts.groupBy("budget_id").agg(F.sum("original_tokens").alias("o"), F.sum("optimized_tokens").alias("p"), _names("low"), _names("medium"))
    number = lambda c: F.format_number(c, 0)
    used = js_round(F.col("p") * 100 / budget).cast("string")
    # The sentences.
    fits = F.concat(F.lit("Context fits within budget after optimization. Using "), used, F.lit(f"% of {budget:,} token budget. Safe to proceed."))
    over = F.concat_ws(
        " ",
        F.concat(F.lit("Over budget by "), number(F.col("p") - budget), F.lit(" tokens.")),
        F.when(F.col("low_names") != "", F.concat(F.lit("Remove low-priority items ("), F.col("low_names"), F.lit(") to free space."))),
        F.when(F.col("medium_names") != "", F.concat(F.lit("Compress medium-priority items ("), F.col("medium_names"), F.lit(")."))),
        F.when(F.col("o") <= window, F.lit(f"Full context fits in {budget:,} window — consider increasing budget.")).otherwise(
            F.lit(f"Total exceeds model context window of {window:,} tokens — significant pruning needed.")
        ),
    )
    return sums.select("budget_id", F.when(F.col("p") <= budget, fits).otherwise(over).alias("recommendation"))
