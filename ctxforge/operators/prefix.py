"""Running sums in two levels: within blocks of a key, and over the blocks' totals, so that no key is one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_block(rows: DataFrame, key: str, block: Column, carried: DataFrame) -> DataFrame:
    """rows with a column _block, joined to carried (key, _block, ...), a row for each block; null keys meet null keys."""
    right = carried.withColumnsRenamed({key: "_ckey", "_block": "_cblock"})
    both = rows.join(right, F.col(key).eqNullSafe(F.col("_ckey")) & F.col("_block").eqNullSafe(F.col("_cblock")))
    return both.drop("_ckey", "_cblock")


def running(rows: DataFrame, key: str, block: Column, order: list, values: dict[str, Column], backwards: bool = False) -> DataFrame:
    """rows with, under each name, the sum of a value over the key's rows up to this one, in the order (backwards: from the end). block: of a
    row, monotone in the order; how many rows share one bounds what a task must hold of a key, besides a row for each block."""
    own = rows.withColumn("_block", block)
    ordered = [F.desc(c) if backwards else F.asc(c) for c in order]
    within = Window.partitionBy(key, "_block").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    totals = own.groupBy(key, "_block").agg(*(F.sum(v).alias(f"_{n}") for n, v in values.items()))
    before = Window.partitionBy(key).orderBy(F.desc("_block") if backwards else F.asc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(key, "_block", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in values))
    both = by_block(own.withColumns({n: F.sum(v).over(within) for n, v in values.items()}), key, block, carried)
    return both.withColumns({n: F.col(n) + F.col(f"_{n}") for n in values}).drop("_block", *(f"_{n}" for n in values))


def last_sum(rows: DataFrame, key: str, block: Column, order: list, value: str, n: int, name: str) -> DataFrame:
    """rows with the sum of a value over the key's last n rows up to this one. A block passes on its last n - 1 values, and n - 1 blocks
    before one have all that its first rows still need."""
    own = rows.withColumn("_block", block)
    within = Window.partitionBy(key, "_block").orderBy(*order)
    own = own.withColumns({"_place": F.row_number().over(within), "_sum": F.sum(value).over(within.rowsBetween(1 - n, 0))})
    from_end = Window.partitionBy(key, "_block").orderBy(*(F.desc(c) for c in order))
    ends = rows.withColumn("_block", block).withColumn("_back", F.row_number().over(from_end)).where(F.col("_back") < n)
    ends = ends.groupBy(key, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col("_back"), F.col(value).alias("v")))).alias("_end"))
    before = Window.partitionBy(key).orderBy(F.desc("_block")).rowsBetween(1, n - 1)
    # Latest first: blocks from the nearest on, and in each the last rows first.
    tails = F.transform(F.flatten(F.collect_list("_end").over(before)), lambda x: F.coalesce(x["v"], F.lit(0)))
    carried = ends.select(key, "_block", tails.alias("_tails"))
    both = by_block(own, key, block, carried)
    missing = F.greatest(F.lit(n) - F.col("_place"), F.lit(0))
    more = F.aggregate(F.slice("_tails", F.lit(1), missing), F.lit(0).cast("long"), lambda s, x: s + x)
    return both.withColumn(name, F.coalesce(F.col("_sum"), F.lit(0)) + more).drop("_block", "_place", "_sum", "_tails")
