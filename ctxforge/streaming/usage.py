"""Live usage: running totals per session and tool, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxforge.functions.tokens import saved_percent
from ctxforge.operators import usage


def running_stats(requests: DataFrame) -> DataFrame:
    """Totals per session, for update or complete mode."""
    return usage.session_stats(requests)


def tumbling(requests: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _windowed(requests.withWatermark("ts", late), F.window("ts", width))


def sliding(requests: DataFrame, width: str = "2 hours", step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    return _windowed(requests.withWatermark("ts", late), F.window("ts", width, step))


def sessions(requests: DataFrame, gap: str = "6 hours", late: str = "2 hours") -> DataFrame:
    found = requests.withWatermark("ts", late).groupBy("session_id", F.session_window("ts", gap).alias("w"))
    sums = found.agg(F.count(F.lit(1)).alias("requests"), F.sum("saved").alias("saved"))
    return sums.select("session_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "saved")


def _windowed(requests: DataFrame, window) -> DataFrame:
    sums = requests.groupBy(window.alias("w"), "tool").agg(F.count(F.lit(1)).alias("requests"), F.sum("saved").alias("saved"), F.sum("original").alias("original"))
    return sums.select(F.col("w.start").alias("start"), "tool", "requests", "saved", saved_percent(F.col("original"), F.col("saved")).alias("saved_percent"))
