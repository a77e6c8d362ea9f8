"""Usage over an endless history from partial sums: a batch adds its own requests, and reports read the sums, not old requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.functions.tokens import saved_percent
from ctxforge.sources import keyed

KEYS = ["day", "session_id", "tool"]
SUMS = ["requests", "original", "saved"]
#: Requests that a report lists.
RECENT = 20


def partial(requests: DataFrame) -> DataFrame:
    """Sums by day, session and tool."""
    day = F.to_date("ts").alias("day")
    return requests.groupBy(day, "session_id", "tool").agg(F.count(F.lit(1)).alias("requests"), F.sum("original").alias("original"), F.sum("saved").alias("saved"))


def keep_usage(path: str, buckets: int = 64, recent: int = RECENT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds requests (session_id, event_id, tool, ts, original, saved) to the sums under path and keeps the
    most recent ones. A batch that is run again counts once."""
    add = keyed.merge_into(f"{path}/sums", KEYS, keyed.sums(KEYS, SUMS), buckets)
    last = keyed.merge_into(f"{path}/recent", [], keyed.most_recent(recent, ["ts", "event_id"]))

    def write(batch: DataFrame, batch_id: int) -> None:
        add(partial(batch), batch_id)
        last(batch, batch_id)

    return write


def session_stats(sums: DataFrame) -> DataFrame:
    """Totals by session, from partial sums."""
    found = sums.groupBy("session_id").agg(F.sum("requests").alias("total_requests"), F.sum("original").alias("total_original"), F.sum("saved").alias("total_saved"))
    optimized = F.greatest(F.col("total_original") - F.col("total_saved"), F.lit(0).cast("long"))
    return found.withColumns({"total_optimized": optimized, "saved_percent": saved_percent(F.col("total_original"), F.col("total_saved"))})


def top_saving_tools(sums: DataFrame, n: int = 10) -> DataFrame:
    found = sums.groupBy("tool").agg(*(F.sum(c).alias(c) for c in SUMS))
    return found.where("saved > 0").orderBy(F.desc("saved"), "tool").limit(n)


def stats(spark: SparkSession, path: str, top: int = 10) -> DataFrame:
    """A report (section, session_id, tool, event_id, requests, original, saved): each session, its tools, the tools that saved most,
    all time, and the most recent requests."""
    sums, recent = keyed.read_table(spark, f"{path}/sums"), keyed.read_table(spark, f"{path}/recent")
    names = {"session_id": "long", "tool": "string", "event_id": "long"}

    def section(name: str, rows: DataFrame) -> DataFrame:
        columns = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in names.items()]
        return rows.select(F.lit(name).alias("section"), *columns, *SUMS)

    def by(*keys):
        return sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in SUMS))

    parts = [
        section("session", by("session_id")), section("usage", by("session_id", "tool")), section("top", top_saving_tools(sums, top)), section("all time", by()),
        section("recent", recent.withColumn("requests", F.lit(1).cast("long"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
