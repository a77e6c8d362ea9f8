"""Usage analytics over request records: (session_id, tool, ts, event_id, original, saved)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctxforge.functions.tokens import saved_percent
from ctxforge.operators.prefix import last_sum, running

#: Requests that a session remembers.
HISTORY = 10_000


def _latest_first():
    return Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("event_id"))


def session_stats(requests: DataFrame) -> DataFrame:
    sums = requests.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_requests"), F.sum("original").alias("total_original"), F.sum("saved").alias("total_saved"), F.min("ts").alias("started_at")
    )
    optimized = F.greatest(F.col("total_original") - F.col("total_saved"), F.lit(0).cast("long"))
    return sums.withColumns({"total_optimized": optimized, "saved_percent": saved_percent(F.col("total_original"), F.col("total_saved"))})


def tool_usage(requests: DataFrame) -> DataFrame:
    return requests.groupBy("session_id", "tool").agg(F.count(F.lit(1)).alias("calls"))


def tool_usage_map(requests: DataFrame) -> DataFrame:
    """One row per session with a map from tool to calls."""
    pairs = F.collect_list(F.struct("tool", "calls"))
    return tool_usage(requests).groupBy("session_id").agg(F.map_from_entries(F.sort_array(pairs)).alias("tool_usage"))


def top_saving_tools(requests: DataFrame, n: int = 5) -> DataFrame:
    sums = requests.groupBy("tool").agg(F.sum("saved").alias("saved_tokens"), F.sum("original").alias("original_tokens"))
    return sums.where("saved_tokens > 0").orderBy(F.desc("saved_tokens"), "tool").limit(n)


def all_time_saved(requests: DataFrame) -> DataFrame:
    return requests.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("all_time_saved"))


def recent_activity(requests: DataFrame, n: int = 20) -> DataFrame:
    ranked = requests.withColumn("position", F.row_number().over(_latest_first())).where(F.col("position") <= n)
    return ranked.withColumn("saved_percent", saved_percent(F.col("original"), F.col("saved")))


def last_request(requests: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("event_id", "tool", "original", "saved"), F.struct("ts", "event_id"))
    return requests.groupBy("session_id").agg(latest.alias("r")).select("session_id", "r.*")


#: Rows of a session are scanned by blocks of this width of time.
BLOCK = "day"


def _block():
    return F.date_trunc(BLOCK, F.col("ts").cast("timestamp"))


def ring_buffer(requests: DataFrame, keep: int = HISTORY) -> DataFrame:
    """The records that a session still holds; age: 1 for the latest."""
    return running(requests, "session_id", _block(), ["ts", "event_id"], {"age": F.lit(1)}, backwards=True).where(F.col("age") <= keep)


def tool_share(requests: DataFrame) -> DataFrame:
    """Calls and share of all savings for each tool that saved anything."""
    sums = requests.groupBy("tool").agg(F.count(F.lit(1)).alias("calls"), F.sum("saved").alias("saved_tokens")).where("saved_tokens > 0")
    total = F.sum("saved_tokens").over(Window.partitionBy())  # a row for each tool
    return sums.withColumn("share_percent", saved_percent(total, F.col("saved_tokens")))


def spark_series(requests: DataFrame, points: int = 20) -> DataFrame:
    """Running totals of a session and the sum over its last points."""
    order = ["ts", "event_id"]
    out = running(requests, "session_id", _block(), order, {"running_saved": F.col("saved"), "running_original": F.col("original"), "requests": F.lit(1)})
    out = last_sum(out, "session_id", _block(), order, "saved", points, "window_saved")
    return out.withColumn("running_percent", saved_percent(F.col("running_original"), F.col("running_saved")))


def register_projects(visits: DataFrame) -> DataFrame:
    """(project_id, path, ts) -> first and last visit, number of sessions; the latest path wins."""
    return visits.groupBy("project_id").agg(F.min("ts").alias("registered_at"), F.max("ts").alias("last_seen_at"), F.count(F.lit(1)).alias("session_count"), F.max_by("path", "ts").alias("path"))


def project_totals(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Savings go to the latest session of the request's project, and sum up by project."""
    latest = sessions.groupBy("project_id").agg(F.max_by("session_id", F.struct("last_activity", "session_id")).alias("latest_session"))
    sums = requests.groupBy("project_id").agg(F.sum("saved").alias("total_saved"), F.count(F.lit(1)).alias("requests"))
    return sums.join(latest, "project_id", "left")


def credit_sessions(sessions: DataFrame, savings: DataFrame) -> DataFrame:
    """sessions (session_id, project_id, last_activity, saved) with savings (project_id, saved, ts) added to the latest session
    of each project, which is renewed; savings of nothing, and of projects without a session, change nothing."""
    sums = savings.where("saved > 0").groupBy("project_id").agg(F.sum("saved").alias("_saved"), F.max("ts").alias("_ts"))
    latest = sessions.groupBy("project_id").agg(F.max_by("session_id", F.struct("last_activity", "session_id")).alias("_latest"))
    both = sessions.join(latest.join(sums, "project_id"), "project_id", "left")
    own = F.col("_latest").eqNullSafe(F.col("session_id"))
    changed = both.withColumns({"saved": F.when(own, F.col("saved") + F.col("_saved")).otherwise(F.col("saved")), "last_activity": F.when(own, F.greatest("last_activity", "_ts")).otherwise(F.col("last_activity"))})
    return changed.select(*sessions.columns)


def since_reset(requests: DataFrame, resets: DataFrame) -> DataFrame:
    """The requests that count after the last reset, resets (session_id, ts), of their session."""
    last = resets.groupBy("session_id").agg(F.max("ts").alias("_reset"))
    return requests.join(last, "session_id", "left").where(F.col("_reset").isNull() | (F.col("ts") > F.col("_reset"))).select(*requests.columns)


def unexpired(entries: DataFrame, now, ttl_ms: int = 300_000) -> DataFrame:
    """entries (key, value, set_at) that a cache still holds: the last value of each key, while it is younger than its life."""
    last = entries.groupBy("key").agg(F.max_by(F.struct("value", "set_at"), "set_at").alias("e")).select("key", "e.*")
    return last.where(F.unix_millis(F.lit(now).cast("timestamp")) <= F.unix_millis("set_at") + ttl_ms)


def usage_report(requests: DataFrame, n: int = 5, activity: int = 20) -> dict[str, DataFrame]:
    """The tables of a usage report: totals and calls of each session, top saving tools, the last request and the last few."""
    return {
        "session": session_stats(requests), "usage": tool_usage(requests), "top": top_saving_tools(requests, n), "last": last_request(requests),
        "recent": recent_activity(requests, activity), "all_time": all_time_saved(requests),
    }
