"""Queries over streams, with their SQL. The events arrive in slices by a time of arrival that lags behind their own by up to 54
minutes, so rows come late; after each slice the stream is started again from its checkpoint, and its rows form a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.operators import usage as U
from ctxforge.plans.inputs import cte, derived
from ctxforge.plans.usage import PCT
from ctxforge.sources import events as E
from ctxforge.sources import keyed
from ctxforge.sources.scratch import fresh_path
from ctxforge.streaming import rollups
from ctxforge.streaming import state as S
from ctxforge.streaming import usage as W

SLICES = 3


def streamed(s: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], mode: str, sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Deliver the requests slice by slice to a stream; gives the folder with its output: out/v<batch> without a sink."""
    folder = fresh_path(s, "stream")
    rows = derived(s, d, "requests").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withColumn("_arrival", F.unix_seconds("ts") + F.col("event_id") % 7 * 540)
    low, high = rows.agg(F.min("_arrival"), F.max("_arrival")).first()
    low, high = low or 0, high or 0
    rows = rows.withColumn("_slice", F.least(F.floor((F.col("_arrival") - low) * SLICES / (high - low + 1)), F.lit(SLICES - 1)))
    for n in range(SLICES):
        rows.where(F.col("_slice") == n).drop("_arrival", "_slice").write.mode("append").parquet(f"{folder}/in")
        source = s.readStream.schema(rows.drop("_arrival", "_slice").schema).parquet(f"{folder}/in")

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out/v{batch_id}")

        with S.state_store(s):
            query = build(source).writeStream.outputMode(mode).foreachBatch(sink(folder) if sink else write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    return folder


def _table(keys: list[str], combine: keyed.Combine):
    """A sink that keeps rows by key with the batch they came with."""

    def sink(folder: str):
        write = keyed.merge_into(f"{folder}/table", keys, combine, buckets=8)
        return lambda batch, batch_id: write(batch.withColumn("_batch", F.lit(batch_id)), batch_id)

    return sink


def _kept(s: SparkSession, d: str, build, keys: list[str], order: tuple[str, ...] = ()) -> DataFrame:
    """The last row that a stream gave for each key."""
    folder = streamed(s, d, build, "update", _table(keys, keyed.latest(keys, ["_batch", *order])))
    return keyed.read_table(s, f"{folder}/table").drop("_batch")


def _complete(s: SparkSession, d: str, build) -> DataFrame:
    """What the last batch gave."""
    folder = streamed(s, d, build, "complete")
    names = [n for n in keyed._Files(s, f"{folder}/out").names("") if n.startswith("v")]
    return s.read.parquet(f"{folder}/out/v{max(int(n[1:]) for n in names)}")


def _sessions(s, d):
    def build(requests):
        action = F.when(F.col("event_id") % 41 == 0, "detach").when(F.col("event_id") % 43 == 0, "reset")
        return S.track_sessions(requests.withColumn("action", action)).withColumn("ended", F.when(F.col("final"), F.col("started_at")))

    rows = _kept(s, d, build, ["session_id", "ended"])
    return rows.where("final OR active").select("session_id", "started_at", "last_activity", "saved", "requests", "active")


def _plain_sessions(s, d):
    build = lambda r: S.track_sessions(r).withColumn("ended", F.when(F.col("final"), F.col("started_at")))
    return _kept(s, d, build, ["session_id", "ended"]).where("active AND NOT final").select("session_id", "saved", "requests")


def _cache(s, d):
    build = lambda r: S.expiring_entries(r.select((F.col("session_id") % 211).alias("key"), F.concat("tool", F.lit(" "), F.col("event_id")).alias("value"), "ts"), 12 * 3600 * 1000)
    return _kept(s, d, build, ["key"]).where("live").select("key", "value")


def _credits(s, d):
    def build(requests):
        rows = requests.withColumn("project_id", F.col("session_id") % 397)
        touched = rows.where("event_id % 3 = 0").select("project_id", "session_id", "ts")
        return S.credit_savings(touched, rows.where("event_id % 3 <> 0").select("project_id", "saved", "ts"))

    def sink(folder):
        return keyed.merge_into(f"{folder}/table", ["project_id", "session_id"], keyed.sums(["project_id", "session_id"], ["saved", "savings"]), buckets=8)

    folder = streamed(s, d, lambda r: build(r).drop("last_credit"), "update", sink)
    return keyed.read_table(s, f"{folder}/table")


def _rollup(s, d):
    """Folder of the partial sums and recent requests that a stream keeps."""
    return streamed(s, d, lambda r: r.select("session_id", "event_id", "tool", "ts", "original", "saved"), "append", lambda folder: rollups.keep_usage(f"{folder}/usage"))


def _stats(s, d):
    return rollups.stats(s, f"{_rollup(s, d)}/usage")


def _ingested(s, d):
    """Requests that arrive as JSON files in two deliveries, each followed by a run that goes on where the one before stopped."""
    folder = fresh_path(s, "ingest")
    rows = derived(s, d, "requests").select("session_id", "event_id", "tool", F.col("ts").cast("timestamp").alias("ts"), "original", "saved")
    for n in range(2):
        rows.where(F.col("event_id") % 2 == n).write.mode("append").json(f"{folder}/in")
        E.ingest_requests(s, f"{folder}/in", f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out").withColumn("ts", F.unix_micros("ts"))


def _registered(s, d):
    """Projects written as registry files, read again, with savings added and some removed."""
    folder, requests = fresh_path(s, "registry"), derived(s, d, "requests").withColumn("id", (F.col("session_id") % 500).cast("string"))
    visits = requests.groupBy("id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).cast("int").alias("session_count"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")
    columns = [F.concat(F.lit("project"), "id").alias("name"), F.concat(F.lit("/srv/"), "id").alias("path"), F.lit(7100).alias("port"), F.lit("unknown").alias("language"), time("first").alias("registered_at"), time("last").alias("last_seen_at"), "session_count", F.lit(0).cast("long").alias("total_saved")]
    E.write_registry(visits.select("id", *columns), folder)
    projects = E.read_registry(s, folder)
    projects = E.add_savings(projects, requests.where("saved > 0").select("id", "saved", time("ts").alias("seen_at")))
    gone = requests.where("tool = 'error'").groupBy("id").count().where("count > 15").select("id")
    return E.remove_projects(projects, gone).select("id", "name", "session_count", "total_saved", "registered_at", "last_seen_at")


QUERIES = {
    "ingest_requests": _ingested,
    "registry_files": _registered,
    "stream_session_stats": lambda s, d: _complete(s, d, W.running_stats).drop("started_at"),
    "stream_tumbling": lambda s, d: _complete(s, d, W.tumbling),
    "stream_track_sessions": _plain_sessions,
    "stream_session_actions": _sessions,
    "stream_history": lambda s, d: _kept(s, d, lambda r: S.bounded_history(r, 5), ["session_id"]).select("session_id", "remembered", "saved"),
    "stream_cache": _cache,
    "stream_credits": _credits,
    "stream_usage_stats": _stats,
}

_REQ = f"WITH {cte('requests')} "
_LAST = "(SELECT epoch_us(max(ts)) // 1000 - 7200000 FROM requests)"
#: With two streams the watermark follows the slower one.
_LAST_OF_BOTH = "(SELECT epoch_us(least(max(CASE WHEN event_id % 3 = 0 THEN ts END), max(CASE WHEN event_id % 3 <> 0 THEN ts END))) // 1000 - 7200000 FROM requests)"
_GAP = "172800000000"
#: Sessions of rows (session_id, t in microseconds, saved, action): a gap, a detached or reset session before it begins another.
_SPLIT = (
    "b AS (SELECT *, lag(t) OVER w AS before, lag(action) OVER w AS was FROM r WINDOW w AS (PARTITION BY session_id ORDER BY t, action, saved)), "
    f"n AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > {_GAP} OR was = 'detach' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, action, saved ROWS UNBOUNDED PRECEDING) AS nth, "
    "sum(CASE WHEN action = 'reset' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY t, action, saved ROWS UNBOUNDED PRECEDING) AS resets FROM b)"
)
SQL = {
    "ingest_requests": _REQ + "SELECT session_id, event_id, tool, epoch_us(time_bucket(INTERVAL '1 millisecond', ts)) AS ts, original, saved FROM requests",
    "registry_files": _REQ + ", r AS (SELECT CAST(session_id % 500 AS VARCHAR) AS id, * FROM requests), s AS (SELECT id, sum(saved) AS total, max(ts) AS seen FROM r WHERE saved > 0 GROUP BY id) "
    "SELECT r.id, 'project' || r.id AS name, CAST(count(*) AS INT) AS session_count, CAST(coalesce(any_value(total), 0) AS BIGINT) AS total_saved, strftime(time_bucket(INTERVAL '1 millisecond', min(ts)), '%Y-%m-%d %H:%M:%S.%g') AS registered_at, "
    "strftime(time_bucket(INTERVAL '1 millisecond', coalesce(any_value(seen), max(ts))), '%Y-%m-%d %H:%M:%S.%g') AS last_seen_at FROM r LEFT JOIN s ON r.id = s.id GROUP BY r.id HAVING count(*) FILTER (WHERE tool = 'error') <= 15",
    "stream_session_stats": _REQ + f"SELECT *, greatest(total_original - total_saved, 0) AS total_optimized, {PCT.format(o='total_original', s='total_saved')} AS saved_percent FROM (SELECT session_id, count(*) AS total_requests, CAST(sum(original) AS BIGINT) AS total_original, CAST(sum(saved) AS BIGINT) AS total_saved FROM requests GROUP BY session_id)",
    "stream_tumbling": _REQ + f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, tool, count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved, {PCT.format(o='sum(original)', s='sum(saved)')} AS saved_percent FROM requests GROUP BY 1, 2",
    "stream_track_sessions": _REQ + f", r AS (SELECT session_id, epoch_us(ts) AS t, saved, '' AS action FROM requests), {_SPLIT} "
    f"SELECT session_id, CAST(sum(saved) AS BIGINT) AS saved, count(*) AS requests FROM (SELECT *, max(nth) OVER (PARTITION BY session_id) AS final FROM n) WHERE nth = final GROUP BY session_id HAVING max(t) // 1000 + 172800000 >= {_LAST}",
    "stream_session_actions": _REQ + f", r AS (SELECT session_id, epoch_us(ts) AS t, saved, CASE WHEN event_id % 41 = 0 THEN 'detach' WHEN event_id % 43 = 0 THEN 'reset' ELSE '' END AS action FROM requests), {_SPLIT}, "
    # A detach after a gap or without a session only ends what idled before; it begins nothing.
    "f AS (SELECT *, first_value(action) OVER (PARTITION BY session_id, nth ORDER BY t, action, saved) AS opening, max(nth) OVER (PARTITION BY session_id) AS last_one, max(resets) OVER (PARTITION BY session_id, nth) AS last_reset, "
    "max(CASE WHEN action = 'detach' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, nth) AS detached, max(CASE WHEN action <> 'detach' THEN t END) OVER (PARTITION BY session_id, nth) AS last_t FROM n), "
    "g AS (SELECT session_id, nth, any_value(last_one) AS last_one, any_value(detached) AS detached, max(t) AS last_row, any_value(last_t) AS last_t, min(CASE WHEN resets = last_reset AND action <> 'detach' THEN t END) AS began, "
    "coalesce(sum(CASE WHEN resets = last_reset AND action = '' THEN saved END), 0) AS saved, count(CASE WHEN resets = last_reset AND action = '' THEN 1 END) AS requests FROM f WHERE opening <> 'detach' GROUP BY session_id, nth) "
    # A detach whose row has not passed the watermark has not ended its session for good, and is not shown as active either.
    f"SELECT session_id, make_timestamp(began) AS started_at, make_timestamp(last_t) AS last_activity, CAST(saved AS BIGINT) AS saved, requests, nth = last_one AND detached = 0 AND last_t // 1000 + 172800000 >= {_LAST} AS active FROM g "
    f"WHERE detached = 0 AND nth = last_one OR detached = 1 AND last_row // 1000 < {_LAST} OR detached = 0 AND nth < last_one AND (last_t // 1000 + 172800000 < {_LAST})",
    "stream_history": _REQ + "SELECT session_id, count(*) AS remembered, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) AS k FROM requests) WHERE k <= 5 GROUP BY session_id",
    "stream_cache": _REQ + f"SELECT CAST(key AS VARCHAR) AS key, value FROM (SELECT session_id % 211 AS key, arg_max(tool || ' ' || event_id, ts) AS value, max(ts) AS t FROM requests GROUP BY 1) WHERE epoch_us(t) // 1000 + 43200000 >= {_LAST}",
    "stream_credits": _REQ + ", r AS (SELECT session_id % 397 AS project_id, epoch_us(ts) AS t, event_id % 3 = 0 AS touch, session_id, saved FROM requests WHERE event_id % 3 = 0 OR saved > 0), "
    f"o AS (SELECT *, lag(t) OVER w AS before, sum(CASE WHEN touch THEN 1 ELSE 0 END) OVER w AS nth FROM r WHERE t // 1000 < {_LAST_OF_BOTH} WINDOW w AS (PARTITION BY project_id ORDER BY t, NOT touch, session_id, saved ROWS UNBOUNDED PRECEDING)), "
    f"a AS (SELECT *, max(CASE WHEN touch THEN session_id END) OVER (PARTITION BY project_id, nth) AS owner, sum(CASE WHEN NOT touch AND t - before > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, nth ORDER BY t, NOT touch, session_id, saved ROWS UNBOUNDED PRECEDING) AS breaks FROM o) "
    "SELECT project_id, CASE WHEN nth > 0 AND breaks = 0 THEN owner END AS session_id, CAST(sum(saved) AS BIGINT) AS saved, count(*) AS savings FROM a WHERE NOT touch GROUP BY 1, 2",
    "stream_usage_stats": _REQ + "SELECT 'session' AS section, session_id, CAST(NULL AS VARCHAR) AS tool, CAST(NULL AS BIGINT) AS event_id, count(*) AS requests, CAST(sum(original) AS BIGINT) AS original, CAST(sum(saved) AS BIGINT) AS saved FROM requests GROUP BY session_id "
    "UNION ALL SELECT 'usage', session_id, tool, NULL, count(*), CAST(sum(original) AS BIGINT), CAST(sum(saved) AS BIGINT) FROM requests GROUP BY session_id, tool "
    "UNION ALL (SELECT 'top', NULL, tool, NULL, count(*), CAST(sum(original) AS BIGINT), CAST(sum(saved) AS BIGINT) FROM requests GROUP BY tool HAVING sum(saved) > 0 ORDER BY sum(saved) DESC, tool LIMIT 10) "
    "UNION ALL SELECT 'all time', NULL, NULL, NULL, count(*), CAST(sum(original) AS BIGINT), CAST(sum(saved) AS BIGINT) FROM requests "
    "UNION ALL (SELECT 'recent', session_id, tool, event_id, 1, original, saved FROM requests ORDER BY ts DESC, event_id DESC LIMIT 20)",
}
