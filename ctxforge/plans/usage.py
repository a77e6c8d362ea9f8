"""Queries over request records, and token expressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxforge.functions import tokens as T
from ctxforge.functions.merge_ranks import bpe_counter
from ctxforge.operators import usage as U
from ctxforge.plans.inputs import cte, derived


def _req(spark, sf):
    return derived(spark, sf, "requests")


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


PCT = "CAST(CASE WHEN {o} > 0 THEN floor({s} * 100 / {o} + 0.5) ELSE 0 END AS INT)"
LATEST = "row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC)"


def _pct(o, s):
    return PCT.format(o=o, s=s)


def _texts(spark, sf):
    return _docs(spark, sf).select("doc_id", F.col("text").alias("original"), F.substring("text", 1, 200).alias("optimized"))


def _projects(spark, sf):
    req = _req(spark, sf)
    sessions = req.groupBy("project_id", "session_id").agg(F.max("ts").alias("last_activity"))
    return U.project_totals(req, sessions)


def _edits(spark, sf):
    cut = lambda a, n: F.substring("text", a, n)
    e = _docs(spark, sf).select("doc_id", F.col("text").alias("file"), cut(5, 30).alias("old"), cut(9, 40).alias("new"), (F.col("doc_id") % 3 == 0).alias("is_write"))
    from ctxforge.operators.gates import edit_savings

    return e.select("doc_id", edit_savings(F.col("is_write"), F.col("file"), F.col("old"), F.col("new")).alias("t")).select("doc_id", "t.*")


def _registry(spark, sf):
    visits = _req(spark, sf).select("project_id", F.concat(F.lit("/srv/p"), (F.col("event_id") % 5).cast("string")).alias("path"), "ts")
    return U.register_projects(visits.groupBy("project_id", "ts").agg(F.min("path").alias("path")))


def _in_sql(s, d):
    """count_tokens as a function of SQL."""
    T.register(s)
    _docs(s, d).createOrReplaceTempView("ctxforge_documents")
    return s.sql("SELECT lang, source, sum(count_tokens(text)) AS tokens FROM ctxforge_documents GROUP BY lang, source")


QUERIES = {
    "count_tokens_sql": _in_sql,
    "token_counts": lambda s, d: _docs(s, d).select("doc_id", T.count_tokens(F.col("text")).alias("tokens")),
    "token_savings": lambda s, d: _texts(s, d).select("doc_id", T.text_savings(F.col("original"), F.col("optimized")).alias("t")).select("doc_id", "t.*"),
    "bpe_token_counts": lambda s, d: _docs(s, d).select("doc_id", bpe_counter("byte_bpe_50k.tiktoken")(F.col("text")).alias("tokens")),
    "approx_tokens": lambda s, d: _docs(s, d).select("doc_id", T.approx_tokens(F.col("text")).alias("tokens")),
    "json_tokens": lambda s, d: _docs(s, d).select("doc_id", T.json_tokens(F.struct("doc_id", "lang")).alias("tokens")),
    "format_tokens": lambda s, d: _req(s, d).select("event_id", T.format_tokens(F.col("original") * F.lit(8)).alias("short"), T.format_millions(F.col("original") * F.lit(4000)).alias("long")),
    "time_saved": lambda s, d: _req(s, d).select("event_id", T.time_saved_minutes(F.col("saved")).alias("minutes")),
    "ago_label": lambda s, d: _req(s, d).select("event_id", T.ago_label(F.col("original") * (F.col("event_id") % 40)).alias("label")),
    "project_port": lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", T.project_port(F.concat(F.lit("/srv/"), F.col("n_name"))).alias("port")),
    "session_stats": lambda s, d: U.session_stats(_req(s, d)).drop("started_at"),
    "tool_usage": lambda s, d: U.tool_usage(_req(s, d)),
    "top_saving_tools": lambda s, d: U.top_saving_tools(_req(s, d)),
    "all_time_saved": lambda s, d: U.all_time_saved(_req(s, d)),
    "recent_activity": lambda s, d: U.recent_activity(_req(s, d)).select("session_id", "position", "event_id", "tool", "saved", "original", "saved_percent"),
    "last_request": lambda s, d: U.last_request(_req(s, d)),
    "ring_buffer": lambda s, d: U.ring_buffer(_req(s, d), 5).groupBy("session_id").agg(F.count(F.lit(1)).alias("held"), F.sum("saved").alias("saved")),
    "tool_share": lambda s, d: U.tool_share(_req(s, d)),
    "spark_series": lambda s, d: U.spark_series(_req(s, d)).select("session_id", "event_id", "running_saved", "requests", "window_saved", "running_percent"),
    "project_totals": _projects,
    "project_registry": lambda s, d: _registry(s, d).select("project_id", "session_count", "path"),
    "edit_savings": _edits,
}

_R = f"WITH {cte('requests')} "
SQL = {
    "count_tokens_sql": "SELECT lang, source, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM documents GROUP BY lang, source",
    "token_counts": "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents",
    "token_savings": "WITH t AS (SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS o, CAST(ceil(length(substr(text, 1, 200)) / 4.0) AS BIGINT) AS p FROM documents) "
    f"SELECT doc_id, o AS original, p AS optimized, greatest(o - p, 0) AS saved, {_pct('o', 'greatest(o - p, 0)')} AS saved_percent FROM t",
    "approx_tokens": "SELECT doc_id, CAST(ceil(length(text) / 3.5) AS BIGINT) AS tokens FROM documents",
    "json_tokens": "SELECT doc_id, CAST(ceil(length(concat('{\"doc_id\":', doc_id, ',\"lang\":\"', lang, '\"}')) / 4.0) AS BIGINT) AS tokens FROM documents",
    "format_tokens": _R + "SELECT event_id, CASE WHEN original * 8 >= 1000 THEN printf('%.1fk', original * 8 / 1000.0) ELSE CAST(original * 8 AS VARCHAR) END AS short, "
    "CASE WHEN original * 4000 >= 1000000 THEN printf('%.1fM', original * 4000 / 1000000.0) ELSE printf('%.1fk', original * 4000 / 1000.0) END AS long FROM requests",
    "time_saved": _R + "SELECT event_id, CAST(floor(saved / 300.0 + 0.5) AS BIGINT) AS minutes FROM requests",
    "ago_label": _R + "SELECT event_id, CASE WHEN x < 60 THEN x || 's ago' WHEN x < 3600 THEN (x // 60) || 'm ago' ELSE (x // 3600) || 'h ago' END AS label FROM (SELECT event_id, original * (event_id % 40) AS x FROM requests)",
    "project_port": "SELECT n_nationkey, CAST(7100 + list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split('/srv/' || n_name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: xor(h * 33, c) & 4294967295) % 900 AS INT) AS port FROM nation",
    "session_stats": _R + f"SELECT *, greatest(total_original - total_saved, 0) AS total_optimized, {_pct('total_original', 'total_saved')} AS saved_percent FROM "
    "(SELECT session_id, count(*) AS total_requests, CAST(sum(original) AS BIGINT) AS total_original, CAST(sum(saved) AS BIGINT) AS total_saved FROM requests GROUP BY session_id)",
    "tool_usage": _R + "SELECT session_id, tool, count(*) AS calls FROM requests GROUP BY session_id, tool",
    "top_saving_tools": _R + "SELECT tool, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(original) AS BIGINT) AS original_tokens FROM requests GROUP BY tool HAVING sum(saved) > 0 ORDER BY 2 DESC, 1 LIMIT 5",
    "all_time_saved": _R + "SELECT CAST(coalesce(sum(saved), 0) AS BIGINT) AS all_time_saved FROM requests",
    "recent_activity": _R + f"SELECT session_id, position, event_id, tool, saved, original, {_pct('original', 'saved')} AS saved_percent FROM (SELECT *, {LATEST} AS position FROM requests) WHERE position <= 20",
    "last_request": _R + f"SELECT session_id, event_id, tool, original, saved FROM (SELECT *, {LATEST} AS k FROM requests) WHERE k = 1",
    "ring_buffer": _R + f"SELECT session_id, count(*) AS held, CAST(sum(saved) AS BIGINT) AS saved FROM (SELECT *, {LATEST} AS k FROM requests) WHERE k <= 5 GROUP BY session_id",
    "tool_share": _R + f"SELECT tool, calls, saved_tokens, {_pct('sum(saved_tokens) OVER ()', 'saved_tokens')} AS share_percent FROM "
    "(SELECT tool, count(*) AS calls, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM requests GROUP BY tool) WHERE saved_tokens > 0",
    "spark_series": _R + f"SELECT session_id, event_id, running_saved, requests, window_saved, {_pct('running_original', 'running_saved')} AS running_percent FROM (SELECT session_id, event_id, "
    "CAST(sum(saved) OVER w AS BIGINT) AS running_saved, CAST(sum(original) OVER w AS BIGINT) AS running_original, count(*) OVER w AS requests, "
    "CAST(sum(saved) OVER (PARTITION BY session_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_saved "
    "FROM requests WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))",
    "project_totals": _R + "SELECT r.project_id, CAST(sum(saved) AS BIGINT) AS total_saved, count(*) AS requests, any_value(l.latest_session) AS latest_session FROM requests r JOIN "
    "(SELECT project_id, session_id AS latest_session FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY t DESC, session_id DESC) AS k FROM (SELECT project_id, session_id, max(ts) AS t FROM requests GROUP BY ALL)) WHERE k = 1) l "
    "ON r.project_id = l.project_id GROUP BY r.project_id",
    "project_registry": _R + "SELECT project_id, count(*) AS session_count, arg_max(path, ts) AS path FROM (SELECT project_id, ts, min('/srv/p' || (event_id % 5)) AS path FROM requests GROUP BY project_id, ts) GROUP BY project_id",
    "edit_savings": "WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) WHEN substr(text, 5, 30) = '' OR substr(text, 9, 40) = '' THEN NULL ELSE CAST(ceil(length(text) / 4.0) AS BIGINT) END AS o, "
    "CASE WHEN doc_id % 3 = 0 THEN CAST(ceil(length(text) / 4.0) AS BIGINT) WHEN substr(text, 5, 30) = '' OR substr(text, 9, 40) = '' THEN NULL "
    "ELSE CAST(ceil(length(substr(text, 5, 30)) / 4.0) + ceil(length(substr(text, 9, 40)) / 4.0) AS BIGINT) END AS p FROM documents) "
    f"SELECT doc_id, o AS original, p AS optimized, CASE WHEN o IS NULL THEN NULL ELSE greatest(o - p, 0) END AS saved, CASE WHEN o IS NULL THEN NULL ELSE {_pct('o', 'greatest(o - p, 0)')} END AS saved_percent FROM t",
}
