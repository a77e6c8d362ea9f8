"""Queries over tool events, prompts, diffs and windows of time, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxforge.functions import render
from ctxforge.functions.tokens import project_port
from ctxforge.operators import budget as B
from ctxforge.operators import code as K
from ctxforge.operators import conversation as C
from ctxforge.operators import dedupe as D
from ctxforge.operators import diff as W
from ctxforge.operators import gates as G
from ctxforge.operators import logs as L
from ctxforge.operators import prompts as P
from ctxforge.operators import relevance as R
from ctxforge.operators import repo_graph as RG
from ctxforge.operators import usage as U
from ctxforge.plans.inputs import LOGS_CTE, cte, derived, logs
from ctxforge.sources.events import parse_events
from ctxforge.sources.scratch import written
from ctxforge.streaming import usage as S


def _reads(s, d):
    ord_, body = F.col("ord"), F.expr("repeat(concat(content, chr(10)), CASE WHEN ord % 3 = 0 THEN 12 ELSE 1 END)")
    files = derived(s, d, "files").withColumn("body", body)
    tool = F.when(ord_ % 11 == 0, "Bash").otherwise("Read")
    return files.select("ord", G.read_decision(tool, F.col("path"), ord_ % 7 == 0, F.col("body"), (ord_ % 40).cast("int")).alias("decision"))


def _outputs(s, d):
    return logs(s, d).withColumnRenamed("content", "output")


def _prompts(s, d):
    text = F.concat(F.lit("See\n```"), F.when(F.col("log_id") % 2 == 0, "log").otherwise(""), F.lit("\n"), F.col("content"), F.lit("\n```\nand\n```py\ndef f(a):\n    pass\n```\nend"))
    return logs(s, d).select(F.col("log_id").alias("prompt_id"), text.alias("prompt"))


def _pairs(s, d):
    """All documents, a word to a line, against themselves with some lines changed."""
    W.short_batches(s)
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split("text", " ").alias("w"))
    new = F.filter(F.transform("w", lambda x, i: F.when(i % 47 == F.col("doc_id") % 47, F.concat(F.lit("new "), x)).when(i % 61 == 7, F.concat(x, F.lit("\nmore"))).otherwise(x)), lambda x, i: i % 53 != 11)
    return docs.select("doc_id", F.lit("src/a.txt").alias("path"), F.array_join("w", "\n").alias("old"), F.array_join(new, "\n").alias("new"))


def _hunks(s, d):
    found = _pairs(s, d).select("doc_id", F.posexplode(W.hunks("old", "new")).alias("place", "h"))
    return found.select("doc_id", "place", "h.old_start", F.size("h.old_lines").alias("n_old"), F.size("h.new_lines").alias("n_new"))


def _diff(s, d):
    found = _pairs(s, d).select("doc_id", F.explode(W.line_diff("old", "new")).alias("x"))
    return found.groupBy("doc_id").agg(*(F.sum((F.col("x.op") == op).cast("long")).alias(op) for op in ("keep", "add", "del")))


def _responses(s, d):
    """Tool events as JSON lines, read back."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    n = F.col("event_id")
    response = (
        F.when(n % 4 == 0, F.to_json(F.struct(F.struct(F.concat(F.lit("out "), n.cast("string")).alias("output")).alias("r"))))
        .when(n % 4 == 1, F.lit('{"r":"plain \\"text\\""}'))
        .when(n % 4 == 2, F.lit('{"r":{"content":[{"type":"text","text":"a"},{"type":"image"},{"type":"text","text":"b"}]}}'))
        .otherwise(F.lit('{"r":{"other":1}}'))
    )
    body = F.regexp_extract(response, r'^\{"r":([\s\S]*)\}$', 1)
    line = F.concat(F.lit('{"tool_name":"Bash","tool_input":{"command":"'), F.col("event_type"), F.lit('"},"tool_response":'), body, F.lit("}"))
    events = parse_events(e.select(line.alias("value")))
    return events.select("tool_name", F.col("tool_input")["command"].alias("command"), G.response_text(F.col("tool_response")).alias("text"))


def _status(s, d):
    """Projects and sessions of the request log, as a status report lists them."""
    req = derived(s, d, "requests")
    projects = req.groupBy("project_id").agg(F.max("ts").alias("last_seen_at"), F.countDistinct("session_id").alias("session_count"), F.sum("saved").alias("total_saved"))
    name = F.concat(F.lit("project"), F.col("project_id"))
    projects = projects.select("last_seen_at", F.col("project_id").cast("string").alias("id"), name.alias("name"), project_port(name).alias("port"), "session_count", "total_saved")
    live = req.groupBy("session_id").agg(F.min("ts").alias("started_at"), F.sum("saved").alias("saved"), F.max_by("project_id", "ts").alias("p"))
    return projects, live.select("started_at", F.lpad(F.col("session_id").cast("string"), 8, "0").alias("id"), F.concat(F.lit("project"), F.col("p")).alias("project"), "saved")


def _render(s, d):
    """Rendered texts of each kind, from whole texts and tables."""
    files, req = derived(s, d, "files"), derived(s, d, "requests")
    items, messages = derived(s, d, "items"), derived(s, d, "messages")
    sized = files.withColumn("size_bytes", F.octet_length("content").cast("long"))
    parts = B.breakdown(derived(s, d, "budget_items"))
    # Files are made and parsed once for their own reports and for those of the directory.
    parsed = written(K.parse(files), "parsed-files")
    meta = parsed.select("ord", "path", "language", "imports", "exports")
    whole = K.compress(files, lambda _: parsed)
    made = [
        whole.select(F.lit("file").alias("kind"), F.col("ord").cast("string").alias("id"), render.file(F.struct("*")).alias("text")),
        L.summarize(logs(s, d)).select(F.lit("log"), F.col("log_id").cast("string"), render.log(F.struct("*"))),
        C.summarize(messages).select(F.lit("conversation"), F.col("conv_id").cast("string"), render.conversation(F.struct("*"))),
        render.ranking(R.rank(sized, "load part orders"), "load part orders").select(F.lit("ranking"), F.lit("0"), "text"),
        render.budget(parts, B.totals(parts), B.recommendations(parts)).select(F.lit("budget"), F.col("budget_id").cast("string"), "text"),
        render.usage(U.session_stats(req), U.tool_usage(req)).select(F.lit("usage"), F.col("session_id").cast("string"), "text"),
        render.duplicates(D.duplicate_groups(items), items).select(F.lit("duplicates"), F.lit("0"), "text"),
        whole.select(F.lit("read block"), F.col("ord").cast("string"), render.read_block(F.struct("*"))),
        W.write_gate(_pairs(s, d)).where("decision = 'block'").select(F.lit("write block"), F.col("doc_id").cast("string"), render.write_block(F.struct("*"))),
        render.directory(RG.compress_directory(meta, "."), RG.entry_points(meta), RG.important_files(meta), RG.relationships(meta), ".").select(F.lit("directory"), F.lit("."), "text"),
        render.status(*_status(s, d), "2024-02-01 00:00:00").select(F.lit("status"), F.lit("0"), "text"),
    ]
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    return out


def _windows(s, d, f, **options):
    return f(derived(s, d, "requests"), **options)


def _checks(s, d):
    """A report for each customer: their orders are the checks."""
    o = s.read.parquet(f"{d}/orders.parquet")
    fix = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("look at order "), "o_orderkey"))
    return render.checks(o.select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("place"), F.concat(F.lit("order "), "o_orderkey").alias("name"), (F.col("o_orderstatus") != "O").alias("ok"), F.col("o_orderpriority").alias("message"), fix.alias("fix")))


QUERIES = {
    "render_checks": _checks,
    "read_gate": _reads,
    "bash_head_tail": lambda s, d: _outputs(s, d).select("log_id", G.head_tail(F.col("output")).alias("short")),
    "bash_gate": lambda s, d: _outputs(s, d).select("log_id", G.output_decision(F.when(F.col("log_id") % 13 == 0, "Read").otherwise("Bash"), F.col("output")).alias("decision")),
    "gate_opt_out": lambda s, d: _outputs(s, d).select("log_id", G.unless_opted_out(G.output_decision(F.lit("Bash"), F.col("output")), F.when(F.col("log_id") % 5 != 3, F.col("log_id") % 4 == 0)).alias("decision")),
    "response_text": lambda s, d: _responses(s, d).groupBy("tool_name", "command", "text").agg(F.count(F.lit(1)).alias("n")),
    "prompt_blocks": lambda s, d: P.blocks(_prompts(s, d)).select("prompt_id", "place", "lang", "n_lines", F.length("content").alias("chars")),
    "prompt_block_kind": lambda s, d: P.blocks(_prompts(s, d)).select("prompt_id", "place", "kind"),
    "compress_prompt": lambda s, d: P.compress(_prompts(s, d)),
    "line_diff": _diff,
    "diff_hunks": _hunks,
    "diff_verify": lambda s, d: _pairs(s, d).select("doc_id", W.verify("old", "new").alias("verified")),
    "write_gate": lambda s, d: W.write_gate(_pairs(s, d)).select("doc_id", "write_cost", "edit_cost", "saved_percent", "decision"),
    "events_tumbling": lambda s, d: _windows(s, d, S.tumbling),
    "events_sliding": lambda s, d: _windows(s, d, S.sliding),
    "events_session": lambda s, d: _windows(s, d, S.sessions),
    "render_reports": _render,
}

_PCT = "CAST(CASE WHEN {o} > 0 THEN floor({s} * 100 / {o} + 0.5) ELSE 0 END AS INT)"
_EXTS = ", ".join(f"'{x}'" for x in G.READ_EXTENSIONS)
_LOGS = f"WITH {cte('log_lines')}, {LOGS_CTE}"
_OUT = _LOGS + ", o AS (SELECT log_id, content AS output FROM logs), l AS (SELECT *, string_split(output, chr(10)) AS ls FROM o), "
_OUT += (
    "h AS (SELECT log_id, output, CASE WHEN len(ls) <= 60 THEN output ELSE array_to_string(list_slice(ls, 1, 40), chr(10)) || chr(10) || chr(10) || '── output shortened ──' || chr(10) || '  ' || (len(ls) - 55) || ' lines / ~' "
    "|| CAST(ceil(length(array_to_string(list_slice(ls, 41, len(ls) - 15), chr(10))) / 4.0) AS BIGINT) || ' tokens omitted from middle' || chr(10) || '──' || chr(10) || chr(10) || array_to_string(list_slice(ls, len(ls) - 14, len(ls)), chr(10)) END AS short FROM l)"
)
_TOK = lambda x: f"CAST(ceil(length({x}) / 4.0) AS BIGINT)"
_SAVED = _PCT.format(o=_TOK("output"), s=f"greatest({_TOK('output')} - {_TOK('short')}, 0)")
_BLOCKS = (
    _LOGS + ", p AS (SELECT log_id AS prompt_id, 'See' || chr(10) || '```' || CASE WHEN log_id % 2 = 0 THEN 'log' ELSE '' END || chr(10) || content || chr(10) || '```' || chr(10) || 'and' || chr(10) || '```py' || chr(10) || 'def f(a):' || chr(10) || '    pass' || chr(10) || '```' || chr(10) || 'end' AS prompt FROM logs), "
    r"b AS (SELECT prompt_id, CAST(generate_subscripts(regexp_extract_all(prompt, '```([A-Za-z0-9_]*)\n([\s\S]*?)```', 1), 1) - 1 AS INT) AS place, unnest(regexp_extract_all(prompt, '```([A-Za-z0-9_]*)\n([\s\S]*?)```', 1)) AS lang, "
    r"unnest(regexp_extract_all(prompt, '```([A-Za-z0-9_]*)\n([\s\S]*?)```', 2)) AS content FROM p)"
)
_REQ = f"WITH {cte('requests')} "
_TUMBLE = _REQ + f"SELECT time_bucket(INTERVAL '1 hour', ts) AS start, tool, count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved, {_PCT.format(o='sum(original)', s='sum(saved)')} AS saved_percent FROM requests GROUP BY 1, 2"
SQL = {
    "render_checks": "WITH c AS (SELECT o_custkey, o_orderkey AS k, o_orderstatus <> 'O' AS ok, o_orderpriority AS p FROM orders) SELECT o_custkey AS report_id, 'Checks' || chr(10) || chr(10) || "
    "string_agg('  ' || CASE WHEN ok THEN '✓' ELSE '✗' END || ' order ' || k || ': ' || p || CASE WHEN NOT ok AND k % 2 = 0 THEN chr(10) || '    → look at order ' || k ELSE '' END, chr(10) ORDER BY k) || chr(10) || chr(10) || "
    "CASE WHEN bool_and(ok) THEN 'All checks passed.' ELSE 'Run again with repairs for what failed.' END AS text FROM c GROUP BY o_custkey",
    "read_gate": f"WITH {cte('files')}, t AS (SELECT ord, path, ord % 40 AS pct, repeat(content || chr(10), CASE WHEN ord % 3 = 0 THEN 12 ELSE 1 END) AS body, list_last(string_split(path, '/')) AS base FROM files) "
    f"SELECT ord, CASE WHEN ord % 11 = 0 THEN 'skip' WHEN ord % 7 <> 0 AND contains(base, '.') AND lower(list_last(string_split(base, '.'))) IN ({_EXTS}) AND len(string_split(body, chr(10))) >= 100 AND pct >= 15 THEN 'block' ELSE 'pass' END AS decision FROM t",
    "bash_head_tail": _OUT + " SELECT log_id, short FROM h",
    "bash_gate": _OUT + f" SELECT log_id, CASE WHEN log_id % 13 = 0 OR output = '' THEN 'skip' WHEN {_TOK('output')} >= 200 AND {_SAVED} >= 15 THEN 'shorten' ELSE 'pass' END AS decision FROM h",
    "gate_opt_out": _OUT + f" SELECT log_id, CASE WHEN log_id % 5 <> 3 AND log_id % 4 = 0 OR output = '' THEN 'skip' WHEN {_TOK('output')} >= 200 AND {_SAVED} >= 15 THEN 'shorten' ELSE 'pass' END AS decision FROM h",
    "response_text": "SELECT 'Bash' AS tool_name, event_type AS command, CASE event_id % 4 WHEN 0 THEN 'out ' || event_id WHEN 1 THEN 'plain \"text\"' WHEN 2 THEN 'ab' ELSE '' END AS text, count(*) AS n FROM events GROUP BY ALL",
    "prompt_blocks": _BLOCKS + " SELECT prompt_id, place, lang, CAST(len(string_split(content, chr(10))) AS INT) AS n_lines, length(content) AS chars FROM b",
    "prompt_block_kind": _BLOCKS + r", k AS (SELECT *, list_slice(string_split(content, chr(10)), 1, 20) AS ls FROM b) SELECT prompt_id, place, CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '(?i)\b(?:error|warn(?:ing)?|info|debug|fatal|stdout|stderr)\b.*:') OR regexp_matches(x, '\d{2}:\d{2}:\d{2}|\d{4}-\d{2}-\d{2}'))) >= least(3.0, len(ls) * 0.3) THEN 'log' ELSE 'code' END AS kind FROM k",
    "events_tumbling": _TUMBLE,
    "events_sliding": _REQ + f"SELECT start, tool, count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved, {_PCT.format(o='sum(original)', s='sum(saved)')} AS saved_percent FROM (SELECT *, time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' * k AS start FROM requests, (SELECT unnest([0, 1]) AS k)) GROUP BY 1, 2",
    "events_session": _REQ + ", g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '6 hours' THEN 1 ELSE 0 END AS fresh FROM requests WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)), "
    "n AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS k FROM g) SELECT session_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS \"end\", count(*) AS requests, CAST(sum(saved) AS BIGINT) AS saved FROM n GROUP BY session_id, k",
}
