"""Rendered reports as queries of their own, with SQL that builds the same texts from the SQL of what they report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxforge.functions import render
from ctxforge.operators import budget as B
from ctxforge.operators import conversation as C
from ctxforge.operators import dedupe as D
from ctxforge.operators import logs as L
from ctxforge.operators import relevance as R
from ctxforge.operators import usage as U
from ctxforge.plans import code, texts, usage
from ctxforge.plans.events import _status
from ctxforge.plans.inputs import LOGS_CTE, cte, derived, logs

NOW = "2024-02-01 00:00:00"


def _budget(s, d):
    parts = B.breakdown(derived(s, d, "budget_items"))
    return render.budget(parts, B.totals(parts), B.recommendations(parts, 7000))


def _usage(s, d):
    requests = derived(s, d, "requests")
    return render.usage(U.session_stats(requests), U.tool_usage(requests))


def _duplicates(s, d):
    items = derived(s, d, "items")
    return render.duplicates(D.duplicate_groups(items, 0.6), items)


QUERIES = {
    "render_usage": _usage,
    "render_budget": _budget,
    "render_log": lambda s, d: L.summarize(logs(s, d)).select("log_id", render.log(F.struct("*")).alias("text")),
    "render_conversation": lambda s, d: C.summarize(derived(s, d, "messages")).select("conv_id", render.conversation(F.struct("*")).alias("text")),
    "render_ranking": lambda s, d: render.ranking(R.rank(code._sized(s, d), code.QUERY), code.QUERY),
    "render_duplicates": _duplicates,
    "render_status": lambda s, d: render.status(*_status(s, d), NOW),
}

_NL = "chr(10)"


def _lines(*parts: str) -> str:
    """SQL that joins parts by line ends; null parts are left out."""
    return f"concat_ws({_NL}, {', '.join(parts)})"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _listed(title: str, table: str, key: str, line: str, most: int, noun: str, order: str) -> str:
    """A CTE body: heading, the first rows, how many follow, and an empty line."""
    more = f"CASE WHEN count(*) > {most} THEN '- … (' || (count(*) - {most}) || ' {noun})' END"
    return f"SELECT {key}, {_lines(_text(title), f'string_agg({line}, {_NL} ORDER BY {order}) FILTER (WHERE nth <= {most})', more, _text(''))} AS part FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS nth FROM {table}) GROUP BY {key}"


_SAVED = "'### Token Savings', 'Original: **' || original || '** → Optimized: **' || CAST(optimized AS BIGINT) || '** (saved **' || saved_percent || '%**)'"
_AGO = "CASE WHEN {x} < 60 THEN {x} || 's ago' WHEN {x} < 3600 THEN ({x} // 60) || 'm ago' ELSE ({x} // 3600) || 'h ago' END"
#: Halves go up, where they are exact.
_SHORT = "CASE WHEN {n} >= 1000000 THEN printf('%.1fM', ({n} + CASE WHEN {n} % 500000 = 250000 THEN 1 ELSE 0 END) / 1000000.0) WHEN {n} >= 1000 THEN printf('%.1fk', ({n} + CASE WHEN {n} % 500 = 250 THEN 1 ELSE 0 END) / 1000.0) ELSE CAST({n} AS VARCHAR) END"
_SECONDS = f"(epoch_ms(TIMESTAMP '{NOW}') // 1000 - epoch_ms({{t}}) // 1000)"
_LISTS = (("Goals", "conv_goals", ""), ("Completed Tasks", "conv_completed", "✅ "), ("Pending Tasks", "conv_pending", "⬜ "), ("Decisions", "conv_decisions", ""), ("Blockers", "conv_blockers", "🚫 "))

SQL = {
    "render_usage": f"WITH s AS ({usage.SQL['session_stats']}), t AS ({usage.SQL['tool_usage']}), "
    f"u AS (SELECT session_id, string_agg('- `' || tool || '`: ' || calls || ' call' || CASE calls WHEN 1 THEN '' ELSE 's' END, {_NL} ORDER BY calls DESC, tool) AS used FROM t GROUP BY session_id) SELECT s.session_id, "
    + _lines(
        "'## Token Usage Report'", "''", "'### Current Session'", "'- Session ID: `' || s.session_id || '`'", "'- Total requests: **' || total_requests || '**'", "'- Original tokens: **' || format('{:,}', total_original) || '**'",
        "'- Optimized tokens: **' || format('{:,}', total_optimized) || '**'", "'- Saved: **' || format('{:,}', total_saved) || '** tokens (**' || saved_percent || '%**)'", "''", "'### Tool Usage'", "used",
        f"CASE WHEN saved_percent >= 50 THEN {_NL} || '🎯 **Target achieved:** ≥50% reduction in tokens!' END",
    ) + " AS text FROM s LEFT JOIN u ON s.session_id = u.session_id",
    "render_budget": f"WITH b AS ({texts.SQL['budget_breakdown']}), t AS ({texts.SQL['budget_totals']}), r AS ({texts.SQL['budget_recommendation']}), "
    "l AS (SELECT *, CAST(CASE WHEN original_tokens > 0 THEN floor(greatest(original_tokens - optimized_tokens, 0) * 100 / original_tokens + 0.5) ELSE 0 END AS INT) AS pct FROM b), "
    f"i AS (SELECT budget_id, string_agg('| ' || name || ' | ' || format('{{:,}}', original_tokens) || ' | ' || format('{{:,}}', optimized_tokens) || ' | ' || pct || '% |', {_NL} ORDER BY ord) AS items FROM l GROUP BY budget_id) SELECT t.budget_id, "
    + _lines(
        "'## Context Budget Analysis'", "''", "'| Metric | Tokens |'", "'|--------|--------|'", "'| Original | ' || format('{:,}', original_tokens) || ' |'", "'| Optimized | ' || format('{:,}', optimized_tokens) || ' |'",
        "'| Saved | ' || format('{:,}', saved_tokens) || ' (' || saved_percent || '%) |'", "''", "'### Breakdown by Item'", "''", "'| Item | Original | Optimized | Savings |'", "'|------|----------|-----------|---------|'", "items", "''", "'### Recommendation'", "recommendation",
    ) + " AS text FROM t JOIN i ON t.budget_id = i.budget_id JOIN r ON t.budget_id = r.budget_id",
    "render_log": f"WITH s AS ({texts.SQL['summarize_logs']}), e AS ({texts.SQL['log_errors']}), w AS ({texts.SQL['log_warnings']}), a AS ({texts.SQL['log_recommendations']}), "
    # A summary holds the first ten entries of each kind.
    "e10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY first_line) AS k FROM e) WHERE k <= 10), w10 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY first_line) AS k FROM w) WHERE k <= 10), "
    + ", ".join(
        f"{name} AS ({_listed(title, table, 'log_id', line, 5, noun, order)})"
        for name, title, table, line, noun, order in (
            ("pe", "### Errors", "e10", "'- ' || substr(message, 1, 300) || CASE WHEN count > 1 THEN ' *(×' || count || ')*' ELSE '' END", "more errors", "first_line"),
            ("pw", "### Warnings", "w10", "'- ' || substr(message, 1, 200) || CASE WHEN count > 1 THEN ' *(×' || count || ')*' ELSE '' END", "more warnings", "first_line"),
            ("pa", "### Recommended Actions", "a", "'1. ' || action", "more", "place"),
        )
    )
    + " SELECT s.log_id, " + _lines("'## Log Summary ' || CASE status WHEN 'error' THEN '❌' WHEN 'warning' THEN '⚠️' ELSE '✅' END", "'**Status:** ' || upper(status)", "'**Summary:** ' || summary", "''", "pe.part", "pw.part", "pa.part", _SAVED)
    + " AS text FROM s LEFT JOIN pe ON s.log_id = pe.log_id LEFT JOIN pw ON s.log_id = pw.log_id LEFT JOIN pa ON s.log_id = pa.log_id",
    "render_conversation": f"WITH s AS ({texts.SQL['summarize_conversation']}), "
    + ", ".join(f"l{i} AS ({texts.SQL[name]}), p{i} AS ({_listed(f'### {title}', f'l{i}', 'conv_id', f'{_text(f'- {sign}')} || entry', 50, 'more', 'place')})" for i, (title, name, sign) in enumerate(_LISTS))
    # Without a goal there is a stand-in.
    + " SELECT s.conv_id, " + _lines("'## Conversation Summary'", "''", f"coalesce(p0.part, {_lines(_text('### Goals'), "'- ' || goals", _text(''))})", *(f"p{i}.part" for i in range(1, 5)), "'### Key Context'", "key_context", "''", _SAVED)
    + " AS text FROM s " + " ".join(f"LEFT JOIN p{i} ON s.conv_id = p{i}.conv_id" for i in range(5)),
    "render_ranking": f"WITH r AS (SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS nth FROM ({code.SQL['semantic_relevance']})), l AS (SELECT nth, "
    + _lines("'### ' || nth || '. `' || path || '`'", "'Score: ' || score || ' ' || repeat('█', CAST(ceil(least(score, 50) / 5.0) AS INT))", "CASE WHEN reasons <> '' THEN 'Reasons: ' || replace(reasons, '|', ', ') END", "''")
    + " AS line FROM r) SELECT " + _lines(_text(f'## Semantic Relevance: "{code.QUERY}"'), "''", "'Found **' || count(*) || '** relevant files:'", "''", f"string_agg(line, {_NL} ORDER BY nth)") + " AS text FROM l",
    "render_duplicates": f"WITH g AS ({texts.SQL['dedupe_groups']}), {cte('items')}, f AS (SELECT g.*, substr(i.text, 1, 100) AS start FROM (SELECT * FROM g ORDER BY item_id LIMIT 10) g JOIN items i ON g.item_id = i.item_id) SELECT "
    + _lines("'## Deduplication Results'", "''", f"'### Duplicate Groups' || {_NL} || string_agg('- **' || type || '** (×' || count || '): `' || start || '…`', {_NL} ORDER BY item_id)") + " AS text FROM f",
    "render_status": f"WITH {cte('requests')}, p AS (SELECT CAST(project_id AS VARCHAR) AS id, 'project' || project_id AS name, max(ts) AS seen, count(DISTINCT session_id) AS n, CAST(sum(saved) AS BIGINT) AS saved FROM requests GROUP BY project_id), "
    "h AS (SELECT *, 7100 + list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda h, c: xor(h * 33, c) & 4294967295) % 900 AS port FROM p), "
    "s AS (SELECT lpad(CAST(session_id AS VARCHAR), 8, '0') AS id, 'project' || arg_max(project_id, ts) AS project, min(ts) AS began, CAST(sum(saved) AS BIGINT) AS saved FROM requests GROUP BY session_id), "
    f"pl AS (SELECT count(*) AS n, sum(saved) AS total, string_agg('    [' || id || '] ' || name || '  sessions=' || n || '  saved=' || {_SHORT.format(n='saved')} || '  port=' || port || '  (' || {_AGO.format(x=_SECONDS.format(t='seen'))} || ')', {_NL} ORDER BY seen DESC, id DESC) AS t FROM h), "
    f"sl AS (SELECT count(*) AS m, string_agg('    ' || substr(id, 1, 8) || '  ' || project || '  saved=' || {_SHORT.format(n='saved')} || '  (' || {_AGO.format(x=_SECONDS.format(t='began'))} || ')', {_NL} ORDER BY began, id) AS u FROM s) SELECT "
    + _lines("'Status'", "''", "'  Projects: ' || n", "'  Sessions: ' || m", f"CASE WHEN n > 0 THEN {_lines("''", "'  Projects:'", 't')} END", f"CASE WHEN m > 0 THEN {_lines("''", "'  Active sessions:'", 'u')} END", f"CASE WHEN total > 0 THEN {_NL} || '  Total tokens saved (all-time): ' || {_SHORT.format(n='total')} END")
    + " AS text FROM pl, sl",
    # A block ends with the line end before its fence. The logs look like logs; the other block of a prompt is short.
    "compress_prompt": f"WITH s AS ({texts.SQL['summarize_logs']}), n AS ({texts.SQL['log_status']}), {cte('log_lines')}, {LOGS_CTE}, "
    "m AS (SELECT l.log_id, content, ceil((length(content) + 1) / 4.0) AS o, ceil(length(compressed) / 4.0) AS p, "
    "concat_ws(chr(10), '[log compressed — ' || s.status || ', ' || least(n_errors, 10) || ' errors, ' || least(n_warnings, 10) || ' warnings]', compressed, CASE WHEN actions <> '' THEN 'Recommended: ' || replace(actions, '|', '; ') END) AS short "
    "FROM logs l JOIN s ON l.log_id = s.log_id JOIN n ON l.log_id = n.log_id), "
    "t AS (SELECT *, CASE WHEN len(string_split(content, chr(10))) >= 29 AND floor(greatest(o - p, 0) * 100 / o + 0.5) >= 20 THEN greatest(o - ceil(length(short) / 4.0), 0) ELSE 0 END AS saved FROM m) "
    "SELECT log_id AS prompt_id, concat('See', chr(10), '```', CASE WHEN log_id % 2 = 0 THEN 'log' ELSE '' END, chr(10), CASE WHEN saved > 0 THEN short ELSE content END, chr(10), '```', chr(10), 'and', chr(10), '```py', chr(10), 'def f(a):', chr(10), '    pass', chr(10), '```', chr(10), 'end') AS compressed, CAST(saved AS BIGINT) AS saved_tokens FROM t",
}
