"""Queries over budgets, duplicate items, logs and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ctxforge.functions.text import DOT, WS
from ctxforge.operators import budget as B
from ctxforge.operators import conversation as C
from ctxforge.operators import dedupe as D
from ctxforge.operators import logs as L
from ctxforge.plans.inputs import LOGS_CTE, cte, derived, logs


def _items(s, d):
    return derived(s, d, "items")


def _parts(s, d):
    return B.breakdown(derived(s, d, "budget_items"))


def _messages(s, d):
    return derived(s, d, "messages")


def _kept(s, d):
    return C.window(_messages(s, d))


def _entries(name):
    return lambda s, d: L.unique_entries(L.log_blocks(logs(s, d)).where(F.col("level") == name)).select("log_id", "message", "count", "first_line")


def _cue(name):
    return lambda s, d: C.cue_list(_kept(s, d), name)


def _savings(s, d):
    items = _items(s, d)
    return D.dedupe_savings(items, D.deduplicate(items))


QUERIES = {
    "budget_breakdown": lambda s, d: _parts(s, d),
    "budget_totals": lambda s, d: B.totals(_parts(s, d)),
    "budget_recommendation": lambda s, d: B.recommendations(_parts(s, d), 7000),
    "normalize_text": lambda s, d: _items(s, d).select("item_id", D.normalize(F.col("text")).alias("norm")),
    "item_types": lambda s, d: _items(s, d).select("item_id", D.item_type(F.col("text")).alias("type")),
    "dedupe_exact": lambda s, d: D.exact_groups(_items(s, d)).select("hash", "first_ord", "n", "item_id"),
    "jaccard_pairs": lambda s, d: D.similar_pairs(D.exact_groups(_items(s, d)), 0.5).select("a", "b", F.round("similarity", 6).alias("similarity")),
    "dedupe_near": lambda s, d: D.deduplicate(_items(s, d), 0.6).select("item_id", "n"),
    "dedupe_near_fixed": lambda s, d: D.deduplicate_fixed(_items(s, d), 0.6).select("item_id", "n"),
    "dedupe_groups": lambda s, d: D.duplicate_groups(_items(s, d), 0.6).select("hash", "type", "count", "item_id"),
    "dedupe_savings": _savings,
    "log_levels": lambda s, d: L.log_lines(logs(s, d)),
    "log_blocks": lambda s, d: L.log_blocks(logs(s, d)),
    "log_errors": _entries("error"),
    "log_warnings": _entries("warn"),
    "log_status": lambda s, d: L.summarize(logs(s, d)).select("log_id", "status", "n_errors", "n_warnings"),
    "log_recommendations": lambda s, d: L.recommendations(logs(s, d)),
    "summarize_logs": lambda s, d: L.summarize(logs(s, d)).select("log_id", "status", "summary", "compressed", F.array_join("actions", "|").alias("actions"), "tokens.*"),
    "conv_window": lambda s, d: _kept(s, d).select("conv_id", "turn"),
    "conv_goals": _cue("goals"),
    "conv_completed": _cue("completed"),
    "conv_pending": _cue("pending"),
    "conv_decisions": _cue("decisions"),
    "conv_blockers": _cue("blockers"),
    "conv_context": lambda s, d: C.contexts(_kept(s, d)),
    "summarize_conversation": lambda s, d: C.summarize(_messages(s, d)).select(
        "conv_id", F.array_join("goals", "|").alias("goals"), F.array_join("completed", "|").alias("completed"), F.array_join("blockers", "|").alias("blockers"), "key_context", "compressed", "tokens.*"
    ),
}

# SQL. Patterns are written anew for RE2: ASCII word boundaries, no lookaround.
PCT = "CAST(CASE WHEN {o} > 0 THEN floor({s} * 100 / {o} + 0.5) ELSE 0 END AS INT)"
_BREAK = (
    f"WITH {cte('budget_items')}, parts AS (SELECT budget_id, ord, name, priority, CAST(ceil(length(content) / 4.0) AS BIGINT) AS original_tokens, "
    "CAST(floor(ceil(length(content) / 4.0) * CAST(CASE priority WHEN 'critical' THEN 0.9 WHEN 'high' THEN 0.6 WHEN 'medium' THEN 0.3 ELSE 0.1 END AS DOUBLE) + 0.5) AS BIGINT) AS optimized_tokens FROM budget_items) "
)
_NORM = (
    f"WITH {cte('items')}, n AS (SELECT item_id, ord, text, regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    r"'\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?', '<timestamp>', 'g'), '0x[0-9a-fA-F]{4,}', '<addr>', 'g'), '\b\d{4,}\b', '<n>', 'g'), "
    rf"'[a-f0-9]{{8}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{12}}', '<uuid>', 'gi'), '[{WS}]+', ' ', 'g')), '^[{WS}]+', ''), '[{WS}]+$', '') AS norm FROM items), "
    "g AS (SELECT substr(sha256(norm), 1, 12) AS hash, min(ord) AS first_ord, count(*) AS n, arg_min(item_id, ord) AS item_id, arg_min(text, ord) AS text, any_value(norm) AS norm FROM n GROUP BY norm), "
    "w AS (SELECT first_ord, n, list_distinct(string_split(norm, ' ')) AS ws FROM g), "
    "pairs AS (SELECT a.first_ord AS a, b.first_ord AS b, a.n AS na, b.n AS nb, len(list_intersect(a.ws, b.ws)) AS i, len(a.ws) + len(b.ws) AS t FROM w a JOIN w b ON a.first_ord < b.first_ord "
    "AND len(a.ws) * 0.5 <= len(b.ws) AND len(b.ws) * 0.5 <= len(a.ws)), sim AS (SELECT a, b, na, nb, i / (t - i) AS similarity FROM pairs) "
)
_DIR = "dir AS (SELECT a AS ord, b AS other, na AS n, nb AS m FROM sim WHERE similarity >= {t} UNION ALL SELECT b, a, nb, na FROM sim WHERE similarity >= {t}) "
_WORDS = {"error": "error|err|fatal|exception|traceback|panic", "warn": "warn|warning", "info": "info|success|done|complete", "debug": "debug|trace|verbose"}
_LEVEL = "CASE " + " ".join(rf"WHEN regexp_matches(lower(line), '\b({w})\b') THEN '{k}'" for k, w in _WORDS.items()) + " END"


def _trim(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


_KEY = "lower(line)"
for _p, _m in ((r"\d{4}-\d{2}-\d{2}t[\d:.z+-]+", "<ts>"), ("0x[0-9a-f]+", "<addr>"), (r":\d+", ":<n>"), (f"[{WS}]+", " ")):
    _KEY = f"regexp_replace({_KEY}, '{_p}', '{_m}', 'g')"
_LINES = (
    f"WITH {cte('log_lines')}, {LOGS_CTE}, sp AS (SELECT log_id, string_split(content, chr(10)) AS ls FROM logs), "
    f"ln AS (SELECT log_id, CAST(no AS INT) AS line_no, {_trim('raw')} AS line FROM (SELECT log_id, unnest(ls) AS raw, generate_subscripts(ls, 1) - 1 AS no FROM sp)), "
    f"lv AS (SELECT *, {_LEVEL} AS level FROM ln) "
)
_BLOCKS = (
    _LINES + rf", isl AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(at[{WS}]+|File[{WS}]+\")') THEN 0 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY line_no) AS island FROM lv), "
    "st AS (SELECT *, min(CASE WHEN level = 'error' THEN line_no END) OVER (PARTITION BY log_id, island) AS start FROM isl), "
    "pt AS (SELECT log_id, CASE WHEN line_no >= start THEN start ELSE line_no END AS head, list(line ORDER BY line_no) AS ls, list(level ORDER BY line_no) AS vs FROM st WHERE line_no >= start OR level = 'warn' GROUP BY 1, 2), "
    "bl AS (SELECT log_id, head AS line_no, vs[1] AS level, ls[1] || CASE WHEN len(ls) > 1 THEN chr(10) || '  ' || array_to_string(ls[2:4], chr(10) || '  ') ELSE '' END "
    "|| CASE WHEN len(ls) > 4 THEN chr(10) || '  … (' || least(len(ls) - 4, 2) || ' more frames)' ELSE '' END AS message, ls[1] AS line FROM pt), "
    f"blocks AS (SELECT log_id, line_no, level, message, {_trim(_KEY)} AS key FROM bl) "
)
_UNIQ = _BLOCKS + ", u AS (SELECT log_id, level, key, arg_min(message, line_no) AS message, count(*) AS count, min(line_no) AS first_line FROM blocks GROUP BY log_id, level, key) "
_ADVICE = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{t}'" for p, t in L.ADVICE) + " END"
_SUMS = (
    _UNIQ + ", r AS (SELECT *, row_number() OVER (PARTITION BY log_id, level ORDER BY first_line) AS k FROM u), "
    f"adv AS (SELECT log_id, action, min(k) AS k FROM (SELECT log_id, {_ADVICE} AS action, k FROM r WHERE level = 'error' AND k <= 5 "
    f"UNION ALL SELECT log_id, '{L.DEPRECATED}', 99 FROM r WHERE level = 'warn' AND contains(lower(message), 'deprecated')) WHERE action IS NOT NULL GROUP BY log_id, action), "
    "act AS (SELECT log_id, action, row_number() OVER (PARTITION BY log_id ORDER BY k) - 1 AS place FROM adv), "
    "cnt AS (SELECT l.log_id, l.content, count(*) FILTER (WHERE r.level = 'error') AS n_errors, count(*) FILTER (WHERE r.level = 'warn') AS n_warnings, "
    "string_agg('ERROR: ' || substr(message, 1, 200) || CASE WHEN count > 1 THEN ' (×' || count || ')' ELSE '' END, chr(10) ORDER BY first_line) FILTER (WHERE r.level = 'error' AND k <= 3) AS es, "
    "string_agg('WARN: ' || substr(message, 1, 150) || CASE WHEN count > 1 THEN ' (×' || count || ')' ELSE '' END, chr(10) ORDER BY first_line) FILTER (WHERE r.level = 'warn' AND k <= 3) AS ws "
    "FROM logs l LEFT JOIN r ON l.log_id = r.log_id GROUP BY l.log_id, l.content), "
    "ss AS (SELECT *, CASE WHEN n_errors > 0 THEN 'error' WHEN n_warnings > 0 THEN 'warning' ELSE 'success' END AS status FROM cnt), "
    "sm AS (SELECT *, 'Status: ' || status || '. ' || CASE n_errors WHEN 0 THEN 'No errors' WHEN 1 THEN '1 unique error' ELSE n_errors || ' unique errors' END || '. ' "
    "|| CASE n_warnings WHEN 0 THEN 'No warnings' WHEN 1 THEN '1 unique warning' ELSE n_warnings || ' unique warnings' END AS summary FROM ss), "
    "cp AS (SELECT *, concat_ws(chr(10), summary, es, ws) AS compressed, CAST(ceil(length(content) / 4.0) AS BIGINT) AS original FROM sm) "
)
_MSG = f"WITH {cte('messages')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM messages), kept AS (SELECT * FROM ranked WHERE back > 3) "


def _cue_rows(cue) -> str:
    role = f" AND role = '{cue.role}'" if cue.role else ""
    parts = [
        "SELECT conv_id, turn, {k} AS pat, unnest(regexp_extract_all(text, '{p}', 1)) AS x, generate_subscripts(regexp_extract_all(text, '{p}', 1), 1) AS pos FROM kept WHERE TRUE{role}".format(
            k=k, p=p.replace(r"\A", "^").replace(r"\z", "$").replace("'", "''"), role=role
        )
        for k, p in enumerate(cue.patterns)
    ]
    return (
        f"{cue.name}_m AS (SELECT conv_id, turn, pat, pos, {_trim('x')} AS entry FROM ({' UNION ALL '.join(parts)})), "
        f"{cue.name}_d AS (SELECT conv_id, entry, row_number() OVER (PARTITION BY conv_id, entry ORDER BY turn, pat, pos) AS nth, turn, pat, pos FROM {cue.name}_m WHERE length(entry) > {cue.longer_than} AND length(entry) < 200), "
        f"{cue.name} AS (SELECT conv_id, entry, place FROM (SELECT conv_id, entry, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, pat, pos) - 1 AS INT) AS place FROM {cue.name}_d WHERE nth = 1) WHERE place < {cue.most})"
    )


_CTX = (
    "txt AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS t FROM kept GROUP BY conv_id), "
    rf"pth AS (SELECT conv_id, t, regexp_extract_all(t, '{C.PATHS}') AS ps, len(regexp_extract_all(t, '{C.FENCES}')) AS nb FROM txt), "
    "fp AS (SELECT conv_id, string_agg(p, ', ' ORDER BY pos) AS files FROM (SELECT conv_id, p, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS k FROM "
    "(SELECT conv_id, p, min(pos) AS pos FROM (SELECT conv_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS pos FROM pth) GROUP BY conv_id, p)) WHERE k <= 10 GROUP BY conv_id), "
    "ctx AS (SELECT pth.conv_id, coalesce(nullif(concat_ws('. ', 'Files: ' || files, CASE WHEN nb > 0 THEN 'Code blocks: ' || nb END), ''), 'General conversation') AS key_context FROM pth LEFT JOIN fp ON pth.conv_id = fp.conv_id)"
)
_CUES = {c.name: c for c in C.CUES}
_ALL_CUES = ", ".join(_cue_rows(c) for c in C.CUES)
_JOINED = ", ".join(f"{n}_s AS (SELECT conv_id, string_agg(entry, '; ' ORDER BY place) AS s, string_agg(entry, '|' ORDER BY place) AS p FROM {n} GROUP BY conv_id)" for n in _CUES)

SQL = {
    "budget_breakdown": _BREAK + "SELECT * FROM parts",
    "budget_totals": _BREAK + f"SELECT *, greatest(original_tokens - optimized_tokens, 0) AS saved_tokens, {PCT.format(o='original_tokens', s='greatest(original_tokens - optimized_tokens, 0)')} AS saved_percent FROM "
    "(SELECT budget_id, CAST(sum(original_tokens) AS BIGINT) AS original_tokens, CAST(sum(optimized_tokens) AS BIGINT) AS optimized_tokens FROM parts GROUP BY budget_id)",
    "budget_recommendation": _BREAK + "SELECT budget_id, CASE WHEN p <= 7000 THEN 'Context fits within budget after optimization. Using ' || CAST(floor(p * 100 / 7000 + 0.5) AS INT) || '% of 7,000 token budget. Safe to proceed.' "
    "ELSE concat_ws(' ', 'Over budget by ' || format('{:,}', p - 7000) || ' tokens.', 'Remove low-priority items (' || low || ') to free space.', 'Compress medium-priority items (' || med || ').', "
    "CASE WHEN o <= 200000 THEN 'Full context fits in 7,000 window — consider increasing budget.' ELSE 'Total exceeds model context window of 200,000 tokens — significant pruning needed.' END) END AS recommendation FROM "
    "(SELECT budget_id, CAST(sum(original_tokens) AS BIGINT) AS o, CAST(sum(optimized_tokens) AS BIGINT) AS p, string_agg(name, ', ' ORDER BY ord) FILTER (WHERE priority = 'low') AS low, "
    "string_agg(name, ', ' ORDER BY ord) FILTER (WHERE priority = 'medium') AS med FROM parts GROUP BY budget_id)",
    "normalize_text": _NORM + "SELECT item_id, norm FROM n",
    "item_types": f"WITH {cte('items')} SELECT item_id, CASE WHEN regexp_matches(text, '^[{WS}]*at[{WS}]+[A-Za-z0-9_]+|Traceback \\(most recent|Error:[{WS}]+') THEN 'stack-trace' "
    f"WHEN regexp_matches(text, '^(?:✓|✗|PASS|FAIL|ok|error|warn)[{WS}]+') THEN 'tool-output' WHEN regexp_matches(text, '^(?:user|assistant|system):[{WS}]+') THEN 'message' ELSE 'context-chunk' END AS type FROM items",
    "dedupe_exact": _NORM + "SELECT hash, first_ord, n, item_id FROM g",
    "jaccard_pairs": _NORM + "SELECT a, b, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.5",
    "dedupe_near": _NORM + ", " + _DIR.format(t=0.6) + "SELECT item_id, n FROM g WHERE n > 1 OR first_ord NOT IN (SELECT ord FROM dir)",
    "dedupe_near_fixed": _NORM + ", " + _DIR.format(t=0.6) + "SELECT item_id, n FROM g WHERE n > 1 OR first_ord NOT IN (SELECT ord FROM dir WHERE other < ord OR m > 1)",
    "dedupe_groups": _NORM + ", " + _DIR.format(t=0.6) + ", par AS (SELECT ord, min(other) AS p FROM dir WHERE n = 1 GROUP BY ord) "
    f"SELECT hash, CASE WHEN regexp_matches(text, '^[{WS}]*at[{WS}]+[A-Za-z0-9_]+|Traceback \\(most recent|Error:[{WS}]+') THEN 'stack-trace' "
    f"WHEN regexp_matches(text, '^(?:✓|✗|PASS|FAIL|ok|error|warn)[{WS}]+') THEN 'tool-output' WHEN regexp_matches(text, '^(?:user|assistant|system):[{WS}]+') THEN 'message' ELSE 'context-chunk' END AS type, "
    "n + (SELECT count(*) FROM par WHERE par.p = g.first_ord AND par.ord > par.p) AS count, item_id FROM g WHERE n > 1",
    "dedupe_savings": _NORM + ", " + _DIR.format(t=0.85) + ", k AS (SELECT text FROM g WHERE n > 1 OR first_ord NOT IN (SELECT ord FROM dir)), "
    "s AS (SELECT (SELECT count(*) FROM items) AS original_count, (SELECT count(*) FROM k) AS deduplicated_count, "
    "CAST(ceil(((SELECT sum(length(text)) FROM items) + 5 * ((SELECT count(*) FROM items) - 1)) / 4.0) AS BIGINT) AS original, CAST(ceil(((SELECT sum(length(text)) FROM k) + 5 * ((SELECT count(*) FROM k) - 1)) / 4.0) AS BIGINT) AS optimized) "
    f"SELECT *, greatest(original - optimized, 0) AS saved, {PCT.format(o='original', s='greatest(original - optimized, 0)')} AS saved_percent FROM s",
    "log_levels": _LINES + "SELECT * FROM lv",
    "log_blocks": _BLOCKS + "SELECT * FROM blocks",
    "log_errors": _UNIQ + "SELECT log_id, message, count, first_line FROM u WHERE level = 'error'",
    "log_warnings": _UNIQ + "SELECT log_id, message, count, first_line FROM u WHERE level = 'warn'",
    "log_status": _SUMS + "SELECT log_id, status, n_errors, n_warnings FROM ss",
    "log_recommendations": _SUMS + "SELECT log_id, place, action FROM act WHERE place < 5",
    "summarize_logs": _SUMS + "SELECT cp.log_id, status, summary, compressed, coalesce(a.actions, '') AS actions, original, CAST(ceil(length(compressed) / 4.0) AS BIGINT) AS optimized, "
    f"greatest(original - ceil(length(compressed) / 4.0), 0) AS saved, {PCT.format(o='original', s='greatest(original - ceil(length(compressed) / 4.0), 0)')} AS saved_percent "
    "FROM cp LEFT JOIN (SELECT log_id, string_agg(action, '|' ORDER BY place) AS actions FROM act WHERE place < 5 GROUP BY log_id) a ON cp.log_id = a.log_id",
    "conv_window": _MSG + "SELECT conv_id, turn FROM kept",
    **{f"conv_{n}": _MSG + ", " + _cue_rows(c) + f" SELECT conv_id, place, entry FROM {n}" for n, c in _CUES.items()},
    "conv_context": _MSG + ", " + _CTX + " SELECT conv_id, key_context FROM ctx",
    "summarize_conversation": _MSG + ", " + _ALL_CUES + ", " + _JOINED + ", " + _CTX + ", o AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS ot FROM messages GROUP BY conv_id), "
    f"a AS (SELECT o.conv_id, ot, coalesce(goals_s.p, '{C.NO_GOALS}') AS goals, coalesce(completed_s.p, '') AS completed, coalesce(blockers_s.p, '') AS blockers, coalesce(key_context, 'General conversation') AS key_context, "
    "concat_ws(chr(10), 'Goals: ' || goals_s.s, 'Done: ' || completed_s.s, 'Pending: ' || pending_s.s, 'Decisions: ' || decisions_s.s, 'Blockers: ' || blockers_s.s, 'Context: ' || coalesce(key_context, 'General conversation')) AS compressed "
    "FROM o LEFT JOIN ctx ON o.conv_id = ctx.conv_id " + " ".join(f"LEFT JOIN {n}_s ON o.conv_id = {n}_s.conv_id" for n in _CUES) + "), "
    "z AS (SELECT *, CAST(ceil(length(ot) / 4.0) AS BIGINT) AS original, CAST(ceil(length(compressed) / 4.0) AS BIGINT) AS optimized FROM a) "
    f"SELECT conv_id, goals, completed, blockers, key_context, compressed, original, optimized, greatest(original - optimized, 0) AS saved, {PCT.format(o='original', s='greatest(original - optimized, 0)')} AS saved_percent FROM z",
}
