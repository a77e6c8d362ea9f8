"""Queries over source files and directories, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ctxforge.functions.language import MARKERS, detect_language, project_language
from ctxforge.operators import code as K
from ctxforge.operators import postings as P
from ctxforge.operators import relevance as R
from ctxforge.operators import repo_graph as G
from ctxforge.operators import syntax
from ctxforge.plans.inputs import cte, derived
from ctxforge.sources import scan
from ctxforge.sources.scratch import fresh_path

QUERY = "where is the load of Part orders and service config?"


def _files(s, d):
    return derived(s, d, "files")


def _parsed(s, d, *languages):
    found = K.parse(_files(s, d))
    return found.where(F.col("language").isin(*languages)) if languages else found


def _meta(s, d):
    return _parsed(s, d).select("ord", "path", "language", "imports", "exports")


def _symbols(*languages):
    return lambda s, d: K.symbol_rows(_parsed(s, d, *languages))


def _imports(*languages):
    def query(s, d):
        rows = K.import_rows(_parsed(s, d, *languages))
        return rows.select("ord", "place", "source", F.array_join("specifiers", ",").alias("specifiers"), F.coalesce("is_default", F.lit(False)).alias("is_default"), F.coalesce("is_side_effect", F.lit(False)).alias("is_side_effect"))

    return query


def _sized(s, d):
    return _files(s, d).withColumn("size_bytes", F.octet_length("content").cast("long"))


def _doc(*languages):
    return lambda s, d: _parsed(s, d, *languages).select("ord", F.explode("comments").alias("comment"))


def _markers(s, d):
    n = F.col("n_nationkey")
    names = F.array(*(F.when((n % (i + 2)) == 0, m) for i, (m, _) in enumerate(MARKERS)))
    return s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", project_language(names).alias("language"))


#: Where a file of the tree stands; folders of dependencies and those that start with a dot are not entered.
TREE_PATH = "concat(CASE ord % 17 WHEN 0 THEN 'node_modules/x/' WHEN 1 THEN '.cfg/' WHEN 2 THEN '_app/' ELSE '' END, path)"


def _tree(s, d) -> str:
    """The files as a tree in the shared folder, written by the executors; of those with one path the first."""
    base = fresh_path(s, "tree").removeprefix("file://")
    files = _files(s, d).groupBy(F.expr(TREE_PATH).alias("path")).agg(F.min_by("content", "ord").alias("content"))

    def write(batches):
        for batch in batches:
            for row in batch.to_pylist():
                place = os.path.join(base, row["path"])
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "w", encoding="utf-8", newline="") as file:
                    file.write(row["content"])
            yield batch.select(["path"])

    files.mapInArrow(write, "path string").count()
    return base


def _scanned(s, d, **options):
    found = scan.read_tree(s, _tree(s, d), include_tests=True, **options)
    return found.select("ord", "path", "size_bytes", F.sha2("content", 256).alias("sha256"))


def _asked(s, d):
    """A question about every part."""
    query = F.concat(F.lit("Where is the "), F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(") of p-"), F.col("p_partkey"), F.lit(", the p_Brand and the BRAND?"))
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("query_id"), query.alias("query"))


def _ranked(s, d):
    """All files ranked for every kind of part."""
    queries = s.read.parquet(f"{d}/part.parquet").groupBy("p_type").agg(F.min("p_partkey").alias("query_id"))
    queries = queries.select("query_id", F.concat(F.lit("where is the "), F.col("p_type"), F.lit(" part of service-config in m"), F.col("query_id") % 50, F.lit("?")).alias("query"))
    return P.rank(P.build(_sized(s, d)), queries).select("query_id", "position", "ord", "score", F.array_join("reasons", "|").alias("reasons"))


JS = ("typescript", "javascript")
QUERIES = {
    "scan_tree": lambda s, d: _scanned(s, d, most=None).drop("ord"),
    "scan_first": lambda s, d: _scanned(s, d, most=100),
    "scan_relevance": lambda s, d: scan.read_for_relevance(s, _tree(s, d)).select("path", "size_bytes", F.sha2("content", 256).alias("sha256")),
    "detect_language": lambda s, d: _files(s, d).select("ord", "path", detect_language(F.col("path")).alias("language")),
    "project_language": _markers,
    "js_doc": _doc(*JS),
    "js_imports": _imports(*JS),
    "js_requires": lambda s, d: _imports(*JS)(s, d).where("NOT is_side_effect AND NOT is_default").select("ord", "place", "source", "specifiers"),
    "js_exports": lambda s, d: K.export_rows(_parsed(s, d, *JS)),
    "js_symbols": _symbols(*JS),
    "py_doc": _doc("python"),
    "py_imports": _imports("python"),
    "py_symbols": _symbols("python"),
    "go_symbols": _symbols("go"),
    "rust_symbols": _symbols("rust"),
    "infer_purpose": lambda s, d: K.compress(_files(s, d)).select("ord", "path", "purpose"),
    "syntax_symbols": lambda s, d: K.symbol_rows(syntax.dispatch(_files(s, d))),
    "syntax_imports": lambda s, d: K.import_rows(syntax.dispatch(_files(s, d))),
    "compress_syntax": lambda s, d: K.compress(_files(s, d), syntax.dispatch).select("ord", "path", "parser", "purpose", "summary", "skeleton", "tokens.*"),
    "symbol_delta": lambda s, d: syntax.largest_deltas(_files(s, d)),
    "symbol_kind_summary": lambda s, d: _parsed(s, d).select("ord", K.kind_summary(F.col("symbols")).alias("kinds")),
    "compress_file": lambda s, d: K.compress(_files(s, d)).select("ord", "language", "summary", "skeleton", "tokens.*"),
    "parser_lang_stats": lambda s, d: _parsed(s, d).groupBy("language").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.size("symbols")).cast("long").alias("symbols"), F.sum(F.size("imports")).cast("long").alias("imports"), F.round(F.avg(F.size("symbols")), 6).alias("avg_symbols")
    ),
    "dependency_graph": lambda s, d: G.dependency_graph(_meta(s, d)).select("ord", "src", F.array_join("deps", ",").alias("deps")),
    "file_relationships": lambda s, d: G.relationships(_meta(s, d)),
    "import_popularity": lambda s, d: G.import_popularity(_meta(s, d)),
    "language_mix": lambda s, d: G.language_mix(_meta(s, d)),
    "tech_stack": lambda s, d: G.tech_stack(_meta(s, d)),
    "dir_structure": lambda s, d: G.directory_structure(_meta(s, d)).select("dir", "n"),
    "important_files": lambda s, d: G.important_files(_meta(s, d)),
    "entry_points": lambda s, d: G.entry_points(_meta(s, d)).select("path", "reason"),
    "compress_directory": lambda s, d: G.compress_directory(_meta(s, d), "/srv/shop").select("architecture", "entry_points", "tokens.original", "tokens.optimized", "tokens.saved", "tokens.saved_percent"),
    "query_terms": lambda s, d: P.query_terms(_asked(s, d)),
    "relevance_scores": lambda s, d: R.score(_sized(s, d), QUERY).select("ord", "path", "score", F.array_join("reasons", "|").alias("reasons")),
    "semantic_relevance": lambda s, d: R.rank(_sized(s, d), QUERY).select("ord", "path", "score", F.array_join("reasons", "|").alias("reasons")),
    "relevance_batch": _ranked,
    "relevance_savings": lambda s, d: R.ranking_savings(_sized(s, d), QUERY),
}

# SQL. What the rules must find is written out here once more, for RE2, and not taken from the library, so that a wrong pattern there shows.

_JS_IMPORT = r"""^import\s+(?:type\s+)?(?:\{([^}]*)\}|([A-Za-z0-9_]+)|\*\s+as\s+([A-Za-z0-9_]+))(?:\s*,\s*(?:\{([^}]*)\}|([A-Za-z0-9_]+)))?\s+from\s+['"]([^'"]+)['"]"""
_JS_SIDE_EFFECT = r"""^import\s+['"]([^'"]+)['"]"""
_JS_REQUIRE = r"""(?:const|let|var)\s+\{?([^}=]+)\}?\s*=\s*require\(['"]([^'"]+)['"]\)"""
_JS_DEFAULT = r"^export\s+default\s"
_JS_LIST = r"^export\s+\{([^}]+)\}"
_JS_FUNCTION = r"^(export\s+)?(export\s+default\s+)?(async\s+)?function\s+([A-Za-z0-9_]+)\s*(<[^>]*>)?\s*\(([^)]*)\)"
_JS_CLASS = r"^(export\s+)?(export\s+default\s+)?(?:abstract\s+)?class\s+([A-Za-z0-9_]+)"
_JS_INTERFACE = r"^(export\s+)?interface\s+([A-Za-z0-9_]+)"
_JS_TYPE = r"^(export\s+)?type\s+([A-Za-z0-9_]+)\s*(?:<[^>]*)?\s*="
_JS_CONST = r"^(export\s+)?const\s+([A-Za-z0-9_]+)\s*(?::[^=]+)?\s*=\s*(?:async\s+)?\("
_JS_ENUM = r"^(export\s+)?(?:const\s+)?enum\s+([A-Za-z0-9_]+)"
_PY_FROM = r"^from\s+([A-Za-z0-9_.]+)\s+import\s+(.*)"
_PY_IMPORT = r"^import\s+([A-Za-z0-9_.,\s]+)"
_PY_DEF = r"^(?:async\s+)?def\s+([A-Za-z0-9_]+)\s*\((.*)\)"
_PY_CLASS = r"^class\s+([A-Za-z0-9_]+)"
_GO_IMPORT, _GO_FUNC = r'^import\s+"([^"]+)"', r"^func\s+([A-Za-z0-9_]+)"
_RUST_USE, _RUST_FN = r"^use\s+([A-Za-z0-9_:]+)", r"^(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z0-9_]+)"
_LANGUAGE_OF = {
    "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi", "rust": "rs", "go": "go", "java": "java", "kotlin": "kt", "swift": "swift", "ruby": "rb", "php": "php", "cpp": "cpp cc cxx hpp", "c": "c h",
}
_PURPOSE_OF = """index|main|app=Application entry point
server|api=HTTP server / API handler
router|routes?=Routing definitions
controller=Request controller
service=Business logic service
model|schema=Data model / schema definition
util|helper|lib=Utility functions
config|settings?=Configuration
test|spec|__tests__=Test suite
type|interface=Type definitions
hook=React hook / lifecycle hook
component=UI component
store|redux|slice=State management
middleware=Middleware
auth=Authentication / authorization
db|database|migration=Database operations
parse|parser=Parser / code analysis
compress|optim=Compression / optimization
analytics|track=Analytics / tracking"""
_PURPOSES = [tuple(x.split("=")) for x in _PURPOSE_OF.splitlines()]
_MARKED = (("package.json", "typescript"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("requirements.txt", "python"), ("pyproject.toml", "python"))
_STACK_OF = (
    ("react", "React"), ("next", "Next.js"), ("vue", "Vue"), ("express", "Express"), ("fastify", "Fastify"), ("@nestjs", "NestJS"), ("prisma", "Prisma"), ("@prisma", "Prisma"),
    ("typeorm", "TypeORM"), ("mongoose", "Mongoose"), ("zod", "Zod"), ("@modelcontextprotocol", "MCP"), ("vitest", "Testing"), ("jest", "Testing"),
)
_IMPORTANT_PATHS = (
    ("^(src/)?index[.](ts|js)$", "Entry point"), ("^(src/)?main[.](ts|js)$", "Main entry"), ("^(src/)?app[.](ts|js|tsx)$", "App root"),
    ("server/index[.](ts|js)$", "Server entry"), ("config[.](ts|js)$", "Configuration"), ("types/index[.](ts|js)$", "Type definitions"),
)
_TERMS = ["where", "load", "part", "orders", "service", "config"]

_TREE = (
    f"WITH {cte('files')}, t AS (SELECT {TREE_PATH} AS path, arg_min(content, ord) AS content FROM files GROUP BY 1), "
    "k AS (SELECT path, strlen(content) AS size_bytes, sha256(content) AS sha256, string_split(path, '/') AS parts FROM t WHERE NOT starts_with(path, 'node_modules/') AND NOT starts_with(path, '.cfg/') AND regexp_matches(path, '[.](EXTENSIONS)$')), "
    "o AS (SELECT *, row_number() OVER (ORDER BY parts) AS k FROM k) "
)
_SOURCES, _RANKED = "ts|tsx|js|jsx|mjs|cjs|py|rs|go|java|kt|swift|rb|php|cpp|cc|c|h", "ts|tsx|js|jsx|py|go|rs"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _g(pattern: str, n: int) -> str:
    return f"regexp_extract(line, {_q(pattern)}, {n})"


def _m(pattern: str) -> str:
    return f"regexp_matches(line, {_q(pattern)})"


def _names(x: str, alias: int | None) -> str:
    part = {None: "trim(p)", 0: r"trim(string_split_regex(trim(p), '\s+as\s+')[1])", 1: r"coalesce(trim(string_split_regex(trim(p), '\s+as\s+')[2]), trim(p))"}[alias]
    return f"list_filter(list_transform(string_split({x}, ','), lambda p: {part}), lambda p: p <> '')"


_EXT = "lower(list_last(string_split(path, '.')))"
_LANG = f"coalesce(CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for v, ks in _LANGUAGE_OF.items() for k in ks.split()) + " END, 'unknown')"
_BASE = f"WITH {cte('files')}, fl AS (SELECT *, {_LANG} AS language, string_split(content, chr(10)) AS ls FROM files), "
_BASE += r"ln AS (SELECT ord, path, language, trim(raw, ' ' || chr(9) || chr(13)) AS line, no FROM (SELECT ord, path, language, unnest(ls) AS raw, generate_subscripts(ls, 1) AS no FROM fl)), "
_ISJS = "language IN ('typescript', 'javascript')"
_SKIP = f"NOT {_m(_JS_IMPORT)} AND NOT {_m(_JS_SIDE_EFFECT)}"
_I = "SELECT ord, path, language, no, {k} AS k, {source} AS source, {spec} AS specifiers, {default} AS is_default, {side} AS is_side_effect FROM ln WHERE {where}"
_star = f"CASE WHEN {_g(_JS_IMPORT, 3)} <> '' THEN ['* as ' || {_g(_JS_IMPORT, 3)}] ELSE [] END"
_def = f"CASE WHEN {_g(_JS_IMPORT, 2)} <> '' THEN [{_g(_JS_IMPORT, 2)}] ELSE [] END"
_spec = f"list_concat(list_concat({_names(_g(_JS_IMPORT, 1), 0)}, {_names(_g(_JS_IMPORT, 4), 0)}), list_concat({_def}, {_star}))"
_strs = "CAST([] AS VARCHAR[])"
_IMP = " UNION ALL ".join(
    [
        _I.format(k=0, source=_g(_JS_IMPORT, 6), spec=_spec, default=f"{_g(_JS_IMPORT, 2)} <> ''", side="FALSE", where=f"{_ISJS} AND {_m(_JS_IMPORT)}"),
        _I.format(k=0, source=_g(_JS_SIDE_EFFECT, 1), spec=_strs, default="FALSE", side="TRUE", where=f"{_ISJS} AND {_m(_JS_SIDE_EFFECT)} AND NOT {_m(_JS_IMPORT)}"),
        _I.format(k=0, source=_g(_JS_REQUIRE, 2), spec=_names(_g(_JS_REQUIRE, 1), None), default="FALSE", side="FALSE", where=f"{_ISJS} AND {_m(_JS_REQUIRE)} AND {_SKIP}"),
        _I.format(k=0, source=_g(_PY_FROM, 1), spec=f"CASE WHEN {_g(_PY_FROM, 2)} = '*' THEN ['*'] ELSE {_names(f'''regexp_replace({_g(_PY_FROM, 2)}, '[()]', '', 'g')''', 0)} END", default="FALSE", side="FALSE", where=f"language = 'python' AND {_m(_PY_FROM)}"),
        f"SELECT ord, path, language, no, generate_subscripts(xs, 1) AS k, unnest(xs) AS source, [unnest(xs)] AS specifiers, FALSE, FALSE FROM (SELECT *, {_names(_g(_PY_IMPORT, 1), 0)} AS xs FROM ln WHERE language = 'python' AND {_m(_PY_IMPORT)} AND NOT {_m(_PY_FROM)})",
        _I.format(k=0, source=_g(_GO_IMPORT, 1), spec=_strs, default="FALSE", side="FALSE", where=f"language = 'go' AND {_m(_GO_IMPORT)}"),
        _I.format(k=0, source=_g(_RUST_USE, 1), spec=_strs, default="FALSE", side="FALSE", where=f"language = 'rust' AND {_m(_RUST_USE)}"),
    ]
)
_IMPORTS = _BASE + f"im0 AS ({_IMP}), im AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY no, k) - 1 AS INT) AS place FROM im0)"


def _s(rule, kind, name, exported, where, signature="NULL", is_async="NULL"):
    return f"SELECT ord, path, language, no, {rule} AS rule, {name} AS name, '{kind}' AS kind, {signature} AS signature, {exported} AS exported, {is_async} AS is_async FROM ln WHERE {where}"


_sig = r"trim(regexp_replace(line, '\s*\{.*$', ''))"
_js = f"{_ISJS} AND {_SKIP}"
_one = lambda p: f"{_g(p, 1)} <> ''"
_two = lambda p: f"({_g(p, 1)} <> '' OR {_g(p, 2)} <> '')"
_SYM = " UNION ALL ".join(
    [
        _s(1, "function", _g(_JS_FUNCTION, 4), _two(_JS_FUNCTION), f"{_js} AND {_m(_JS_FUNCTION)}", _sig, f"{_g(_JS_FUNCTION, 3)} <> ''"),
        _s(2, "class", _g(_JS_CLASS, 3), _two(_JS_CLASS), f"{_js} AND {_m(_JS_CLASS)}", _sig),
        _s(3, "interface", _g(_JS_INTERFACE, 2), _one(_JS_INTERFACE), f"{_js} AND {_m(_JS_INTERFACE)}"),
        _s(4, "type", _g(_JS_TYPE, 2), _one(_JS_TYPE), f"{_js} AND {_m(_JS_TYPE)}"),
        _s(5, "function", _g(_JS_CONST, 2), _one(_JS_CONST), f"{_js} AND {_m(_JS_CONST)}", is_async="contains(line, 'async ')"),
        _s(6, "enum", _g(_JS_ENUM, 2), _one(_JS_ENUM), f"{_js} AND {_m(_JS_ENUM)}"),
        _s(1, "function", _g(_PY_DEF, 1), f"{_g(_PY_DEF, 1)}[1] <> '_'", f"language = 'python' AND {_m(_PY_DEF)}", is_async="starts_with(line, 'async')"),
        _s(2, "class", _g(_PY_CLASS, 1), "TRUE", f"language = 'python' AND {_m(_PY_CLASS)}"),
        _s(1, "function", _g(_GO_FUNC, 1), f"regexp_matches({_g(_GO_FUNC, 1)}, '^[A-Z]')", f"language = 'go' AND {_m(_GO_FUNC)}"),
        _s(1, "function", _g(_RUST_FN, 1), "starts_with(line, 'pub ')", f"language = 'rust' AND {_m(_RUST_FN)}"),
    ]
)
_SYMBOLS = _IMPORTS + f", sy AS (SELECT *, CAST(row_number() OVER (PARTITION BY ord ORDER BY no, rule) - 1 AS INT) AS place FROM ({_SYM}))"
_EXPORTS = (
    _SYMBOLS + f", ex0 AS (SELECT ord, no, -2 AS rule, 0 AS k, 'default' AS name FROM ln WHERE {_js} AND {_m(_JS_DEFAULT)} "
    f"UNION ALL SELECT ord, no, -1, generate_subscripts(xs, 1), unnest(xs) FROM (SELECT *, {_names(_g(_JS_LIST, 1), 1)} AS xs FROM ln WHERE {_js} AND {_m(_JS_LIST)}) "
    "UNION ALL SELECT ord, no, rule, 0, name FROM sy WHERE exported), "
    "ex1 AS (SELECT e.*, f.path, f.language, row_number() OVER (PARTITION BY e.ord, e.name ORDER BY no, rule, k) AS nth FROM ex0 e JOIN fl f ON e.ord = f.ord), "
    "ex AS (SELECT ord, path, language, name, CAST(row_number() OVER (PARTITION BY ord ORDER BY no, rule, k) - 1 AS INT) AS place FROM ex1 WHERE nth = 1 OR language NOT IN ('typescript', 'javascript', 'python'))"
)
_COMMENTS = (
    ", cm AS (SELECT ord, language, CASE WHEN language = 'python' THEN nullif(trim(string_split(trim(regexp_extract(content, '^(?:[\"]{3})([\\s\\S]*?)(?:[\"]{3})', 1), chr(10) || ' '), chr(10))[1]), '') "
    f"WHEN {_ISJS} THEN nullif(array_to_string(list_filter(list_transform(string_split(regexp_extract(content, '^\\s*/\\*\\*([\\s\\S]*?)\\*/', 1), chr(10)), lambda x: trim(regexp_replace(x, '^\\s*\\*\\s?', ''))), lambda x: x <> ''), ' '), '') END AS comment FROM fl)"
)
_STEM = r"lower(regexp_replace(list_last(string_split(path, '/')), '\.[^.]+$', ''))"
_AGG = (
    _EXPORTS + _COMMENTS + ", kd0 AS (SELECT ord, kind, count(*) AS n, min(place) AS first, string_agg(name, ', ' ORDER BY place) FILTER (WHERE kth <= 5) AS names FROM "
    "(SELECT *, row_number() OVER (PARTITION BY ord, kind ORDER BY place) AS kth FROM sy) GROUP BY ord, kind), "
    "kd AS (SELECT ord, string_agg(n || ' ' || kind || CASE n WHEN 1 THEN '' ELSE 's' END || ': ' || names || CASE WHEN n > 5 THEN '…' ELSE '' END, '; ' ORDER BY first) AS kinds FROM kd0 GROUP BY ord), "
    "sa AS (SELECT ord, count(*) FILTER (WHERE kind = 'class') AS nc, count(*) FILTER (WHERE kind = 'function') AS nf, string_agg(name, ', ' ORDER BY place) FILTER (WHERE kind = 'class') AS cs, "
    "string_agg(CASE WHEN exported THEN '+' ELSE '-' END || kind || ':' || name, ' ' ORDER BY place) AS sk FROM sy GROUP BY ord), "
    "ia AS (SELECT ord, string_agg(source || '[' || array_to_string(specifiers, ',') || ']', ' | ' ORDER BY place) AS it, string_agg(list_last(string_split(source, '/')), ', ' ORDER BY place) FILTER (WHERE place < 3) AS tails FROM im GROUP BY ord), "
    "ux AS (SELECT ord, string_agg(source, ', ' ORDER BY p) AS uses FROM (SELECT ord, source, row_number() OVER (PARTITION BY ord ORDER BY place) AS p FROM im WHERE source[1] NOT IN ('.', '/')) WHERE p <= 5 GROUP BY ord), "
    "dp AS (SELECT ord, string_agg(source, ', ' ORDER BY p) AS deps FROM (SELECT ord, source, min(place) AS p FROM im GROUP BY ord, source) GROUP BY ord), "
    "ea AS (SELECT ord, count(*) AS ne, string_agg(name, ', ' ORDER BY place) AS es, string_agg(name, ', ' ORDER BY place) FILTER (WHERE place < 8) AS e8 FROM ex GROUP BY ord), "
    "pu AS (SELECT f.ord, f.path, f.language, f.content, kinds, sk, it, uses, deps, ne, es, e8, CASE WHEN length(comment) > 10 AND length(comment) < 200 THEN comment "
    + " ".join(f"WHEN regexp_matches({_STEM}, '{p}') THEN '{label}'" for p, label in _PURPOSES)
    + " WHEN nc = 1 THEN cs || ' class implementation' WHEN nc > 1 THEN cs || ' class implementations' WHEN nf > 0 THEN 'Module with ' || nf || ' exported function' || CASE nf WHEN 1 THEN '' ELSE 's' END "
    "WHEN tails IS NOT NULL THEN 'Module using ' || tails ELSE 'Source module' END AS purpose FROM fl f LEFT JOIN cm ON f.ord = cm.ord LEFT JOIN kd ON f.ord = kd.ord LEFT JOIN sa ON f.ord = sa.ord LEFT JOIN ia ON f.ord = ia.ord "
    "LEFT JOIN ux ON f.ord = ux.ord LEFT JOIN dp ON f.ord = dp.ord LEFT JOIN ea ON f.ord = ea.ord)"
)
_SKEL = (
    _AGG + ", su AS (SELECT *, concat_ws('. ', list_last(string_split(path, '/')) || ' (' || language || ')', 'Defines: ' || kinds, 'Exports: ' || e8 || CASE WHEN ne > 8 THEN '… (+' || (ne - 8) || ' more)' ELSE '' END, 'Uses: ' || uses) AS summary FROM pu), "
    "sk2 AS (SELECT *, 'Purpose: ' || purpose || chr(10) || 'Summary: ' || summary || chr(10) || 'Imports: ' || coalesce(it, '') || chr(10) || 'Exports: ' || coalesce(es, '') || chr(10) || 'Symbols: ' || coalesce(sk, '') || chr(10) || 'Deps: ' || coalesce(deps, '') AS skeleton FROM su), "
    "tk AS (SELECT *, CAST(ceil(length(content) / 4.0) AS BIGINT) AS original, CAST(ceil(length(skeleton) / 4.0) AS BIGINT) AS optimized FROM sk2)"
)
_PCT = "CAST(CASE WHEN {o} > 0 THEN floor({s} * 100 / {o} + 0.5) ELSE 0 END AS INT)"
_DIRNAME = "array_to_string(string_split(path, '/')[1:-2], '/')"
_EDGES = (
    _IMPORTS + f", rel AS (SELECT ord, path AS src, place, CASE WHEN starts_with(source, '../') THEN trim(array_to_string(string_split(path, '/')[1:-3], '/') || '/' || substr(source, 4), '/') ELSE {_DIRNAME} || '/' || substr(source, 3) END AS t FROM im WHERE source[1] = '.'), "
    "lst AS (SELECT path, min(ord) AS dord FROM files GROUP BY path), "
    "ed AS (SELECT r.ord, r.src, r.place, arg_min(l.path, l.dord) AS dst FROM rel r JOIN lst l ON l.path IN (r.t, r.t || '.ts', r.t || '.js', r.t || '/index.ts') GROUP BY r.ord, r.src, r.place)"
)
_IMPF = (
    _EXPORTS + ", ne AS (SELECT f.ord, f.path, count(e.name) AS n FROM fl f LEFT JOIN ex e ON f.ord = e.ord GROUP BY f.ord, f.path), "
    "rs AS (SELECT ord, path, CASE " + " ".join(f"WHEN regexp_matches(lower(path), '{p}') THEN '{r}'" for p, r in _IMPORTANT_PATHS) + " WHEN n > 5 THEN 'High export count (' || n || ' exports)' END AS reason FROM ne), "
    "impf AS (SELECT min(ord) AS ord, path, arg_min(reason, ord) AS reason FROM rs WHERE reason IS NOT NULL GROUP BY path ORDER BY 1 LIMIT 15)"
)
_LMIX = "lm AS (SELECT language, count(*) AS n, min(ord) AS first FROM fl GROUP BY language ORDER BY n DESC, first LIMIT 3)"
_TECH = (
    ", " + _LMIX + ", tc AS (SELECT name, 0 AS tier, min(ord * 1000 + place) AS spot FROM (SELECT ord, place, CASE " + " ".join(f"WHEN starts_with(source, '{p}') THEN '{n}'" for p, n in _STACK_OF)
    + " END AS name FROM im) WHERE name IS NOT NULL GROUP BY name UNION ALL SELECT upper(language[1]) || substr(language, 2), 1, row_number() OVER (ORDER BY n DESC, first) FROM lm WHERE language <> 'unknown'), "
    "ts AS (SELECT CAST(row_number() OVER (ORDER BY tier, spot) AS INT) AS place, name FROM tc)"
)
_SCORE = " + ".join(
    f"CASE WHEN contains(lower(path), '{t}') THEN 10 ELSE 0 END + CASE WHEN contains(lower(list_last(string_split(path, '/'))), '{t}') THEN 15 ELSE 0 END "
    f"+ CAST(least(floor(len(regexp_extract_all(lower(content), '\\b{t}\\b')) / log2(len(string_split(content, chr(10))) + 2) * 4 + 0.5), 20) AS INT) + CASE WHEN {{decl_{i}}} THEN 20 ELSE 0 END"
    for i, t in enumerate(_TERMS)
)
_DECL = [rf"regexp_matches(content, '(?i)export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+\w*{t}\w*|def\s+\w*{t}\w*|func\s+\w*{t}\w*')" for t in _TERMS]
for _i, _d in enumerate(_DECL):
    _SCORE = _SCORE.replace(f"{{decl_{_i}}}", _d)
_REASONS = ", ".join(
    f"CASE WHEN contains(lower(path), '{t}') THEN 'Path contains \"{t}\"' END, CASE WHEN len(regexp_extract_all(lower(content), '\\b{t}\\b')) >= 3 THEN '\"{t}\" appears ' || len(regexp_extract_all(lower(content), '\\b{t}\\b')) || 'x' END, CASE WHEN {d} THEN 'Exports symbol matching \"{t}\"' END"
    for t, d in zip(_TERMS, _DECL)
)
_SCORED = _BASE + f"sc AS (SELECT ord, path, content, {_SCORE} + CASE WHEN regexp_matches(path, 'index\\.(ts|js|py)$') THEN 5 ELSE 0 END + CASE WHEN starts_with(path, 'src/') THEN 3 ELSE 0 END AS score, concat_ws('|', {_REASONS}) AS reasons FROM fl)"


def _rows(cond: str, *columns: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {{}} WHERE {cond}"


_SYCOLS = "ord, path, place, name, kind, signature, exported, is_async, CAST(no AS INT) AS line"
_IMCOLS = "ord, place, source, array_to_string(specifiers, ',') AS specifiers, is_default, is_side_effect"
SQL = {
    "scan_tree": _TREE.replace("EXTENSIONS", _SOURCES) + "SELECT path, size_bytes, sha256 FROM o",
    "scan_first": _TREE.replace("EXTENSIONS", _SOURCES) + "SELECT k - 1 AS ord, path, size_bytes, sha256 FROM o WHERE k <= 100",
    # A folder counts as entered if it stands before the 500th file.
    "scan_relevance": _TREE.replace("EXTENSIONS", _RANKED) + "SELECT path, size_bytes, sha256 FROM o WHERE len(parts) = 1 OR list_slice(parts, 1, len(parts) - 1) < coalesce((SELECT parts FROM o WHERE k = 500), ['\U0010FFFF'])",
    "detect_language": _BASE.rstrip(", ") + " SELECT ord, path, language FROM fl",
    "project_language": "SELECT n_nationkey, CASE " + " ".join(f"WHEN n_nationkey % {i + 2} = 0 THEN '{lang}'" for i, (_, lang) in enumerate(_MARKED)) + " ELSE 'unknown' END AS language FROM nation",
    "js_doc": _AGG + f" SELECT ord, comment FROM cm WHERE {_ISJS} AND comment IS NOT NULL",
    "py_doc": _AGG + " SELECT ord, comment FROM cm WHERE language = 'python' AND comment IS NOT NULL",
    "js_imports": _IMPORTS + f" SELECT {_IMCOLS} FROM im WHERE {_ISJS}",
    "py_imports": _IMPORTS + f" SELECT {_IMCOLS} FROM im WHERE language = 'python'",
    "js_requires": _IMPORTS + f" SELECT ord, place, source, array_to_string(specifiers, ',') AS specifiers FROM im WHERE {_ISJS} AND NOT is_side_effect AND NOT is_default",
    "js_exports": _EXPORTS + f" SELECT ord, path, place, name FROM ex WHERE {_ISJS}",
    "js_symbols": _SYMBOLS + f" SELECT {_SYCOLS} FROM sy WHERE {_ISJS}",
    "py_symbols": _SYMBOLS + f" SELECT {_SYCOLS} FROM sy WHERE language = 'python'",
    "go_symbols": _SYMBOLS + f" SELECT {_SYCOLS} FROM sy WHERE language = 'go'",
    "rust_symbols": _SYMBOLS + f" SELECT {_SYCOLS} FROM sy WHERE language = 'rust'",
    "infer_purpose": _AGG + " SELECT ord, path, purpose FROM pu",
    "symbol_kind_summary": _AGG + " SELECT ord, coalesce(kinds, '') AS kinds FROM pu",
    "compress_file": _SKEL + f" SELECT ord, language, summary, skeleton, original, optimized, greatest(original - optimized, 0) AS saved, {_PCT.format(o='original', s='greatest(original - optimized, 0)')} AS saved_percent FROM tk",
    "parser_lang_stats": _SYMBOLS + ", c AS (SELECT f.ord, f.language, (SELECT count(*) FROM sy WHERE sy.ord = f.ord) AS ns, (SELECT count(*) FROM im WHERE im.ord = f.ord) AS ni FROM fl f) "
    "SELECT language, count(*) AS files, CAST(sum(ns) AS BIGINT) AS symbols, CAST(sum(ni) AS BIGINT) AS imports, round(avg(ns), 6) AS avg_symbols FROM c GROUP BY language",
    "dependency_graph": _EDGES + " SELECT ord, src, string_agg(dst, ',' ORDER BY place) AS deps FROM ed GROUP BY ord, src",
    "file_relationships": _EDGES + " SELECT ord, place, src AS \"from\", dst AS \"to\", 'imports' AS relationship FROM ed ORDER BY ord, place LIMIT 50",
    "import_popularity": _IMPORTS + " SELECT source, count(*) AS n FROM im WHERE source[1] = '.' GROUP BY source",
    "language_mix": _BASE + _LMIX + " SELECT language, n FROM lm",
    "tech_stack": _IMPORTS + _TECH + " SELECT place, name FROM ts",
    "dir_structure": _BASE.rstrip(", ") + " SELECT string_split(path, '/')[1] AS dir, count(*) AS n FROM fl GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 8",
    "important_files": _IMPF + " SELECT ord, path, reason FROM impf",
    "entry_points": _IMPF + " SELECT path, reason FROM impf WHERE reason LIKE '%entry%' OR reason LIKE '%Entry%'",
    "compress_directory": _IMPF + _TECH + ", ds AS (SELECT string_split(path, '/')[1] AS dir, count(*) AS n, min(ord) AS first FROM fl GROUP BY 1 ORDER BY n DESC, first LIMIT 8), "
    "ep AS (SELECT string_agg(path, ', ' ORDER BY ord) AS entries FROM impf WHERE reason LIKE '%entry%' OR reason LIKE '%Entry%'), "
    "ar AS (SELECT concat_ws('. ', 'Directory: /srv/shop', 'Files analyzed: ' || (SELECT count(*) FROM fl), 'Tech stack: ' || (SELECT string_agg(name, ', ' ORDER BY place) FROM ts), "
    "'Structure: ' || (SELECT string_agg(dir || '/ (' || n || ' files)', ', ' ORDER BY n DESC, first) FROM ds), 'Entry points: ' || (SELECT entries FROM ep)) AS architecture), "
    "li AS (SELECT ord, string_agg(source, chr(10) ORDER BY place) AS s FROM im GROUP BY ord), le AS (SELECT ord, string_agg(name, chr(10) ORDER BY place) AS s FROM ex GROUP BY ord), "
    "oc AS (SELECT sum(length('// ' || path) + 2 + length(coalesce(li.s, '')) + length(coalesce(le.s, ''))) + 2 * (count(*) - 1) AS chars FROM fl LEFT JOIN li ON fl.ord = li.ord LEFT JOIN le ON fl.ord = le.ord), "
    "sh AS (SELECT architecture || chr(10) || '{\"importantFiles\":[' || (SELECT string_agg('{\"path\":\"' || path || '\",\"reason\":\"' || reason || '\"}', ',' ORDER BY ord) FROM impf) || '],\"techStack\":[' || (SELECT string_agg('\"' || name || '\"', ',' ORDER BY place) FROM ts) || ']}' AS shown FROM ar), "
    "fin AS (SELECT architecture, (SELECT entries FROM ep) AS entry_points, CAST(ceil((SELECT chars FROM oc) / 4.0) AS BIGINT) AS original, CAST(ceil(length((SELECT shown FROM sh)) / 4.0) AS BIGINT) AS optimized FROM ar) "
    f"SELECT *, greatest(original - optimized, 0) AS saved, {_PCT.format(o='original', s='greatest(original - optimized, 0)')} AS saved_percent FROM fin",
    "query_terms": r"WITH w AS (SELECT p_partkey AS query_id, string_split_regex(regexp_replace(lower(concat('Where is the ', p_name, ' (', p_type, ') of p-', p_partkey, ', the p_Brand and the BRAND?')), '[^a-z0-9\s_-]', ' ', 'g'), '\s+') AS ws FROM part), "
    "t AS (SELECT query_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS n, unnest(ws) AS term FROM w) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) - 1 AS INT) AS place, term FROM t WHERE length(term) > 2 AND term NOT IN ('the', 'and')",
    "relevance_batch": f"WITH {cte('files')}, q AS (SELECT min(p_partkey) AS query_id, concat('where is the ', p_type, ' part of service-config in m', min(p_partkey) % 50, '?') AS query FROM part GROUP BY p_type), "
    r"w AS (SELECT query_id, string_split_regex(regexp_replace(lower(query), '[^a-z0-9\s_-]', ' ', 'g'), '\s+') AS ws FROM q), "
    "t AS (SELECT query_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS place FROM w), k AS (SELECT query_id, term, place FROM t WHERE length(term) > 2 AND term NOT IN ('the', 'with', 'where is', 'part of')), "
    "f AS (SELECT ord, path, lower(path) AS lp, list_last(string_split(lower(path), '/')) AS name, content, lower(content) AS low, log2(len(string_split(content, chr(10))) + 2) AS lg, "
    r"CASE WHEN regexp_matches(path, 'index\.(ts|js|py)$') THEN 5 ELSE 0 END + CASE WHEN starts_with(path, 'src/') THEN 3 ELSE 0 END AS boost FROM files WHERE strlen(content) <= 102400), "
    r"h AS (SELECT ord, term, contains(lp, term) AS p, contains(name, term) AS b, len(regexp_extract_all(low, '\b' || term || '\b')) AS n, lg, "
    r"regexp_matches(content, '(?i)export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+\w*' || term || '\w*|def\s+\w*' || term || '\w*|func\s+\w*' || term || '\w*') AS e FROM f, (SELECT DISTINCT term FROM k)), "
    "s AS (SELECT ord, term, CASE WHEN p THEN 10 ELSE 0 END + CASE WHEN b THEN 15 ELSE 0 END + least(floor(n / lg * 4 + 0.5), 20) + CASE WHEN e THEN 20 ELSE 0 END AS points, "
    "list_filter([CASE WHEN p THEN 'Path contains \"' || term || '\"' END, CASE WHEN n >= 3 THEN '\"' || term || '\" appears ' || n || 'x' END, CASE WHEN e THEN 'Exports symbol matching \"' || term || '\"' END], lambda x: x IS NOT NULL) AS notes FROM h), "
    "g AS (SELECT query_id, ord, sum(points) AS points, array_to_string(flatten(list(notes ORDER BY place)), '|') AS reasons FROM k JOIN s USING (term) GROUP BY query_id, ord), "
    "r AS (SELECT q.query_id, f.ord, CAST(coalesce(points, 0) + boost AS INT) AS score, coalesce(reasons, '') AS reasons FROM q CROSS JOIN f LEFT JOIN g ON g.query_id = q.query_id AND g.ord = f.ord), "
    "o AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS INT) AS position FROM r WHERE score > 0) SELECT query_id, position, ord, score, reasons FROM o WHERE position <= 10",
    "relevance_scores": _SCORED + " SELECT ord, path, score, reasons FROM sc",
    "semantic_relevance": _SCORED + " SELECT ord, path, score, reasons FROM sc WHERE score > 0 ORDER BY score DESC, ord LIMIT 10",
    "relevance_savings": _SCORED + ", tp AS (SELECT path, reasons FROM sc WHERE score > 0 ORDER BY score DESC, ord LIMIT 10), "
    f"v AS (SELECT CAST({(len(QUERY) + 3) // 4} + (SELECT sum(ceil(octet_length(encode(content)) / 4.0)) FROM fl) AS BIGINT) AS original, CAST(ceil((SELECT sum(length(path || ': ' || replace(reasons, '|', ', '))) + count(*) - 1 FROM tp) / 4.0) AS BIGINT) AS optimized) "
    "SELECT *, greatest(original - optimized, 0) AS saved, CAST(floor((original - optimized) * 100 / original + 0.5) AS INT) AS saved_percent FROM v",
}
