"""Structure of source files from patterns over their lines: imports, exports, symbols, leading comment.

A file is parsed inside its row: its lines are an array, each rule is an expression over a line, and results
keep the order of lines and rules. Nothing is shuffled, and no Python runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctxforge.functions.language import detect_language, infer_purpose
from ctxforge.functions.text import basename, js_trim, lines_of
from ctxforge.functions.tokens import text_savings

SYMBOL = "struct<name:string,kind:string,signature:string,exported:boolean,is_async:boolean,line:int>"
IMPORT = "struct<source:string,specifiers:array<string>,is_default:boolean,is_side_effect:boolean>"

# The forms of declarations that count.
JS_IMPORT = r"""^import\s+(?:type\s+)?(?:\{([^}]*)\}|(\w+)|\*\s+as\s+(\w+))(?:\s*,\s*(?:\{([^}]*)\}|(\w+)))?\s+from\s+['"]([^'"]+)['"]"""
JS_SIDE_EFFECT = r"""^import\s+['"]([^'"]+)['"]"""
JS_REQUIRE = r"""(?:const|let|var)\s+\{?([^}=]+)\}?\s*=\s*require\(['"]([^'"]+)['"]\)"""
JS_DEFAULT = r"^export\s+default\s"
JS_LIST = r"^export\s+\{([^}]+)\}"
JS_FUNCTION = r"^(export\s+)?(export\s+default\s+)?(async\s+)?function\s+(\w+)\s*(<[^>]*>)?\s*\(([^)]*)\)"
JS_CLASS = r"^(export\s+)?(export\s+default\s+)?(?:abstract\s+)?class\s+(\w+)"
JS_INTERFACE = r"^(export\s+)?interface\s+(\w+)"
JS_TYPE = r"^(export\s+)?type\s+(\w+)\s*(?:<[^>]*)?\s*="
JS_CONST = r"^(export\s+)?const\s+(\w+)\s*(?::[^=]+)?\s*=\s*(?:async\s+)?\("
JS_ENUM = r"^(export\s+)?(?:const\s+)?enum\s+(\w+)"
PY_FROM = r"^from\s+([\w.]+)\s+import\s+(.*)"
PY_IMPORT = r"^import\s+([\w.,\s]+)"
PY_DEF = r"^(?:async\s+)?def\s+(\w+)\s*\((.*)\)"
PY_CLASS = r"^class\s+(\w+)"
GO_IMPORT, GO_FUNC = r'^import\s+"([^"]+)"', r"^func\s+(\w+)"
RUST_USE, RUST_FN = r"^use\s+([\w:]+)", r"^(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"


def _group(line: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(line, pattern, n)


def _names(text: Column, alias: int | None) -> Column:
    """Names of a comma-separated list; of "a as b" the first (0) or the second (1)."""
    parts = F.transform(F.split(text, ","), lambda p: js_trim(p))
    if alias is not None:
        parts = F.transform(parts, lambda p: js_trim(F.coalesce(F.get(F.split(p, r"\s+as\s+"), F.lit(alias)), p)))
    return F.filter(parts, lambda p: p != "")


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _symbol(name: Column, kind: str, exported: Column, line: Column, signature: Column | None = None, is_async: Column | None = None) -> Column:
    text, flag = (F.lit(None).cast(t) for t in ("string", "boolean"))
    return F.struct(
        name.alias("name"), F.lit(kind).alias("kind"), (text if signature is None else signature).alias("signature"), exported.alias("exported"),
        (flag if is_async is None else is_async).alias("is_async"), line.cast("int").alias("line"),
    )


def _import(source: Column, specifiers: Column, default: Column | None = None, side_effect: bool | None = None) -> Column:
    none = F.lit(None).cast("boolean")
    return F.struct(source.alias("source"), specifiers.alias("specifiers"), (none if default is None else default).alias("is_default"), F.lit(side_effect).cast("boolean").alias("is_side_effect"))


def _signature(line: Column) -> Column:
    return js_trim(F.regexp_replace(line, r"\s*\{.*$", ""))


def _js_line(line: Column, i: Column) -> Column:
    is_import, is_side = line.rlike(JS_IMPORT), line.rlike(JS_SIDE_EFFECT)
    g = lambda pattern, n: _group(line, pattern, n)
    braces = F.concat(_names(g(JS_IMPORT, 1), 0), _names(g(JS_IMPORT, 4), 0))
    default, star = g(JS_IMPORT, 2), g(JS_IMPORT, 3)
    specifiers = F.concat(braces, F.filter(F.array(default, F.when(star != "", F.concat(F.lit("* as "), star))), lambda x: x.isNotNull() & (x != "")))
    imports = (
        F.when(is_import, F.array(_import(g(JS_IMPORT, 6), specifiers, default != "")))
        .when(is_side, F.array(_import(g(JS_SIDE_EFFECT, 1), _no("string"), None, True)))
        .when(line.rlike(JS_REQUIRE), F.array(_import(g(JS_REQUIRE, 2), _names(g(JS_REQUIRE, 1), None))))
        .otherwise(_no(IMPORT))
    )
    line_no = i + 1
    either = lambda pattern: (g(pattern, 1) != "") | (g(pattern, 2) != "")
    one = lambda pattern: g(pattern, 1) != ""
    rules = (
        (JS_FUNCTION, _symbol(g(JS_FUNCTION, 4), "function", either(JS_FUNCTION), line_no, _signature(line), g(JS_FUNCTION, 3) != "")),
        (JS_CLASS, _symbol(g(JS_CLASS, 3), "class", either(JS_CLASS), line_no, _signature(line))),
        (JS_INTERFACE, _symbol(g(JS_INTERFACE, 2), "interface", one(JS_INTERFACE), line_no)),
        (JS_TYPE, _symbol(g(JS_TYPE, 2), "type", one(JS_TYPE), line_no)),
        (JS_CONST, _symbol(g(JS_CONST, 2), "function", one(JS_CONST), line_no, None, line.contains("async "))),
        (JS_ENUM, _symbol(g(JS_ENUM, 2), "enum", one(JS_ENUM), line_no)),
    )
    symbols = F.filter(F.array(*(F.when(line.rlike(p), s) for p, s in rules)), lambda s: s.isNotNull())
    symbols = F.when(is_import | is_side, _no(SYMBOL)).otherwise(symbols)
    named = F.when(line.rlike(JS_LIST), _names(g(JS_LIST, 1), 1)).otherwise(_no("string"))
    own = F.transform(F.filter(symbols, lambda s: s["exported"]), lambda s: s["name"])
    exports = F.concat(F.when(line.rlike(JS_DEFAULT), F.array(F.lit("default"))).otherwise(_no("string")), named, own)
    return F.struct(imports.alias("imports"), F.when(is_import | is_side, _no("string")).otherwise(exports).alias("exports"), symbols.alias("symbols"))


def _py_line(line: Column, i: Column) -> Column:
    g = lambda pattern, n: _group(line, pattern, n)
    is_from, is_import = line.rlike(PY_FROM), line.rlike(PY_IMPORT)
    raw = g(PY_FROM, 2)
    specifiers = F.when(raw == "*", F.array(F.lit("*"))).otherwise(_names(F.regexp_replace(raw, "[()]", ""), 0))
    plain = F.transform(_names(g(PY_IMPORT, 1), 0), lambda n: _import(n, F.array(n)))
    imports = F.when(is_from, F.array(_import(g(PY_FROM, 1), specifiers))).when(is_import, plain).otherwise(_no(IMPORT))
    name = g(PY_DEF, 1)
    function = F.when(line.rlike(PY_DEF), _symbol(name, "function", ~name.startswith("_"), i + 1, None, line.startswith("async")))
    klass = F.when(line.rlike(PY_CLASS), _symbol(g(PY_CLASS, 1), "class", F.lit(True), i + 1))
    symbols = F.when(is_from | is_import, _no(SYMBOL)).otherwise(F.filter(F.array(function, klass), lambda s: s.isNotNull()))
    exports = F.transform(F.filter(symbols, lambda s: s["exported"]), lambda s: s["name"])
    return F.struct(imports.alias("imports"), exports.alias("exports"), symbols.alias("symbols"))


def _simple_line(use: str, function: str, exported: Callable[[Column, Column], Column]):
    def rule(line: Column, i: Column) -> Column:
        name = _group(line, function, 1)
        imports = F.when(line.rlike(use), F.array(_import(_group(line, use, 1), _no("string")))).otherwise(_no(IMPORT))
        symbols = F.when(line.rlike(function), F.array(_symbol(name, "function", exported(name, line), i + 1))).otherwise(_no(SYMBOL))
        exports = F.transform(F.filter(symbols, lambda s: s["exported"]), lambda s: s["name"])
        return F.struct(imports.alias("imports"), exports.alias("exports"), symbols.alias("symbols"))

    return rule


_RULES = {
    "javascript": _js_line,
    "python": _py_line,
    "go": _simple_line(GO_IMPORT, GO_FUNC, lambda name, line: name.rlike("^[A-Z]")),
    "rust": _simple_line(RUST_USE, RUST_FN, lambda name, line: line.startswith("pub ")),
}


def leading_comment(content: Column, language: Column) -> Column:
    """array<string> of at most one text."""
    block = F.regexp_extract(content, r"\A\s*/\*\*([\s\S]*?)\*/", 1)
    rows = F.filter(F.transform(lines_of(block), lambda x: js_trim(F.regexp_replace(x, r"^\s*\*\s?", ""))), lambda x: x != "")
    js = F.array_join(rows, " ")
    doc = F.regexp_extract(content, "\\A(?:[']{3}|[\"]{3})([\\s\\S]*?)(?:[']{3}|[\"]{3})", 1)
    py = F.when(doc != "", js_trim(F.element_at(lines_of(js_trim(doc)), 1)))
    one = F.when(language.isin("typescript", "javascript"), F.when(js != "", js)).when(language == "python", py)
    return F.when(one.isNull(), _no("string")).otherwise(F.array(one))


def parse(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with language, imports, exports, symbols, comments and has_default."""
    found = files.withColumn("language", detect_language(F.col("path")))
    lines = F.transform(lines_of(F.coalesce("content", F.lit(""))), lambda x: js_trim(x))
    kind = F.when(F.col("language") == "typescript", "javascript").otherwise(F.col("language"))
    per_line = F.array().cast(f"array<struct<imports:array<{IMPORT}>,exports:array<string>,symbols:array<{SYMBOL}>>>")
    for name, rule in _RULES.items():
        per_line = F.when(kind == name, F.transform(F.col("_lines"), rule)).otherwise(per_line)
    found = found.withColumn("_lines", lines).withColumn("_parsed", per_line)
    flat = {k: F.flatten(F.transform("_parsed", _field(k))) for k in ("imports", "exports", "symbols")}
    exports = F.when(kind.isin("javascript", "python"), F.array_distinct(flat["exports"])).otherwise(flat["exports"])
    found = found.withColumns({"imports": flat["imports"], "exports": exports, "symbols": flat["symbols"], "comments": leading_comment(F.coalesce("content", F.lit("")), F.col("language"))})
    default = F.exists("_lines", lambda x: x.rlike(JS_DEFAULT)) & (kind == "javascript")
    return found.withColumn("has_default", default).drop("_lines", "_parsed")


def _field(name: str):
    return lambda x: x[name]


def symbol_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("ord", "path", F.posexplode("symbols").alias("place", "s")).select("ord", "path", "place", "s.*")


def import_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("ord", "path", F.posexplode("imports").alias("place", "i")).select("ord", "path", "place", "i.*")


def export_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("ord", "path", F.posexplode("exports").alias("place", "name"))


def kind_summary(symbols: Column) -> Column:
    """"2 functions: a, b; 1 class: C" in order of first appearance, five names at most."""
    kinds = F.array_distinct(F.transform(symbols, lambda s: s["kind"]))

    def one(kind: Column) -> Column:
        names = F.transform(F.filter(symbols, lambda s: s["kind"] == kind), lambda s: s["name"])
        n = F.size(names)
        return F.concat(n.cast("string"), F.lit(" "), kind, F.when(n == 1, "").otherwise("s"), F.lit(": "), F.array_join(F.slice(names, 1, 5), ", "), F.when(n > 5, "…").otherwise(""))

    return F.array_join(F.transform(kinds, one), "; ")


def compress(files: DataFrame, parser: Callable[[DataFrame], DataFrame] = parse) -> DataFrame:
    """Parsed files with purpose, dependencies, summary, the skeleton's text and its savings. parser: parse, by patterns, or
    syntax.dispatch, by syntax first."""
    p = parser(files)
    p = p.withColumn("purpose", infer_purpose(F.col("path"), F.col("symbols"), F.col("imports"), F.col("comments")))
    sources = F.transform("imports", lambda i: i["source"])
    external = F.filter(sources, lambda s: ~s.startswith(".") & ~s.startswith("/"))
    more = F.size("exports") - 8
    summary = F.concat_ws(
        ". ",
        F.concat(basename(F.col("path")), F.lit(" ("), F.col("language"), F.lit(")")),
        F.when(F.size("symbols") > 0, F.concat(F.lit("Defines: "), kind_summary(F.col("symbols")))),
        F.when(F.size("exports") > 0, F.concat(F.lit("Exports: "), F.array_join(F.slice("exports", 1, 8), ", "), F.when(more > 0, F.concat(F.lit("… (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))),
        F.when(F.size(external) > 0, F.concat(F.lit("Uses: "), F.array_join(F.slice(external, 1, 5), ", "))),
    )
    p = p.withColumns({"dependencies": F.array_distinct(sources), "summary": summary})
    skeleton = F.concat_ws(
        "\n",
        F.concat(F.lit("Purpose: "), F.col("purpose")),
        F.concat(F.lit("Summary: "), F.col("summary")),
        F.concat(F.lit("Imports: "), F.array_join(F.transform("imports", lambda i: F.concat(i["source"], F.lit("["), F.array_join(i["specifiers"], ","), F.lit("]"))), " | ")),
        F.concat(F.lit("Exports: "), F.array_join("exports", ", ")),
        F.concat(F.lit("Symbols: "), F.array_join(F.transform("symbols", lambda s: F.concat(F.when(s["exported"], "+").otherwise("-"), s["kind"], F.lit(":"), s["name"])), " ")),
        F.concat(F.lit("Deps: "), F.array_join("dependencies", ", ")),
    )
    return p.withColumn("skeleton", skeleton).withColumn("tokens", text_savings(F.col("content"), F.col("skeleton")))
