"""Declarations that patterns over single lines miss: those over several lines, members, and ten languages.

The scanner blanks comments and strings, so that what is left has the same places, measures bracket depth, and
matches each language's declarations at the depth where they may stand; a body ends at its closing bracket.
Python files go through the standard library's parser. A language is an entry of EXTRACTORS, and one Arrow
UDF runs them; code that cannot be scanned gives null, for which dispatch() takes code.parse()."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxforge.operators import code

_S, _B, _I = T.StringType(), T.BooleanType(), T.IntegerType()
SYMBOL = T.StructType([T.StructField("name", _S), T.StructField("kind", _S), T.StructField("signature", _S), T.StructField("exported", _B), T.StructField("is_async", _B), T.StructField("line", _I), T.StructField("line_end", _I)])
IMPORT = T.StructType([T.StructField("source", _S), T.StructField("specifiers", T.ArrayType(_S)), T.StructField("is_default", _B), T.StructField("is_side_effect", _B)])
PARSED = T.StructType([T.StructField("imports", T.ArrayType(IMPORT)), T.StructField("exports", T.ArrayType(_S)), T.StructField("symbols", T.ArrayType(SYMBOL)), T.StructField("comments", T.ArrayType(_S))])
#: Longest signature.
SIGNATURE = 300

_C_LIKE = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
_HASH = r"#[^\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'"
_RUST = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'"
BLANKS = {"ruby": _HASH, "php": _C_LIKE + r"|#[^\n]*", "rust": _RUST, "go": _C_LIKE + r"|`[^`]*`", "typescript": _C_LIKE + r"|`(?:\\.|[^`\\])*`", "javascript": _C_LIKE + r"|`(?:\\.|[^`\\])*`"}
_ARGS = r"\s*(?:<[^>{;]*>)?\s*\((?:[^()]|\([^()]*\))*\)"
_MODS = r"(?:(?:public|private|protected|internal|open|abstract|final|static|sealed|data|override|suspend|inline|native|synchronized|default|async|readonly|mutating|class|fileprivate|lazy|weak|inner|annotation|enum|fun|export|declare)\s+)*"


def _has(*words: str) -> Callable[[str], bool]:
    return lambda head: any(re.search(rf"\b{w}\b", head) for w in words)


def _capital(name: str) -> bool:
    return name[:1].isupper()


# Rules: (kind, pattern with groups "head" and "name", exported(head, name), members allowed). Patterns start a line.
_any = lambda head, name: True
_no = lambda head, name: False
_exported = lambda head, name: "export" in head
_public = lambda head, name: _has("public")(head)
_open = lambda head, name: not _has("private", "internal")(head)
_swift = lambda head, name: _has("public", "open")(head)
_cap = lambda head, name: _capital(name)
_pub = lambda head, name: _has("pub")(head)
_extern = lambda head, name: not _has("static")(head)
_TS = (
    ("function", r"(?P<head>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?)function\s*\*?\s*(?P<name>\w+)" + _ARGS, _exported, False),
    ("class", r"(?P<head>(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?)class\s+(?P<name>\w+)", _exported, False),
    ("interface", r"(?P<head>(?:export\s+)?(?:declare\s+)?)interface\s+(?P<name>\w+)", _exported, False),
    ("type", r"(?P<head>(?:export\s+)?(?:declare\s+)?)type\s+(?P<name>\w+)\s*(?:<[^=;]*>)?\s*=", _exported, False),
    ("enum", r"(?P<head>(?:export\s+)?(?:declare\s+)?(?:const\s+)?)enum\s+(?P<name>\w+)", _exported, False),
    ("constant", r"(?P<head>(?:export\s+)?(?:declare\s+)?)const\s+(?P<name>\w+)\s*(?::[^=;]+)?=\s*(?P<arrow>(?:async\s*)?(?:\((?:[^()]|\([^()]*\))*\)|\w+)\s*(?::[^=]+)?=>)?", _exported, False),
    ("variable", r"(?P<head>(?:export\s+)?(?:declare\s+)?)(?:let|var)\s+(?P<name>\w+)", _exported, False),
    ("method", r"(?P<head>(?:(?:public|protected|static|async|override|abstract|get|set)\s+)*)(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b)(?P<name>\w+)" + _ARGS + r"\s*(?::[^{;=]+)?\s*\{", _no, True),
)
RULES = {
    "typescript": _TS,
    "javascript": _TS,
    "go": (
        ("function", r"(?P<head>)func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?" + _ARGS, _cap, False),
        ("method", r"(?P<head>)func\s+\([^)]*\)\s*(?P<name>\w+)" + _ARGS, _cap, False),
        ("struct", r"(?P<head>)type\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*struct\b", _cap, False),
        ("interface", r"(?P<head>)type\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\s*interface\b", _cap, False),
        ("type", r"(?P<head>)type\s+(?P<name>\w+)\s+(?!struct\b|interface\b)[\w\[\]*.=]+", _cap, False),
    ),
    "rust": (
        ("function", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?)fn\s+(?P<name>\w+)" + _ARGS, _pub, False),
        ("method", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?)fn\s+(?P<name>\w+)" + _ARGS, _pub, True),
        ("struct", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)struct\s+(?P<name>\w+)", _pub, False),
        ("enum", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)enum\s+(?P<name>\w+)", _pub, False),
        ("trait", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)trait\s+(?P<name>\w+)", _pub, False),
        ("type", r"(?P<head>(?:pub(?:\([^)]*\))?\s+)?)type\s+(?P<name>\w+)", _pub, False),
    ),
    "java": (
        ("class", rf"(?P<head>{_MODS})(?:class|record)\s+(?P<name>\w+)", _public, False),
        ("interface", rf"(?P<head>{_MODS})@?interface\s+(?P<name>\w+)", _public, False),
        ("enum", r"(?P<head>(?:(?:public|private|protected|static)\s+)*)enum\s+(?P<name>\w+)", _public, False),
        ("method", rf"(?P<head>public\s+{_MODS})(?:<[^>]*>\s*)?[\w<>\[\],.? ]+?\s+(?P<name>\w+)\s*\([^)]*\)[^;{{]*\{{", _no, True),
    ),
    "kotlin": (
        ("function", rf"(?P<head>{_MODS})(?<![\w.])fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?(?P<name>\w+)" + _ARGS, _open, False),
        ("class", rf"(?P<head>{_MODS})(?:class|object)\s+(?P<name>\w+)", _open, False),
        ("interface", rf"(?P<head>{_MODS})interface\s+(?P<name>\w+)", _open, False),
    ),
    "swift": (
        ("function", rf"(?P<head>{_MODS})func\s+(?P<name>\w+)" + _ARGS, _swift, False),
        ("class", r"(?P<head>(?:(?:public|open|final|private|internal|fileprivate)\s+)*)(?:class|actor)\s+(?P<name>\w+)", _swift, False),
        ("struct", rf"(?P<head>{_MODS})struct\s+(?P<name>\w+)", _swift, False),
        ("protocol", rf"(?P<head>{_MODS})protocol\s+(?P<name>\w+)", _swift, False),
        ("enum", r"(?P<head>(?:(?:public|open|private|internal|fileprivate|indirect)\s+)*)enum\s+(?P<name>\w+)", _swift, False),
        ("type", rf"(?P<head>{_MODS})typealias\s+(?P<name>\w+)", _swift, False),
    ),
    "ruby": (
        ("class", r"(?P<head>)(?:class|module)\s+(?P<name>[A-Z]\w*(?:::\w+)*)", _any, True),
        ("function", r"(?P<head>)def\s+(?:self\.)?(?P<name>\w+[?!=]?)", _any, True),
    ),
    "php": (
        ("function", r"(?P<head>)function\s+&?(?P<name>\w+)" + _ARGS, _any, False),
        ("class", r"(?P<head>(?:(?:abstract|final|readonly)\s+)*)class\s+(?P<name>\w+)", _any, False),
        ("interface", r"(?P<head>)interface\s+(?P<name>\w+)", _any, False),
        ("trait", r"(?P<head>)trait\s+(?P<name>\w+)", _any, False),
    ),
    "cpp": (
        ("class", r"(?P<head>(?:template\s*<[^>]*>\s*)?)class\s+(?P<name>\w+)[^;{(]*\{", _any, True),
        ("struct", r"(?P<head>(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?)struct\s+(?P<name>\w+)[^;{(]*\{", _any, True),
        ("enum", r"(?P<head>)enum\s+(?:class\s+)?(?P<name>\w+)", _any, True),
        ("type", r"(?P<head>)(?:typedef\s+[^;{]+?\b(?P<name>\w+)\s*;)", _any, True),
        ("function", r"(?P<head>(?:(?:static|inline|extern|constexpr|virtual|const|unsigned|template\s*<[^>]*>)\s+)*)(?!return\b|else\b|if\b|while\b|for\b|switch\b|new\b|typedef\b)[\w:<>,*&]+(?:\s*[*&]+\s*|\s+)(?P<name>[\w:~]+)\s*\([^;{}]*\)\s*(?:const\s*)?\{", _extern, True),
    ),
}
RULES["c"] = RULES["cpp"]
#: Lines that open a scope whose members count.
HOLDERS = {"typescript": r"\bclass\b", "javascript": r"\bclass\b", "rust": r"\bimpl\b", "java": r"\b(?:class|interface|enum|record)\b", "cpp": r"\bnamespace\b|extern\s", "c": r"extern\s"}


def _masked(text: str, language: str) -> str:
    return re.sub(BLANKS.get(language, _C_LIKE), lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _depths(masked: str) -> list[int]:
    depth, out = 0, []
    for c in masked:
        if c == "}":
            depth = max(0, depth - 1)
        out.append(depth)
        if c == "{":
            depth += 1
    return out


def _body_end(masked: str, at: int) -> int:
    """Place of the bracket that closes the first body after at, or of the end of the statement."""
    brace, stop = masked.find("{", at), re.compile(r"[;\n]").search(masked, at)
    if brace < 0 or (stop and stop[0] == ";" and stop.start() < brace) or (stop and stop[0] == "\n" and masked[at : brace].strip() and "\n\n" in masked[at:brace]):
        return stop.start() if stop else len(masked)
    depth = 0
    for i in range(brace, len(masked)):
        depth += {"{": 1, "}": -1}.get(masked[i], 0)
        if not depth:
            return i
    return len(masked)


def _symbols(text: str, language: str) -> list[dict]:
    masked = _masked(text, language)
    depth, holder = _depths(masked), HOLDERS.get(language)
    line_of = lambda at: text.count("\n", 0, at) + 1
    inside = []
    if holder:
        for m in re.finditer(r"(?m)^[^\n{}]*(?:" + holder + r")[^{};]*\{", masked):
            if depth[m.end() - 1] == 0:
                inside.append((m.end(), _body_end(masked, m.end() - 1)))
    found: dict[int, dict] = {}
    for kind, pattern, exported, members in RULES[language]:
        for m in re.finditer(r"(?m)^[ \t]*(?:@\w+(?:\([^)]*\))?\s+)*" + pattern, masked):
            at, level = m.start("name"), depth[m.start("name")]
            within = level == 1 and any(a <= at < b for a, b in inside)
            good = within if kind == "method" and holder else (level == 0 or (members and (language == "ruby" or within)))
            if not good or at in found:
                continue
            real = "function" if kind == "constant" and m.groupdict().get("arrow") else kind
            start = m.start("head") if m["head"] else m.start() + len(m[0]) - len(m[0].lstrip())
            end = _body_end(masked, m.end() - (m[0].endswith("{")))
            signature = " ".join(text[start : m.end()].rstrip("{= \n").split())[:SIGNATURE]
            name = text[at : m.end("name")]
            head = m["head"] + (m.groupdict().get("arrow") or "")
            found[at] = {"name": name, "kind": real, "signature": signature, "exported": bool(exported(m["head"], name)), "is_async": bool(re.search(r"\b(?:async|suspend)\b", head)), "line": line_of(start), "line_end": line_of(min(end, len(text) - 1) if text else 0)}
    rows = [found[a] for a in sorted(found)]
    # Members come ahead of the type that holds them.
    types = [r for r in rows if r["kind"] == "class"] if language in ("typescript", "javascript") else []
    for t in types:
        own = [r for r in rows if r["kind"] == "method" and t["line"] <= r["line"] <= t["line_end"]]
        rows = [r for r in rows if r not in own]
        k = rows.index(t)
        rows[k:k] = own
    return rows


def _row(source: str, names=(), default: bool | None = None, side: bool | None = None) -> dict:
    return {"source": source, "specifiers": list(names), "is_default": default, "is_side_effect": side}


def _split(text: str) -> list[str]:
    return [re.split(r"\s+as\s+|\s*:\s*", x.strip())[0].removeprefix("type ").strip() for x in text.split(",") if x.strip()]


def _js_imports(text: str) -> list[dict]:
    out = []
    for m in re.finditer(r"(?m)^\s*import\s+(?:type\s+)?([\s\S]*?)\s*from\s*['\"]([^'\"]+)['\"]|^\s*import\s*['\"]([^'\"]+)['\"]|(?:const|let|var)\s+(?:\{([^}]*)\}|(\w+))\s*=\s*require\(['\"]([^'\"]+)['\"]\)", text):
        clause, source, side, braces, one, required = m.groups()
        if side:
            out.append(_row(side, side=True))
        elif required:
            out.append(_row(required, _split(braces) if braces else [one]))
        else:
            inner = re.search(r"\{([^}]*)\}", clause)
            star = re.search(r"\*\s+as\s+(\w+)", clause)
            default = re.match(r"\s*(\w+)", clause) if not clause.startswith(("{", "*")) else None
            names = (_split(inner[1]) if inner else []) + ([default[1]] if default else []) + ([f"* as {star[1]}"] if star else [])
            out.append(_row(source, names, bool(default)))
    return out


def _go_imports(text: str) -> list[dict]:
    specs = [s for block in re.findall(r"(?m)^import\s*\(([\s\S]*?)\)", text) for s in block.split("\n")] + re.findall(r"(?m)^import\s+([\w.]*\s*\"[^\"]+\")", text)
    found = [re.match(r"\s*([\w.]*)\s*\"([^\"]+)\"", s) for s in specs]
    return [_row(m[2], [m[1]] if m[1] and m[1] != "_" else [], side=True if m[1] == "_" else None) for m in found if m]


def _use_tree(tree: str, prefix: str = "") -> list[tuple[str, str]]:
    """(path, name) of each leaf of a use declaration."""
    tree = tree.strip()
    if "{" not in tree:
        path, _, alias = tree.partition(" as ")
        full = f"{prefix}::{path.strip()}" if prefix else path.strip()
        head, _, leaf = full.rpartition("::")
        return [(head or full, alias.strip() or leaf)]
    head, _, rest = tree.partition("{")
    inner, depth, parts, part = rest.rsplit("}", 1)[0], 0, [], ""
    for c in inner + ",":
        depth += {"{": 1, "}": -1}.get(c, 0)
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    head = head.strip().removesuffix("::")
    return [x for p in parts if p.strip() for x in _use_tree(p, f"{prefix}::{head}" if prefix and head else prefix or head)]


def _plain_imports(pattern: str, names: Callable = lambda m: []) -> Callable[[str], list[dict]]:
    return lambda text: [_row(m[1], names(m)) for m in re.finditer("(?m)" + pattern, text)]


_tail = lambda m: [re.split(r"[.\\]", m[1])[-1]]
IMPORTS: dict[str, Callable[[str], list[dict]]] = {
    "typescript": _js_imports,
    "javascript": _js_imports,
    "go": _go_imports,
    "rust": lambda text: [_row(p, [n]) for m in re.finditer(r"(?m)^\s*(?:pub\s+)?use\s+([^;]+);", text) for p, n in _use_tree(" ".join(m[1].split()))],
    "java": _plain_imports(r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", _tail),
    "kotlin": _plain_imports(r"^\s*import\s+([\w.*]+)(?:\s+as\s+(\w+))?", lambda m: [m[2] or m[1].rsplit(".", 1)[-1]]),
    "swift": _plain_imports(r"^\s*(?:@\w+\s+)?import\s+(?:class\s+|struct\s+|func\s+)?([\w.]+)"),
    "ruby": _plain_imports(r"^\s*require(?:_relative)?\s*\(?\s*['\"]([^'\"]+)['\"]"),
    "php": _plain_imports(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+(\w+))?\s*;", lambda m: [m[2] or m[1].rsplit("\\", 1)[-1]]),
    "cpp": _plain_imports(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),
    "c": _plain_imports(r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]"),
}


def _comment(text: str) -> list[str]:
    m = re.match(r"\s*(?:/\*+([\s\S]*?)\*/|((?:\s*(?://|#(?!\s*include|!))[^\n]*\n?)+))", text)
    if not m:
        return []
    lines = [re.sub(r"^\s*(?:\*|//+!?|#+)\s?", "", x).strip() for x in (m[1] or m[2]).split("\n")]
    whole = " ".join(x for x in lines if x)
    return [whole] if len(whole) > 5 else []


def _scan(text: str, language: str) -> dict:
    symbols = _symbols(text, language)
    exports = [s["name"] for s in symbols if s["exported"]]
    if language in ("typescript", "javascript"):
        for m in re.finditer(r"(?m)^\s*export\s+(?:type\s+)?\{([^}]*)\}", text):
            exports += [re.split(r"\s+as\s+", x.strip())[-1] for x in m[1].split(",") if x.strip()]
        exports += ["default"] * bool(re.search(r"(?m)^\s*export\s+default\b", text))
    return {"imports": IMPORTS[language](text), "exports": list(dict.fromkeys(exports)), "symbols": symbols, "comments": _comment(text)}


def _python(text: str, language: str) -> dict:
    tree = ast.parse(text)
    imports, symbols, listed = [], [], None
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [_row(a.name, [a.name]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(_row("." * node.level + (node.module or ""), [a.name for a in node.names]))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            head = ast.unparse(node).split(":\n")[0].split("\n")[-1].removesuffix(":")[:SIGNATURE]
            symbols.append({"name": node.name, "kind": kind, "signature": head, "exported": not node.name.startswith("_"), "is_async": isinstance(node, ast.AsyncFunctionDef), "line": first, "line_end": node.end_lineno})
        elif isinstance(node, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets) and isinstance(node.value, (ast.List, ast.Tuple)):
            listed = [e.value for e in node.value.elts if isinstance(e, ast.Constant)]
    doc = (ast.get_docstring(tree) or "").strip().split("\n")[0]
    exports = listed if listed is not None else [s["name"] for s in symbols if s["exported"]]
    return {"imports": imports, "exports": exports, "symbols": symbols, "comments": [doc] if doc else []}


EXTRACTORS: dict[str, Callable[[str, str], dict]] = {"python": _python} | {language: _scan for language in RULES}


def extract(text: str | None, language: str | None) -> dict | None:
    extractor = EXTRACTORS.get(language or "")
    if extractor is None or text is None:
        return None
    try:
        return extractor(text, language)
    except (SyntaxError, ValueError, RecursionError):
        return None


@F.pandas_udf(PARSED)
def parse_syntax(content: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [extract(c, x) or {k: None for k in ("imports", "exports", "symbols", "comments")} for c, x in zip(content, language)]
    return pd.DataFrame(rows, columns=["imports", "exports", "symbols", "comments"], index=content.index)


def parse(files: DataFrame) -> DataFrame:
    """files (path, content, language, ...) with imports, exports, symbols and comments; null where it failed."""
    found = files.withColumn("_s", parse_syntax("content", "language"))
    return found.select(*files.columns, *(F.col(f"_s.{n}").alias(n) for n in PARSED.names))


def dispatch(files: DataFrame) -> DataFrame:
    """Rows of code.parse() with what the syntax tier finds in place of the patterns' finds, where it finds anything: the
    scanner's symbols, imports, exports and comments for its languages, the patterns' for other files and for code that
    cannot be scanned. parser says which ("syntax" or "patterns")."""
    patterns = code.parse(files)
    both = patterns.withColumn("_s", parse_syntax("content", "language"))
    scanned = F.col("_s.symbols").isNotNull()
    symbols = F.transform("_s.symbols", lambda s: F.struct(*(s[f].cast(t).alias(f) if f in SYMBOL.names else F.lit(None).cast(t).alias(f) for f, t in _fields_of(patterns, "symbols"))))
    imports = F.transform("_s.imports", lambda i: F.struct(*(i[f].cast(t).alias(f) for f, t in _fields_of(patterns, "imports"))))
    chosen = {"symbols": symbols, "imports": imports, "exports": F.col("_s.exports"), "comments": F.col("_s.comments")}
    both = both.withColumns({n: F.when(scanned, c).otherwise(F.col(n)) for n, c in chosen.items()})
    return both.withColumn("parser", F.when(scanned, "syntax").otherwise("patterns")).drop("_s")


def largest_deltas(files: DataFrame, most: int = 10) -> DataFrame:
    """(ord, path, by_patterns, by_syntax, delta): the files where the two tiers differ most in their number of symbols."""
    by_patterns = code.parse(files).select("ord", "path", F.size("symbols").alias("by_patterns"), parse_syntax("content", "language").alias("_s"))
    both = by_patterns.select("ord", "path", "by_patterns", F.coalesce(F.size("_s.symbols"), F.lit(0)).alias("by_syntax")).withColumn("by_syntax", F.greatest("by_syntax", F.lit(0)))
    counted = both.withColumn("delta", F.col("by_syntax") - F.col("by_patterns"))
    return counted.orderBy(F.desc(F.abs("delta")), "ord").limit(most)


def _fields_of(parsed: DataFrame, name: str):
    return [(f.name, f.dataType) for f in parsed.schema[name].dataType.elementType.fields]


@F.udtf(returnType="name string, kind string, exported boolean, line int, line_end int")
class CodeSymbols:
    """code_symbols(content, language) for SQL."""

    def eval(self, content: str, language: str):
        for s in (extract(content, language) or {"symbols": []})["symbols"]:
            yield s["name"], s["kind"], s["exported"], s["line"], s["line_end"]


def register(spark) -> None:
    spark.udtf.register("code_symbols", CodeSymbols)
