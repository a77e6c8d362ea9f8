"""Languages and purposes of source files as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ctxforge.functions.text import basename

# Extension to language.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "swift": "swift", "rb": "ruby", "php": "php",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "hpp": "cpp",
}
# What a lower-cased file name without its extension says about the purpose, first match wins.
PURPOSES = (
    ("index|main|app", "Application entry point"), ("server|api", "HTTP server / API handler"), ("router|routes?", "Routing definitions"), ("controller", "Request controller"),
    ("service", "Business logic service"), ("model|schema", "Data model / schema definition"), ("util|helper|lib", "Utility functions"), ("config|settings?", "Configuration"),
    ("test|spec|__tests__", "Test suite"), ("type|interface", "Type definitions"), ("hook", "React hook / lifecycle hook"), ("component", "UI component"),
    ("store|redux|slice", "State management"), ("middleware", "Middleware"), ("auth", "Authentication / authorization"), ("db|database|migration", "Database operations"),
    ("parse|parser", "Parser / code analysis"), ("compress|optim", "Compression / optimization"), ("analytics|track", "Analytics / tracking"),
)
# Files that mark a project's language, first present wins.
MARKERS = (("package.json", "typescript"), ("go.mod", "go"), ("Cargo.toml", "rust"), ("requirements.txt", "python"), ("pyproject.toml", "python"))


def detect_language(path: Column) -> Column:
    """By the part after the last dot; a path without a dot is its own extension."""
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(F.element_at(F.split(path, r"\."), -1))), F.lit("unknown"))


def project_language(names: Column) -> Column:
    """Of an array of file names at a project's root."""
    out = F.lit("unknown")
    for name, language in reversed(MARKERS):
        out = F.when(F.array_contains(names, name), language).otherwise(out)
    return out


def infer_purpose(path: Column, symbols: Column, imports: Column, comments: Column) -> Column:
    stem = F.lower(F.regexp_replace(basename(path), r"\.[^.]+$", ""))
    comment = F.try_element_at(comments, F.lit(1))
    classes = F.transform(F.filter(symbols, lambda s: s["kind"] == "class"), lambda s: s["name"])
    functions = F.size(F.filter(symbols, lambda s: s["kind"] == "function"))
    tails = F.transform(F.slice(imports, 1, 3), lambda i: basename(i["source"]))
    rest = (
        F.when(F.size(classes) == 1, F.concat(F.element_at(classes, 1), F.lit(" class implementation")))
        .when(F.size(classes) > 1, F.concat(F.array_join(classes, ", "), F.lit(" class implementations")))
        .when(functions > 0, F.concat(F.lit("Module with "), functions.cast("string"), F.lit(" exported function"), F.when(functions == 1, "").otherwise("s")))
        .when(F.size(tails) > 0, F.concat(F.lit("Module using "), F.array_join(tails, ", ")))
        .otherwise("Source module")
    )
    for pattern, label in reversed(PURPOSES):
        rest = F.when(stem.rlike(pattern), label).otherwise(rest)
    return F.when((F.length(comment) > 10) & (F.length(comment) < 200), comment).otherwise(rest)
