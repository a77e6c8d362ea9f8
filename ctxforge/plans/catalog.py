"""All queries of the library with their SQL, by name."""

from __future__ import annotations

from ctxforge.plans import code, events, languages, reports, streams, texts, usage

_PARTS = (usage, texts, code, languages, events, reports, streams)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}
