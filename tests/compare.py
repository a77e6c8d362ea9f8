"""Rows of a Spark result against rows of DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    if isinstance(x, bool) or x is None:
        return x
    return float(f"{x:.6g}") if isinstance(x, int) and abs(x) < 1e6 else str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def same(frame, con, sql: str) -> None:
    got, want = frame.collect(), con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.columns, [tuple(r) for r in got]) == rows_of(names, want.fetchall())
    assert got
