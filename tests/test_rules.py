"""Replacement marks, parameters, registries, sessions, caches, scans and reports."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ctxforge.functions import render, tokens
from ctxforge.functions.text import replace_first
from ctxforge.operators import code, diff, gates, params, repo_graph, usage
from ctxforge.sources import events, scan, tree


def plain_replace(text, found, replacement):
    at = text.find(found)
    if at < 0:
        return text
    head, tail = text[:at], text[at + len(found) :]
    marks = {"$$": "$", "$&": found, "$`": head, "$'": tail}
    return head + re.sub(r"\$[$&`']", lambda m: marks[m[0]], replacement) + tail


CASES = [("a-b-c", "b", x) for x in ("x", "$$&", "$&$&", "[$`|$']", "$1$", "$$$$", "$", "", "$$`")] + [("abc", "z", "$&"), ("bb", "b", "$'"), ("", "b", "x"), ("p.q", ".", "\\$&")]


def test_replacement_marks(spark):
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, f string, r string")
    got = {r["i"]: r["o"] for r in frame.select("i", replace_first(F.col("t"), F.col("f"), F.col("r")).alias("o")).collect()}
    assert [got[i] for i in range(len(CASES))] == [plain_replace(*c) for c in CASES]


def test_hunks_with_marks():
    def whole(old, new):
        return diff.applies(diff.diff_hunks(old.split("\n"), new.split("\n")), old, new)

    assert whole("a\nb\nc", "a\nx\nc")
    assert not whole("a\nb\nc", "a\ncost $$ 5\nc") and not whole("a\nb\nc", "a\n$&\nc") and not whole("a\nb\nc", "a\n$`\nc")
    assert whole("a\nb\nc", "a\n$5 and $1\nc")
    hunks = [(0, ["b"], ["$$&"])]
    assert diff.applies(hunks, "abc", "a$&c") and not diff.applies(hunks, "abc", "abc")


def test_params():
    assert params.validate("compress_directory", {"path": "."}) == {"path": ".", "max_files": 100, "include_tests": False}
    got = params.validate("context_budget", {"items": [{"name": "a", "content": "b"}], "extra": 1})
    assert got == {"items": [{"name": "a", "content": "b", "priority": "medium"}], "budget_tokens": 8000, "model": "claude-3"}
    bad = [
        ("compress_directory", {"path": ".", "max_files": 501}), ("compress_directory", {}), ("compress_directory", {"path": ".", "max_files": True}), ("context_budget", {"items": []}),
        ("context_budget", {"items": [{"name": "a"}]}), ("detect_duplicates", {"items": ["a"], "similarity_threshold": 1.5}), ("detect_duplicates", {"items": "a"}), ("semantic_relevance", {"query": "", "directory": "."}),
        ("summarize_conversation", {"messages": [{"role": "robot", "content": "x"}]}), ("summarize_logs", {"logs": "x", "log_type": "none"}), ("nothing", {}),
    ]
    for request, given in bad:
        with pytest.raises(params.InvalidParams):
            params.validate(request, given)
    assert params.validate("detect_duplicates", {"items": ["a"], "similarity_threshold": 1})["similarity_threshold"] == 1


def test_count_tokens_in_sql(spark):
    tokens.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT count_tokens('abcde'), count_tokens(''), count_tokens(NULL)").collect()] == [(2, 0, 0)]
    counter = tokens.exact_counter(lambda: lambda t: len(t.split()))
    assert [r[0] for r in spark.createDataFrame([("a b c",), (None,)], "t string").select(counter("t")).collect()] == [3, 0]


def test_registry(spark):
    rows = [("a", "A", "/a", 7100, "python", "2024-01-01", "2024-01-05", 1, 10), ("b", "B", "/b", 7101, "go", "2024-01-02", "2024-01-06", 2, 0)]
    projects = spark.createDataFrame(rows, "id string, name string, path string, port int, language string, registered_at string, last_seen_at string, session_count int, total_saved bigint")
    assert [r["id"] for r in events.all_projects(projects).collect()] == ["b", "a"] and events.get_project(projects, "a").first()["name"] == "A"
    more = events.add_savings(projects, spark.createDataFrame([("a", 5, "2024-01-07"), ("a", 7, "2024-01-06"), ("zz", 9, "2024-01-09")], "id string, saved long, seen_at string"))
    assert {(r["id"], r["total_saved"], r["last_seen_at"]) for r in more.collect()} == {("a", 22, "2024-01-07"), ("b", 0, "2024-01-06")}
    assert [r["id"] for r in events.remove_projects(projects, spark.createDataFrame([("a",), ("a",)], "id string")).collect()] == ["b"]


def test_sessions_and_cache(spark):
    sessions = spark.createDataFrame([(1, 7, "2024-01-01 00:00:00", 5), (2, 7, "2024-01-02 00:00:00", 1), (3, 8, "2024-01-01 00:00:00", 0)], "session_id long, project_id long, last_activity string, saved long")
    savings = spark.createDataFrame([(7, 10, "2024-01-03 00:00:00"), (7, 0, "2024-01-09 00:00:00"), (9, 4, "2024-01-03 00:00:00")], "project_id long, saved long, ts string")
    assert {(r["session_id"], r["saved"], r["last_activity"][:10]) for r in usage.credit_sessions(sessions, savings).collect()} == {(1, 5, "2024-01-01"), (2, 11, "2024-01-03"), (3, 0, "2024-01-01")}
    requests = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00")], "session_id long, ts string")
    resets = spark.createDataFrame([(1, "2024-01-02 00:00:00")], "session_id long, ts string")
    assert {tuple(r) for r in usage.since_reset(requests, resets).collect()} == {(1, "2024-01-03 00:00:00"), (2, "2024-01-01 00:00:00")}
    entries = spark.sql("SELECT 'a' AS key, 1 AS value, TIMESTAMP '2024-01-01 00:00:00' AS set_at UNION ALL SELECT 'a', 2, TIMESTAMP '2024-01-01 00:04:00' UNION ALL SELECT 'b', 3, TIMESTAMP '2024-01-01 00:00:00'")
    assert [(r["key"], r["value"]) for r in usage.unexpired(entries, "2024-01-01 00:06:00").collect()] == [("a", 2)]
    assert [r[0] for r in spark.sql("SELECT 'block' AS d, true AS o UNION ALL SELECT 'block', NULL").select(gates.unless_opted_out(F.col("d"), F.col("o"))).collect()] == ["skip", "block"]


def listed(base, extensions, denied, most, soft, tests=True):
    """Depth first in name order, as a plain recursion."""
    import os

    found = []

    def enter(folder):
        if most is not None and len(found) >= most:
            return
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if not soft and most is not None and len(found) >= most:
                return
            if os.path.isdir(path):
                if name not in denied and not name.startswith("."):
                    enter(path)
            elif os.path.splitext(name)[1] in extensions and (tests or not scan.TESTS.search(path)):
                found.append(os.path.relpath(path, base))

    enter(base)
    return found


def test_listings_equal_a_recursion(spark, tmp_path):
    """Order, hard and soft limits, with names around the separator, denied folders and folders opened on the driver or not."""
    rng = random.Random(3)
    names = ["a", "a.b", "a-b", "a b", "_x", ".hid", "dist", "z", "é", "A"]
    folders = [tmp_path / "base"]
    for _ in range(60):
        folders.append(rng.choice(folders) / rng.choice(names))
    for folder in folders:
        folder.mkdir(parents=True, exist_ok=True)
        for _ in range(rng.randint(1, 4)):
            file = folder / (rng.choice(["f", "aa", "__init__", "b.test", "zz"]) + rng.choice([".py", ".ts", ".TS", ".txt", ""]))
            file.write_text("x" * rng.randint(0, 9))
    base, kinds = str(tmp_path / "base"), frozenset([".py", ".ts"])
    full = listed(base, kinds, scan.DENIED, None, False)
    assert len(full) > 12
    for most in (1, 2, 5, 9, len(full), 100, None):
        for soft in (False, True):
            for tests in (False, True):
                got = [r["path"] for r in scan.list_tree(spark, base, extensions=kinds, include_tests=tests, most=most, soft=soft).orderBy("ord").collect()]
                assert got == listed(base, kinds, scan.DENIED, most, soft, tests), (most, soft)


def test_tree_partitions(tmp_path):
    """Folders alone are listed to deal them out; every file is in one partition."""
    for i in range(4):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f.py").write_text("x")
        (tmp_path / f"d{i}" / "g.py").write_text("xx")
    (tmp_path / "h.py").write_text("xxx")
    for n, wanted in ((1, 1), (5, 5), (6, 1 + 4 + 12), (100, 17)):
        reader = tree.TreeReader({"path": str(tmp_path), "extensions": ".py", "maxbytes": "2", "folders": str(n)})
        parts = reader.partitions()
        assert len(parts) == wanted
        paths = [x for p in parts for b in reader.read(p) for x in b["path"].to_pylist()]
        assert len(paths) == len(set(paths)) == 16 and "h.py" not in paths


def test_reports(spark):
    rows = [(0, "src/index.ts", "import { a } from './util';\nexport function go(x: number) {\n}\n"), (1, "src/util.ts", "export const a = (x) => x;\n")]
    files = spark.createDataFrame(rows, "ord long, path string, content string")
    text = code.compress(files).where("ord = 0").select(render.read_block(F.struct("*"))).first()[0]
    assert "  src/index.ts\n  4 lines → " in text and "── Imports ──\n  ./util { a }\n" in text and "export function go" in text and "── Exports ──\n  go\n" in text
    parsed = code.parse(files)
    text = render.directory(repo_graph.compress_directory(parsed, "src"), repo_graph.entry_points(parsed), repo_graph.important_files(parsed), repo_graph.relationships(parsed), "src").first()[0]
    assert text.startswith("# Directory: src\n\n## Architecture\nDirectory: src. Files analyzed: 2") and "## Tech Stack\nTypescript" in text
    assert "## Entry Points\n- src/index.ts" in text and "- `src/index.ts` — Entry point" in text and "- `src/index.ts` → `src/util.ts`" in text
    old = "\n".join(f"line {i} with some words in it to give it a length" for i in range(120))
    writes = spark.createDataFrame([("a.txt", old, old.replace("line 60 ", 'line "sixty" '))], "path string, old string, new string")
    gated = diff.write_gate(writes)
    assert gated.first()["decision"] == "block"
    text = gated.select(render.write_block(F.struct("*"))).first()[0]
    assert "  a.txt already exists (120 lines)." in text and "── Hunk 1 of 1 ──" in text and 'line \\"sixty\\" with' in text and text.endswith("% fewer tokens.")
    projects = spark.sql("SELECT TIMESTAMP '2024-01-31 23:59:30' AS last_seen_at, 'p1' AS id, 'one' AS name, 7100 AS port, 2L AS session_count, 1500L AS total_saved")
    sessions = spark.sql("SELECT TIMESTAMP '2024-01-31 22:00:00' AS started_at, 'abcdefghijk' AS id, 'one' AS project, 20L AS saved")
    text = render.status(projects, sessions, "2024-02-01 00:00:00").first()[0]
    assert "    [p1] one  sessions=2  saved=1.5k  port=7100  (30s ago)" in text and "    abcdefgh  one  saved=20  (2h ago)" in text and text.endswith("(all-time): 1.5k")


def test_diffs_equal_the_table_method():
    """Against the whole table of common lengths, walked back: a kept line first, then an added one where that loses nothing."""
    rng = random.Random(5)

    def table(old, new):
        rows = [[0] * (len(new) + 1)]
        for x in old:
            above, row = rows[-1], [0]
            for j, y in enumerate(new):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
            rows.append(row)
        out, i, j = [], len(old), len(new)
        while i or j:
            if i and j and old[i - 1] == new[j - 1]:
                i, j = i - 1, j - 1
                out.append(("keep", old[i]))
            elif j and (not i or rows[i][j - 1] >= rows[i - 1][j]):
                j -= 1
                out.append(("add", new[j]))
            else:
                i -= 1
                out.append(("del", old[i]))
        return out[::-1]

    held = diff.BLOCK_BYTES
    try:
        for diff.BLOCK_BYTES in (held, 0):  # all rows held, or few and made again
            for n in range(1500):
                kinds = rng.choice((1, 2, 4, 30))
                old = [str(rng.randint(0, kinds)) for _ in range(rng.randint(0, 30))]
                new = [x for x in old if rng.random() < 0.85] if n % 2 else [str(rng.randint(0, kinds)) for _ in range(rng.randint(0, 30))]
                new = old[: rng.randint(0, len(old))] * (n % 3 == 0) + new + old[rng.randint(0, len(old)) :] * (n % 5 == 0)
                assert diff.diff_ops(old, new) == table(old, new), (old, new)
    finally:
        diff.BLOCK_BYTES = held


def test_token_counts_equal_a_plain_merge_loop(spark, sf):
    """All documents and awkward texts against a plain loop over neighbours, and against the tokenizer's own library."""
    import regex
    import tiktoken
    from public_tokenizers import PATTERN, path

    from ctxforge.functions import merge_ranks

    table = merge_ranks.MergeRanks(path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table.ranks, special_tokens={})

    def plain(text):
        total = 0
        for word in regex.findall(PATTERN, text):
            parts = [bytes([b]) for b in word.encode()]
            while len(parts) > 1:
                rank, at = min((table.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == 1 << 40:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            total += len(parts)
        return total

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "   "), (-4, "a\u00a0b\u2003 c\n\n d"), (-5, "don't I'll  we've\t\tx'S"), (-6, "ünïçödé 😀👍🏽 12³½ ___ --"), (-7, "x" * 3000 + " " * 50 + "é" * 500), (-8, "<|endoftext|>"), (-9, "a\x1cb\x85c")]
    frame = docs.union(spark.createDataFrame(odd, "doc_id long, text string"))
    got = {r[0]: r[1] for r in frame.select("doc_id", merge_ranks.bpe_counter("byte_bpe_50k.tiktoken")(F.col("text"))).collect()}
    texts = {r[0]: r[1] or "" for r in frame.collect()}
    assert got == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}
    assert all(got[i] == plain(t) for i, t in texts.items() if len(t) < 3000)


def test_short_numbers_round_as_javascript_does(spark):
    """By the exact value of the double, halves up: 1.15 lies below its name, 1.35 above, 1.25 is exact."""
    from fractions import Fraction
    from math import floor

    def fixed(x):
        tenths = floor(Fraction(x) * 10 + Fraction(1, 2))
        return f"{tenths // 10}.{tenths % 10}"

    known = {999: "999", 1000: "1.0k", 1050: "1.1k", 1150: "1.1k", 1250: "1.3k", 1350: "1.4k", 1450: "1.4k", 1749: "1.7k", 1750: "1.8k", 999949: "999.9k", 999950: "1000.0k", 999999: "1000.0k"}
    numbers = sorted({*known, *range(1000, 40000, 50), *range(10**6 - 1000, 10**6, 50)})
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select("n", tokens.format_tokens(F.col("n"))).collect()}
    assert got == {n: fixed(n / 1000) + "k" if n >= 1000 else str(n) for n in numbers} and {n: got[n] for n in known} == known
    big = [1_000_000, 1_250_000, 1_150_000, 2_949_999, 123_456_789_012]
    got = {r[0]: r[1] for r in spark.createDataFrame([(n,) for n in big], "n long").select("n", tokens.format_millions(F.col("n"))).collect()}
    assert got == {n: fixed(n / 10**6) + "M" for n in big}
