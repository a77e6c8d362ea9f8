"""Hand-derived results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ctxforge.functions import tokens as T
from ctxforge.functions.language import detect_language, infer_purpose
from ctxforge.operators import budget, code, conversation, dedupe, diff, gates, logs, prompts, relevance, repo_graph, usage
from ctxforge.sources import events, scan, scratch

LOG = """2024-01-15T10:00:00Z INFO Starting build
2024-01-15T10:00:01Z ERROR Cannot find module './missing'
    at Function.load (loader.js:10:5)
    at main (app.js:1:1)
    at run (app.js:2:1)
2024-01-15T10:00:02Z WARN deprecated option used
2024-01-15T10:00:03Z ERROR Cannot find module './missing'
    at Function.load (loader.js:10:5)
2024-01-15T10:00:04Z warning: slow
done"""


def items(spark, texts):
    return spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "item_id long, ord long, text string")


def test_tokens(spark):
    row = spark.range(1).select(T.text_savings(F.lit("a" * 1000), F.lit("a" * 100)).alias("t"), T.format_tokens(F.lit(1500)).alias("f"), T.project_port(F.lit("/a")).alias("p"), T.project_port(F.lit("/srv/app")).alias("q")).first()
    assert tuple(row["t"]) == (250, 25, 225, 90) and row["f"] == "1.5k" and (row["p"], row["q"]) == (7987, 7479)
    worse = spark.range(1).select(T.text_savings(F.lit("a"), F.lit("a" * 99)).alias("t")).first()["t"]
    assert worse["saved"] == 0 and worse["saved_percent"] == 0
    assert spark.range(1).select(T.count_tokens(F.lit(None).cast("string"))).first()[0] == 0


def test_exact_counter(spark):
    count = T.exact_counter(lambda: lambda t: len(t.split()))
    assert spark.createDataFrame([("a b c",), (None,)], "t string").select(count("t").alias("n")).orderBy("n").collect() == [(0,), (3,)]


def test_logs(spark):
    frame = spark.createDataFrame([(1, LOG), (2, ""), (3, None), (4, "\n".join(["INFO ok"] * 50)), (5, "TypeError: x error\n    at a (b.js:1:1)\nwarn deprecated")], "log_id int, content string")
    rows = {r["log_id"]: r for r in logs.summarize(frame).collect()}
    assert rows[1]["summary"] == "Status: error. 1 unique error. 2 unique warnings"
    assert rows[1]["errors"][0]["count"] == 2 and rows[1]["errors"][0]["message"].count("\n") == 3
    assert list(rows[1]["actions"]) == ["Run `npm install` or check import paths", "Update deprecated APIs"]
    for quiet in (2, 3, 4):
        assert rows[quiet]["status"] == "success" and rows[quiet]["summary"] == "Status: success. No errors. No warnings"
    assert list(rows[5]["actions"]) == ["Fix TypeScript type error — check function signatures", "Update deprecated APIs"]


def test_log_blocks_equal_a_sequential_scan(spark):
    rng, kinds = random.Random(4), ["error: a", "warn b", "info", "at x", 'File "q"', "", "at error", "panic at 5"]
    texts = ["\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 14))) for _ in range(60)]

    def scan_text(text):
        lines, out, i = text.split("\n"), [], 0
        while i < len(lines):
            line = lines[i].strip()
            i += 1
            if re.search(r"\b(error|panic)\b", line):
                frames = []
                while i < len(lines) and re.match(r"at\s+|File\s+\"", lines[i].strip()):
                    frames.append(lines[i].strip())
                    i += 1
                out.append(("error", line, min(len(frames), 5)))
            elif re.search(r"\bwarn\b", line):
                out.append(("warn", line, 0))
        return out

    frame = spark.createDataFrame(list(enumerate(texts)), "log_id int, content string")
    got: dict = {}
    for r in logs.log_blocks(frame).orderBy("log_id", "line_no").collect():
        head, *rest = r["message"].split("\n")
        more = re.search(r"… \((\d) more", rest[-1]) if rest else None
        got.setdefault(r["log_id"], []).append((r["level"], head, len(rest) - 1 + int(more[1]) if more else len(rest)))
    for i, text in enumerate(texts):
        assert got.get(i, []) == scan_text(text), text


def test_conversation(spark):
    rows = [(1, 0, "user", "I need to build an authentication system using JWT\nCan you also add refresh tokens?"), (1, 1, "assistant", "Sure, I have added it."), (1, 2, "user", None)]
    r = conversation.summarize(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), 0).first()
    assert list(r["goals"]) == ["also add refresh tokens?", "build an authentication system using JWT"]  # by cue, then place
    assert list(r["completed"]) == []
    short = conversation.summarize(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).first()
    assert list(short["goals"]) == [conversation.NO_GOALS] and short["key_context"] == "General conversation"


def test_running_sums_in_blocks(spark):
    """Against plain loops, with blocks of one row and of all, null keys and values, and nulls in between."""
    from pyspark.sql import functions as F

    from ctxforge.operators import prefix

    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, rng.choice([None, *range(5)])) for i in range(300)]
    frame = spark.createDataFrame(rows, "k int, t int, v long").repartition(7)
    for width in (1, 7, 50, 1000):
        block = F.floor(F.col("t") / width)
        out = prefix.running(frame, "k", block, ["t"], {"s": F.coalesce("v", F.lit(0)), "n": F.lit(1)})
        out = prefix.running(out, "k", block, ["t"], {"back": F.lit(1)}, backwards=True)
        out = prefix.last_sum(out, "k", block, ["t"], "v", 4, "last")
        got = {r["t"]: (r["s"], r["n"], r["back"], r["last"]) for r in out.collect()}
        for k in (1, 2, None):
            own = [(t, v or 0) for key, t, v in rows if key == k]
            for i, (t, _) in enumerate(own):
                assert got[t] == (sum(v for _, v in own[: i + 1]), i + 1, len(own) - i, sum(v for _, v in own[max(0, i - 3) : i + 1])), (width, k, t)
        assert len(got) == 300


def test_a_long_log_is_split(spark, monkeypatch):
    """One log with nine tenths of all lines: the same blocks whatever the width, and no task has most of the lines."""
    from pyspark.sql import functions as F

    rng = random.Random(4)
    kinds = ["ERROR: bad", "at f (a.js:1)", "at error (b.js:2)", "warn: slow", "info ok", ""]
    texts = [(0, "\n".join(rng.choice(kinds) for _ in range(3000))), (1, "\n".join(rng.choice(kinds) for _ in range(300)))]
    frame, seen = spark.createDataFrame(texts, "log_id int, content string"), []
    for width in (8, 100, 100_000):
        monkeypatch.setattr(logs, "BLOCK", width)
        seen.append(sorted(map(tuple, logs.log_blocks(frame).collect())))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 500
    monkeypatch.setattr(logs, "BLOCK", 100)
    spread = logs.running(logs.log_lines(frame), "log_id", F.floor(F.col("line_no") / 100), ["line_no"], {"island": F.lit(1)})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r[0] for r in spread.groupBy(F.spark_partition_id()).count().select("count").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 0.6 * sum(sizes)


def test_duplicates(spark):
    error = "Error: failed at line 1\n    at foo"
    kept = dedupe.deduplicate(items(spark, [error] * 3 + ["something else entirely"]))
    assert kept.count() == 2
    group = dedupe.duplicate_groups(items(spark, [error] * 3 + ["something else entirely"])).first()
    assert (group["type"], group["count"]) == ("stack-trace", 3)
    stamps = [f"2024-01-0{i} 10:00:00 ERROR: x" for i in (1, 2, 3)]
    assert dedupe.deduplicate(items(spark, stamps)).count() == 1
    assert dedupe.duplicate_groups(items(spark, stamps)).first()["type"] == "context-chunk"
    near = [" ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(21)), "other words here"]
    assert [r["item_id"] for r in dedupe.deduplicate(items(spark, near)).collect()] == [2]
    assert sorted(r["item_id"] for r in dedupe.deduplicate_fixed(items(spark, near)).collect()) == [0, 2]
    same = items(spark, ["0123456789"] * 10)
    assert tuple(dedupe.dedupe_savings(same, dedupe.deduplicate(same)).first()) == (10, 1, 37, 3, 34, 92)


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.85, 1.0])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    rng = random.Random(7)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    groups = dedupe.exact_groups(items(spark, texts))
    sets = {r["first_ord"]: set(r["text"].split(" ")) for r in groups.collect()}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}
    assert {(r["a"], r["b"]) for r in dedupe.similar_pairs(groups, threshold).collect()} == want


@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.6, 0.85, 1.0])
def test_near_duplicates_equal_a_nested_loop(spark, threshold):
    """First partners, both ways of dropping and merged groups, with copies and families of alike items in between."""
    rng = random.Random(11)
    base = [[rng.choice("abcdefghijklmnopq") for _ in range(rng.randint(1, 12))] for _ in range(25)]
    texts = []
    for _ in range(110):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice("abcdefghijklmnopqrstuvwxyz")
        texts.append(" ".join(t))
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(t, []).append(i)
    sets = {own[0]: set(t.split(" ")) for t, own in groups.items()}
    copies = {own[0] for own in groups.values() if len(own) > 1}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold
    first = {a: next((b for b in sorted(sets) if b != a and alike(a, b)), None) for a in sets if a not in copies}
    frame = items(spark, texts)
    assert {(r["ord"], r["partner"]) for r in dedupe.partners(dedupe.exact_groups(frame), threshold).collect()} == {(a, b) for a, b in first.items() if b is not None}
    assert {r["ord"] for r in dedupe.deduplicate(frame, threshold).collect()} == copies | {a for a, b in first.items() if b is None}
    fixed = copies | {a for a in first if not any(alike(a, b) for b in sets if b != a and (b < a or b in copies))}
    assert {r["ord"] for r in dedupe.deduplicate_fixed(frame, threshold).collect()} == fixed
    count = {g: len(own) + sum(b == g and b < a for a, b in first.items()) for g, own in ((own[0], own) for own in groups.values()) if g in copies}
    assert {r["first_ord"]: r["count"] for r in dedupe.duplicate_groups(frame, threshold).collect()} == count


def test_written_steps_leave_no_shuffle_files(spark):
    """Duplicates took 18 times their input of disk, most of it shuffle files of steps that had ended."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before = data()
    scratch.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not data() - before


def test_pairs_of_blocks_equal_a_nested_loop(spark, monkeypatch):
    """Many blocks, and fewer postings at once than one set has."""
    for name, value in (("BLOCK", 20), ("FEW", 10), ("HELD", 40)):
        monkeypatch.setattr(dedupe, name, value)
    rng = random.Random(5)
    texts = sorted({" ".join(rng.choice("abcdefghijk") for _ in range(rng.randint(1, 9))) for _ in range(90)})
    sets = [set(t.split(" ")) for t in texts]
    want = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    groups = dedupe.exact_groups(items(spark, texts))
    assert {(r["a"], r["b"]) for r in dedupe.similar_pairs(groups, 0.5).collect()} == want
    few, rest = groups.where("first_ord % 3 = 0"), groups.where("first_ord % 3 > 0")
    assert {r["ord"] for r in dedupe.similar_to(few, rest, 0.5).collect()} == {x for a, b in want for x, y in ((a, b), (b, a)) if x % 3 == 0 and y % 3}


def test_a_round_deals_out_few_copies(spark, monkeypatch):
    """Each prefix went to every block at once, so the shuffle grew with the number of blocks times the items."""
    for name, value in (("BLOCK", 100), ("FEW", 10)):
        monkeypatch.setattr(dedupe, name, value)
    rows = spark.range(2000).select(F.col("id").alias("ord"), (10 + F.col("id") % 97 + F.when(F.col("id") % 3 == 0, 200).otherwise(0)).cast("long").alias("n")).union(spark.range(2000, 2350).select("id", F.lit(20).cast("long")))
    own, ranges, rounds = dedupe._sized(rows, 0.6)
    for pairs in rounds:
        assert max(sum((i == x) + (j == x) - (i == j == x) for i, j in pairs) for x in range(len(ranges))) <= dedupe.COPIES
    together = [p for pairs in rounds for p in pairs]
    assert len(set(together)) == len(together) and len(together) < len(ranges) * (len(ranges) + 1) // 4
    sizes = {}
    for r in rows.select("n", own.alias("own")).collect():
        sizes.setdefault(r["own"], []).append(r["n"])
    assert len(sizes) == len(ranges) > 20 and max(map(len, sizes.values())) <= 150
    for i, x in sizes.items():
        assert (min(x), max(x)) == ranges[i]
        assert all((min(i, j), max(i, j)) in together for j, y in sizes.items() if max(x) >= 0.6 * min(y) and max(y) >= 0.6 * min(x))


def test_alike_items_do_not_meet_all_others(spark, monkeypatch):
    """3,000 items of one family, all similar to each other: the pairs that are compared are about as many as the items."""
    texts = [" ".join([f"w{k}" for k in range(40)] + [f"own{i}"]) for i in range(3000)] + ["something else", "one more thing"]
    compared, real = [], dedupe._verified
    monkeypatch.setattr(dedupe, "_verified", lambda pairs, *more: (compared.append(pairs), real(pairs, *more))[1])
    assert {r["item_id"] for r in dedupe.deduplicate(items(spark, texts)).collect()} == {3000, 3001}
    assert sum(p.count() for p in compared) < 3 * len(texts)


def test_budget(spark):
    rows = [("b", 0, "spec", "x" * 532, "critical"), ("b", 1, "code", "x" * 1036, "high"), ("b", 2, "old", "x" * 2000, "low")]
    parts = budget.breakdown(spark.createDataFrame(rows, "budget_id string, ord int, name string, content string, priority string"))
    assert tuple(budget.totals(parts).first())[1:] == (892, 325, 567, 64)
    assert "Using 33% of 1,000 token budget" in budget.recommendations(parts, 1000).first()["recommendation"]
    over = budget.recommendations(parts, 100).first()["recommendation"]
    assert over.startswith("Over budget by 225 tokens. Remove low-priority items (old) to free space. Full context fits in 100 window")


def test_usage(spark):
    rows = [(1, i, t, "2024-01-01 00:00:0%d" % i, o, s) for i, (t, o, s) in enumerate([("compress_file", 1000, 800), ("x", 500, 50), ("compress_directory", 2000, 1900)])]
    req = spark.createDataFrame(rows, "session_id int, event_id int, tool string, ts string, original long, saved long")
    assert [r["tool"] for r in usage.top_saving_tools(req, 2).collect()] == ["compress_directory", "compress_file"]
    assert usage.last_request(req).first()["tool"] == "compress_directory"
    assert usage.tool_usage_map(req).first()["tool_usage"]["x"] == 1


def test_languages_and_purposes(spark):
    paths = {"foo.ts": "typescript", "bar.tsx": "typescript", "app.js": "javascript", "index.mjs": "javascript", "script.py": "python", "data.json": "unknown", "README.md": "unknown", "go": "go"}
    frame = spark.createDataFrame([(p,) for p in paths], "path string").select("path", detect_language(F.col("path")).alias("l"))
    assert {r["path"]: r["l"] for r in frame.collect()} == paths
    empty = F.array().cast(f"array<{code.SYMBOL}>"), F.array().cast(f"array<{code.IMPORT}>")
    row = spark.range(1).select(infer_purpose(F.lit("a/mapper.ts"), *empty, F.array().cast("array<string>")).alias("a"), infer_purpose(F.lit("q.ts"), *empty, F.array(F.lit("Handles user login"))).alias("b"), infer_purpose(F.lit("q.ts"), *empty, F.array().cast("array<string>")).alias("c")).first()
    assert tuple(row) == ("Application entry point", "Handles user login", "Source module")


def test_parse_ts(spark):
    text = "import { Request as Req, Response } from 'express';\nimport jwt, { sign } from 'jsonwebtoken';\nexport interface User { id: string }\nexport async function login(req: Request): Promise<void> {\n}\nexport class AuthService {\n}\nexport default AuthService;\nimport './side.css'"
    r = code.parse(spark.createDataFrame([("a.ts", text), ("b.ts", None), ("c.unknown", "import x")], "path string, content string")).orderBy("path").collect()
    assert [(i["source"], list(i["specifiers"]), bool(i["is_default"])) for i in r[0]["imports"]] == [("express", ["Request", "Response"], False), ("jsonwebtoken", ["sign", "jwt"], True), ("./side.css", [], False)]
    assert [(s["kind"], s["name"], s["line"]) for s in r[0]["symbols"]] == [("interface", "User", 3), ("function", "login", 4), ("class", "AuthService", 6)]
    assert list(r[0]["exports"]) == ["User", "login", "AuthService", "default"] and r[0]["has_default"]
    assert r[1]["symbols"] == [] and r[2]["imports"] == []


def test_resolution(spark):
    cases = {("src/a/b.ts", "./c"): "src/a/c", ("src/a/b.ts", "../x/./y"): "src/x/y", ("b.ts", "../../z"): "../../z", ("b.ts", "./q.js"): "q.js"}
    frame = spark.createDataFrame([(p, t) for p, t in cases], "p string, t string").select("p", "t", repo_graph.resolve(F.col("p"), F.col("t")).alias("r"))
    assert {(r["p"], r["t"]): r["r"] for r in frame.collect()} == cases


def test_relevance(spark):
    files = spark.createDataFrame([(0, "src/auth/login.ts", "export function loginUser() {}\nlogin login login", 50), (1, "docs/x.ts", "nothing", 7), (2, "src/z.ts", "", 0), (3, "big.ts", "login", 10**6)], "ord int, path string, content string, size_bytes long")
    ranked = relevance.rank(files, "the Login flow").collect()
    assert [r["path"] for r in ranked] == ["src/auth/login.ts", "src/z.ts"] and ranked[1]["score"] == 3
    assert relevance.query_terms("What is the Login-flow of it?") == ["what", "login-flow"]


def test_many_queries_equal_one_at_a_time(spark):
    """Postings against a scan of all files for each query, with hyphens, parts of names, repeats and terms that no file has."""
    from ctxforge.operators import postings

    rng = random.Random(9)
    words = ["load", "login", "flow", "login-flow", "order_id", "def", "func", "x-y", "index", "user", "naïve", "users", "a-", "-flow"]
    rows = []
    for i in range(60):
        lines = [rng.choice(["export function {}User() {{}}", "def {}(x):", "func {}Flow(a int)", "export const def {} = 1", "{} {} login-flow", "// {}-x-y", "def ab{}-ycd {}", "{}"]).format(*rng.choices(words, k=2)) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice(["src/auth/login.ts", "src/Index.ts", "src/index.ts", "lib/user-flow.py", "lib/x.py", "src/z.ts"]), "\n".join(lines), rng.choice([10, 10, 10**6])))
    files = spark.createDataFrame(rows, "ord int, path string, content string, size_bytes long")
    asked = ["the login flow", "login-flow login-flow user", "index", "nothing of this", "x-y", "-flow a- ---", "n-ycd w-y", "order_id def func", "User load flow users", "", "ser"]
    got = postings.rank(postings.build(files), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 7).orderBy("query_id", "position").collect()
    for i, query in enumerate(asked):
        want = [(r["ord"], r["path"], r["score"], r["reasons"]) for r in relevance.rank(files, query, 7).collect()]
        assert [(r["ord"], r["path"], r["score"], r["reasons"]) for r in got if r["query_id"] == i] == want, query


@pytest.mark.parametrize("sent", [0, 16 << 20])
def test_ranking_tasks_grow_with_what_they_hold(spark, monkeypatch, sent):
    """Files and points are dealt by their number, not by how small they are on disk; with terms broadcast and without the lists are the same."""
    from ctxforge.operators import postings

    for name, most in (("FILES", 7), ("CONTENTS", 7), ("PAIRS", 9), ("SENT_BYTES", sent)):
        monkeypatch.setattr(postings, name, most)
    assert postings.dealt(spark.range(50).withColumnRenamed("id", "ord"), 50, postings.FILES).rdd.getNumPartitions() == 8
    files = spark.createDataFrame([(i, f"src/m{i % 3}/part{i}.ts", f"export class Part{i} {{}}\nload-part load part" + " part" * (i % 5), 10) for i in range(50)], "ord int, path string, content string, size_bytes long")
    asked = ["the part load", "load-part part11", "m2", "nothing"]
    got = postings.rank(postings.build(files), spark.createDataFrame(list(enumerate(asked)), "query_id int, query string"), 5).orderBy("query_id", "position").collect()
    for i, query in enumerate(asked):
        want = [(r["ord"], r["path"], r["score"], r["reasons"]) for r in relevance.rank(files, query, 5).collect()]
        assert [(r["ord"], r["path"], r["score"], r["reasons"]) for r in got if r["query_id"] == i] == want, query


def test_diff_properties():
    rng = random.Random(1)
    for _ in range(300):
        old, new = ([rng.choice("abcd") for _ in range(rng.randint(1, 25))] for _ in range(2))
        ops = diff.diff_ops(old, new)
        assert [x for o, x in ops if o != "add"] == old and [x for o, x in ops if o != "del"] == new
    base = [f"line {i}" for i in range(120)]
    for _ in range(100):
        new = base[:]
        for _ in range(rng.randint(1, 4)):
            k = rng.randrange(len(new))
            new[k : k + rng.randint(0, 2)] = [f"new {rng.random()}"] * rng.randint(0, 2)
        hunks = diff.diff_hunks(base, new)
        # A hunk that only adds leaves out the line after it, and so does not verify.
        whole = [base[at : at + len(before)] == before for at, before, _ in hunks]
        adds_only = [len(after) > len(before) for _, before, after in hunks]
        assert all(w or a for w, a in zip(whole, adds_only))
        if all(whole):
            assert diff.applies(hunks, "\n".join(base), "\n".join(new))


def test_write_gate(spark):
    old = "\n".join(f"line number {i} of the file" for i in range(100))
    rows = [("same", old, old), ("new", None, old), ("edit", old, old.replace("number 50 ", "number fifty ")), ("short", "a", "b"), ("rewrite", old, old[::-1])]
    got = {r["path"]: r["decision"] for r in diff.write_gate(spark.createDataFrame(rows, "path string, old string, new string")).collect()}
    assert got == {"same": "pass", "new": "pass", "edit": "block", "short": "pass", "rewrite": "pass"}


def test_gates(spark):
    text = "\n".join(f"row {i} of output" for i in range(100))
    short = spark.range(1).select(gates.head_tail(F.lit(text)).alias("s"), gates.head_tail(F.lit("a\nb")).alias("t"), gates.output_decision(F.lit("Bash"), F.lit(text)).alias("d")).first()
    assert "45 lines / ~" in short["s"] and short["s"].startswith("row 0") and short["s"].endswith("row 99 of output") and short["t"] == "a\nb" and short["d"] == "shorten"


def test_prompts(spark):
    body = "\n".join(["2024-01-01T10:00:00Z INFO fine and well"] * 40)
    rows = [(1, f"look\n```log\n{body}\n```\nend $& $$"), (2, "no block"), (3, "```ts\nx\n```")]
    got = {r["prompt_id"]: r for r in prompts.compress(spark.createDataFrame(rows, "prompt_id int, prompt string")).collect()}
    assert got[1]["saved_tokens"] > 300 and "[log compressed — success, 0 errors, 0 warnings]" in got[1]["compressed"] and got[1]["compressed"].endswith("end $& $$")
    assert got[2]["compressed"] == "no block" and got[3]["saved_tokens"] == 0


def test_scan(spark, tmp_path):
    for name in ("src/__init__.py", "src/_priv/b.py", "node_modules/x.js", ".hid/y.js", "src/a.test.ts", "src/a.ts", "src/A.TS", "big.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x" * (300_000 if name == "big.js" else 3))
    rows = scan.read_tree(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r["path"] for r in rows] == ["src/__init__.py", "src/_priv/b.py", "src/a.ts"] and rows[0]["content"] == "xxx"
    assert scan.read_tree(spark, str(tmp_path), include_tests=True, most=2).count() <= 2
    assert scan.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_event_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"tool_name":"Bash","tool_input":{"command":"ls"},"tool_response":"a \\"b\\""}\nnot json\n{"tool_name":"Bash","tool_response":{"output":"o"}}\n')
    frame = events.read_events(spark, str(tmp_path / "e.json"))
    got = [r["t"] for r in frame.select(gates.response_text(F.col("tool_response")).alias("t")).collect()]
    assert got == ['a "b"', "", "o"]  # a line that is no JSON has no response
    projects = spark.createDataFrame([("1", "p", "/p", 7100, "go", "a", "b", 1, 5)], "id string, name string, path string, port int, language string, registered_at string, last_seen_at string, session_count int, total_saved long")
    events.write_registry(projects, str(tmp_path / "registry"))
    assert events.read_registry(spark, str(tmp_path / "registry")).first()["port"] == 7100
    (tmp_path / "bad.json").write_text("{oops")
    assert events.read_registry(spark, str(tmp_path / "bad.json")).count() == 0
