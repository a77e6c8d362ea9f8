"""Derived inputs hold whole texts and whole tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ctxforge.operators import diff
from ctxforge.plans import catalog, events, inputs, languages


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    texts = [" ".join(f"w{i}x{k}" for k in range(600)) for i in range(3)] + ["a short text"]
    spark.createDataFrame([(i * 20 + 3, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, t, "user", texts[0] + f" end{t}") for t in range(6)], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, texts


def test_diffs_take_whole_documents(spark, small):
    folder, texts = small
    rows = {r["doc_id"]: r for r in events._pairs(spark, folder).collect()}
    assert {i: r["old"].replace("\n", " ") for i, r in rows.items()} == {i * 20 + 3: t for i, t in enumerate(texts)}
    got = {r["doc_id"]: r for r in catalog.queries()["line_diff"](spark, folder).collect()}
    assert {i: r["keep"] + r["del"] for i, r in got.items()} == {i * 20 + 3: len(t.split(" ")) for i, t in enumerate(texts)}


def test_inputs_are_whole(spark, small):
    folder, texts = small
    items = {r["item_id"]: r["text"] for r in inputs.derived(spark, folder, "items").collect()}
    assert all(items[i * 20 + 3].endswith(t) for i, t in enumerate(texts))
    assert all(f"end{r['turn']}" in r["text"] for r in inputs.derived(spark, folder, "messages").collect())
    assert inputs.derived(spark, folder, "budget_items").where("budget_id = 3").count() == len(texts)


def plain_ops(old, new):
    table = np.zeros((len(old) + 1, len(new) + 1), int)
    for i in range(len(old)):
        for j in range(len(new)):
            table[i + 1, j + 1] = table[i, j] + 1 if old[i] == new[j] else max(table[i, j + 1], table[i + 1, j])
    ops, i, j = [], len(old), len(new)
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("keep", old[i]))
        elif j and (not i or table[i, j - 1] >= table[i - 1, j]):
            j -= 1
            ops.append(("add", new[j]))
        else:
            i -= 1
            ops.append(("del", old[i]))
    return ops[::-1]


def test_diff_equals_the_whole_table():
    rng = np.random.default_rng(3)
    for n in range(150):
        old, new = (["abcd"[k] for k in rng.integers(0, 4, rng.integers(0, 25))] for _ in range(2))
        assert diff.diff_ops(old, new) == plain_ops(old, new)


def long_ops(old, new):
    """plain_ops for long texts: a row of the table is a running maximum over the row before."""
    a, b = np.unique(old + new, return_inverse=True)[1][: len(old)], np.unique(old + new, return_inverse=True)[1][len(old) :]
    table = np.zeros((len(old) + 1, len(new) + 1), np.int32)
    for i in range(len(old)):
        table[i + 1, 1:] = np.maximum.accumulate(np.where(b == a[i], table[i, :-1] + 1, table[i, 1:]))
    ops, i, j = [], len(old), len(new)
    while i or j:
        if i and j and old[i - 1] == new[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("keep", i))
        elif j and (not i or table[i, j - 1] >= table[i - 1, j]):
            j -= 1
            ops.append(("add", j))
        else:
            i -= 1
            ops.append(("del", i))
    return ops[::-1]


def plain_hunks(old, new):
    """Changed regions with fewer than six kept lines between them as one, with three lines around."""
    ops, regions = long_ops(old, new), []
    for k, (op, _) in enumerate(ops):
        if op != "keep":
            if regions and all(o == "keep" for o, _ in ops[regions[-1][1] + 1 : k]) and k - regions[-1][1] - 1 < 6:
                regions[-1][1] = k
            else:
                regions.append([k, k])
    hunks = []
    for x, y in regions:
        at = [i for op, i in ops[x : y + 1] if op != "add"]
        first = at[0] if at else next((i + 1 for op, i in reversed(ops[:x]) if op != "add"), 0)
        last = at[-1] if at else first
        top, lead, rest = max(0, first - 3), old[max(0, first - 3) : first], old[last + 1 : min(len(old) - 1, last + 3) + 1]
        before = [old[i] for op, i in ops[x : y + 1] if op != "add"]
        after = [old[i] if op == "keep" else new[i] for op, i in ops[x : y + 1] if op != "del"]
        hunks.append((top, lead + before + rest, lead + after + rest))
    return hunks


def test_diff_queries_equal_plain_loops(spark, sf):
    """Every registered diff query over all documents: operations, hunks, whether they verify, and the write gate."""
    import math

    queries = catalog.queries()
    ops = {r["doc_id"]: (r["keep"], r["add"], r["del"]) for r in queries["line_diff"](spark, sf).collect()}
    hunks, verified = {}, {r["doc_id"]: r["verified"] for r in queries["diff_verify"](spark, sf).collect()}
    for r in queries["diff_hunks"](spark, sf).orderBy("doc_id", "place").collect():
        hunks.setdefault(r["doc_id"], []).append((r["old_start"], r["n_old"], r["n_new"]))
    gate = {r["doc_id"]: (r["decision"], r["write_cost"], r["edit_cost"], r["saved_percent"]) for r in queries["write_gate"](spark, sf).collect()}
    rows = events._pairs(spark, sf).collect()
    assert len(rows) == len(gate) == len(verified) == 200
    for r in rows:
        i, old, new = r["doc_id"], r["old"].split("\n"), r["new"].split("\n")
        kinds = [op for op, _ in long_ops(old, new)]
        assert ops[i] == tuple(kinds.count(k) for k in ("keep", "add", "del"))
        found = plain_hunks(old, new)
        assert hunks.get(i, []) == [(top, len(a), len(b)) for top, a, b in found]
        text, good = r["old"], True
        for _, a, b in found:
            a, b = "\n".join(a), "\n".join(b)
            good, text = good and a in text, text.replace(a, b, 1)
        good = good and text == r["new"]
        if "$" not in r["new"]:  # no marks to fill in
            assert verified[i] == good
        cost = lambda x: math.ceil(len(x) / 3.5)
        able = r["old"] != r["new"] and 50 <= len(old) <= 800 and len(new) <= 800
        edit = sum(cost("\n".join(a)) + cost("\n".join(b)) for _, a, b in found)
        percent = math.floor((1 - edit / cost(r["new"])) * 100 + 0.5)
        if able:
            assert gate[i] == ("block" if found and percent >= 40 and verified[i] else "pass", cost(r["new"]), edit, percent)
        else:
            assert gate[i][0] == "pass" and gate[i][2] is None


def test_texts_and_their_diffs_go_in_short_batches(spark, small):
    """Batches of 10,000 documents with a struct for each line took more than an executor has."""
    folder, texts = small
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = catalog.queries()["line_diff"](spark, folder)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 200
    assert rows.count() == len(texts)
    assert diff.line_diff.evalType != 200  # made of Arrow arrays, not of a pandas series of dicts


def test_required_names_are_all_imports_without_default(spark, sf):
    rows = catalog.queries()["js_requires"](spark, sf).collect()
    assert {"express", "zod", "../types"} <= {r["source"] for r in rows}


@pytest.mark.parametrize("rows", [400, 12_001])
def test_files_are_made_and_parsed_by_many_tasks(spark, tmp_path, rows):
    """However small the table that they are made of, a task gets at most some thousand files."""
    part = spark.range(rows).select("id", (F.col("id")).alias("p_partkey"), *(F.lit("x").alias(c) for c in ("p_name", "p_type", "p_brand")))
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for files in (inputs.derived(spark, str(tmp_path), "files"), languages._files(spark, str(tmp_path))):
        assert files.rdd.getNumPartitions() == -(-rows // inputs.PARTS)
        assert files.select("ord").distinct().count() == rows
