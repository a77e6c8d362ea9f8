import random
import re
import time
from collections import defaultdict

import numpy as np
import xxhash
from edges import ROWS, documents, empty

from ctxforge.llm.exact_dedup import DigestIndex
from ctxforge.llm.line_dedup import dedup_lines
from ctxforge.llm.simhash import fingerprint, near_duplicates, one_of_each, resembling, shingle_hashes
from ctxforge.llm.vptree import Forest, build_tree, components, links, number_leaves, route, search


def test_exact_edges(spark):
    got = DigestIndex(spark).dedup(documents(spark), "first").collect()
    assert len(got) == len(ROWS)
    by = defaultdict(list)
    for i, text, _ in ROWS:
        by[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    sizes = sorted(len(v) for v in by.values() for _ in v)
    assert sorted(r["group_size"] for r in got) == sizes
    assert sum(r["kept"] for r in got) == len(by)
    assert {r["keep_id"] for r in got if r["doc_id"] == 3} == {2} and {r["keep_id"] for r in got if r["doc_id"] == 4} == {4}
    assert DigestIndex(spark).dedup(empty(spark), "first").count() == 0


def test_exact_batches(spark):
    index = DigestIndex(spark, buckets=3)
    first = index.dedup(spark.createDataFrame([(5, "a  b"), (6, "c")], "doc_id long, text string"), "first").collect()
    assert all(r["kept"] for r in first)
    second = {r["doc_id"]: r for r in index.dedup(spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string"), "second").collect()}
    assert (second[1]["keep_id"], second[1]["kept"]) == (5, False) and second[2]["kept"] and not second[3]["kept"]
    assert index.table().count() == 3
    again = index.dedup(spark.createDataFrame([(1, "a b"), (2, "d"), (3, "d")], "doc_id long, text string"), "second").collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in second.values()} and index.table().count() == 3
    index.compact()
    assert index.table().count() == 3
    named = index.dedup(spark.createDataFrame([(1, "a b"), (2, "d"), (9, "e")], "doc_id long, text string"), batch="another").collect()
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in named} == {1: (5, False), 2: (2, False), 9: (9, True)}
    assert index.table().count() == 4
    assert "Exchange" not in index.table().groupBy("digest").count()._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")


def test_exact_index_is_found_again(spark, tmp_path):
    docs = spark.createDataFrame([(5, "a"), (6, "b")], "doc_id long, text string")
    for wanted in (True, True):  # a run, and the same one after its output was lost
        index = DigestIndex(spark, "kept_index", str(tmp_path / "kept"), 2)
        assert all(r["kept"] == wanted for r in index.dedup(docs, "first").collect())
    assert not any(r["kept"] for r in DigestIndex(spark, "kept_index", str(tmp_path / "kept"), 2).dedup(docs, batch="later").collect())
    index.drop()


def test_the_same_contents_twice_are_duplicates(spark):
    """Delivered again as another batch, nothing is kept; as the same batch, after a lost run, what was kept is kept."""
    index, docs = DigestIndex(spark, buckets=2), spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    kept = [[r["kept"] for r in index.dedup(docs, name).collect()] for name in ("monday", "tuesday", "monday")]
    assert kept == [[True, True], [False, False], [True, True]] and index.table().count() == 2


def test_many_copies_of_one_row(spark, monkeypatch):
    import ctxforge.llm.exact_dedup as E

    monkeypatch.setattr(E, "COPIES", 7)
    rows = DigestIndex(spark).dedup(spark.createDataFrame([(1, "x")] * 50 + [(2, "x")], "doc_id long, text string"), "first").collect()
    assert len(rows) == 51 and sum(r["kept"] for r in rows) == 1 and {r["group_size"] for r in rows} == {51}


def brute_lines(rows):
    windows, docs = {}, {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if not "".join(w).strip(" "):
                continue
            if w in windows:
                gone |= {p, p + 1, p + 2}
            else:
                windows[w] = 1
        docs[i, text] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return docs


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "c d"]) for _ in range(rng.randint(1, 12)))) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_lines(rows)
    for r in dedup_lines(frame).collect():
        text = dict(rows)[r["doc_id"]]
        assert r["text"] == want[r["doc_id"], text]
        assert r["n_lines"] == len(text.split("\n"))


def test_line_dedup_edges(spark):
    frame = documents(spark)
    got = dedup_lines(frame)
    others = [c for c in frame.columns if c not in ("n_lines", "n_removed")]
    assert got.columns == [*others, "n_lines", "n_removed"] and got.count() == len(ROWS)
    assert dedup_lines(frame, added=("p", "q")).columns == [*frame.columns, "p", "q"]
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] == ROWS[0][1] and texts[1] == "" and texts[2] == "" and texts[7] == ROWS[7][1]
    assert dedup_lines(empty(spark)).count() == 0


def test_line_dedup_where_nothing_is_sent(spark, monkeypatch):
    import ctxforge.llm.common as C
    import ctxforge.llm.line_dedup as L

    monkeypatch.setattr(L, "sent_if_small", lambda table, row_bytes: C.sent_if_small(table, row_bytes, -1))
    test_line_dedup_equals_brute_force(spark)


def test_line_dedup_of_many_lines(spark):
    frame = spark.createDataFrame([(0, "\n".join(f"line {i}" for i in range(40_000))), (1, "\n".join(f"line {i}" for i in range(39_999)) + "\nlast")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in dedup_lines(frame).collect()}
    assert got[0]["n_removed"] == 0 and got[1]["n_removed"] == 39_999 and got[1]["text"] == "last"
    assert time.perf_counter() - began < 10


def brute_components(codes, radius):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 12, 900, dtype=np.uint64)
    codes = np.concatenate([base, base[:50] ^ np.uint64(1 << 40), rng.integers(0, 1 << 63, 200, dtype=np.uint64)])
    tree, leaves = number_leaves(build_tree(codes[:200], 16))
    assert leaves > 4
    for radius in (0, 1, 2, 4):
        row, leaf, home = route(tree, codes, radius)
        assert sorted(row[home]) == list(range(len(codes)))
        seen = defaultdict(lambda: (set(), set()))
        for r, x, h in zip(row.tolist(), leaf.tolist(), home.tolist()):
            seen[x][0 if h else 1].add(r)
        for i in range(0, len(codes), 7):
            for j in np.flatnonzero(np.bitwise_count(codes ^ codes[i]) <= radius).tolist():
                assert any((i in h and (j in h or j in g)) or (j in h and i in g) for h, g in seen.values())


def test_search_equals_brute_force(monkeypatch):
    import ctxforge.llm.vptree as V

    monkeypatch.setattr(V, "BLOCK", 2000)
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 14, 700, dtype=np.uint64)
    forest = Forest(len(codes))
    search(codes, np.arange(len(codes)), np.arange(len(codes)), 1, forest)
    assert forest.root.tolist() == brute_components(codes.tolist(), 1)


def test_links_over_shards(spark, monkeypatch):
    import ctxforge.llm.vptree as V

    monkeypatch.setattr(V, "SHARD_CODES", 40)
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 16, 600))
    points = spark.createDataFrame([(0, int(c), int(c), None) for c in codes], "band int, key long, code long, wide binary")
    labels = {r["v"]: r["label"] for r in components(links(points, 2)).collect()}
    want = brute_components([int(c) for c in codes], 2)
    assert [labels.get(int(c), int(c)) for c in codes] == [int(codes[w]) for w in want]


def test_links_where_leaves_are_split_on(spark, monkeypatch):
    import ctxforge.llm.vptree as V

    monkeypatch.setattr(V, "SHARD_CODES", 20)
    monkeypatch.setattr(V, "TOP_LEAVES", 4)
    rng = np.random.default_rng(6)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 15, 500), rng.integers(0, 1 << 62, 300)]))
    points = spark.createDataFrame([(0, int(c), int(c), None) for c in codes], "band int, key long, code long, wide binary")
    labels = {r["v"]: r["label"] for r in components(links(points, 2)).collect()}
    want = brute_components([int(c) for c in codes], 2)
    assert [labels.get(int(c), int(c)) for c in codes] == [int(codes[w]) for w in want]
    levels = V.further_levels(3, rng.permutation(codes)[:60].astype(np.uint64), 800)
    row, shard, home = route(3, codes.astype(np.uint64), 2, {3: levels})
    assert len(levels) == 6 and sorted(row[home]) == list(range(len(codes)))
    assert np.unique(shard[home], return_counts=True)[1].max() < len(codes) / 3


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["v"]: r["label"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def plain_fingerprint(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_classes(spark):
    got = near_duplicates(documents(spark)).collect()
    assert len(got) == len(ROWS)
    prints = [plain_fingerprint(t, 3) for _, t, _ in ROWS]
    assert sorted(r["fp"] % 2**64 for r in got) == sorted(prints)
    want = brute_components(prints, 2)
    reps = defaultdict(list)
    for (i, _, _), w in zip(ROWS, want):
        if i is not None:
            reps[w].append(i)
    by_print = {p: min(reps[w], default=None) for p, w in zip(prints, want)}
    assert all(r["component_id"] == by_print[r["fp"] % 2**64] for r in got)
    assert near_duplicates(empty(spark)).count() == 0
    assert fingerprint(shingle_hashes(b"One TWO three four", 3))[0] == plain_fingerprint("one two three four", 3)


def test_resembling_documents(spark):
    rng = random.Random(9)
    rows, truth = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for c in range(3):
            own = words[:]
            for _ in range(c):  # up to 2 of 300 words differ
                own[rng.randrange(300)] = f"z{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
            truth[len(rows) - 1] = g * 3
    got = {r["doc_id"]: r["component_id"] for r in resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] == truth[i] for i in truth) >= 0.97 * len(truth)
    assert all(truth[got[i]] == truth[i] for i in truth)  # no group is joined with another


def test_one_of_each_edges(spark):
    frame = documents(spark)
    kept = one_of_each(frame)
    assert set(kept.columns) == set(frame.columns)
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["0", "2", "5", "7", "8", "9", "10", "None"])
    assert one_of_each(empty(spark)).count() == 0


def test_texts_that_share_an_id(spark, monkeypatch):
    import ctxforge.llm.common as C
    import ctxforge.llm.simhash as S

    big, words = 2**60 + 1, [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    rows = [(big, words[0]), (big, words[1]), (big + 1, words[0]), (big + 2, words[1] + " tail"), (big, words[0]), (None, words[2]), (None, words[2])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([(str(big), words[0]), (str(big), words[1]), ("None", words[2]), ("None", words[2])])
    for most in (1 << 20, -1):
        monkeypatch.setattr(S, "sent_if_small", lambda table, row_bytes: C.sent_if_small(table, row_bytes, most))
        assert sorted((str(r["doc_id"]), r["text"]) for r in one_of_each(frame).collect()) == want
