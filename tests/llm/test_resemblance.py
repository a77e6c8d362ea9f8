"""Near-duplicates of the pipeline are held against the real sets of shingles."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ctxforge.llm import simhash
from ctxforge.llm.common import materialize
from ctxforge.llm.simhash import BANDS, ROWS, _linked, least_hashes, resembling, shingle_hashes
from ctxforge.operators import dedupe


def shingles(text):
    words = text.split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def planted(n_pairs, sizes=(12, 30, 80, 400)):
    """(text, text, resemblance) around the bound: words replaced at spread places."""
    rng, out = random.Random(21), []
    for g in range(n_pairs):
        size = sizes[g % len(sizes)]
        words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        other = words[:]
        for _ in range(rng.choice([0, 1, 1, 2]) if size < 40 else rng.randint(size // 60, size // 25)):
            other[rng.randrange(size)] = f"z{rng.randrange(10**6)}"
        x, y = " ".join(words), " ".join(other)
        a, b = shingles(x), shingles(y)
        out.append((x, y, len(a & b) / len(a | b)))
    return out


def test_links_are_those_of_the_sets(spark):
    pairs = planted(600)
    assert all(sum(lo <= j < hi for _, _, j in pairs) >= 25 for lo, hi in ((0.65, 0.7), (0.7, 0.75), (0.75, 0.8), (0.8, 0.85)))
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r["doc_id"]: r["component_id"] for r in resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[2 * i + 1] == 2 * i for i in range(len(pairs))]
    assert linked == [j >= 0.8 for _, _, j in pairs]  # recall 1, no false drop


def test_chains_and_buckets_of_many(spark):
    """Texts whose neighbours resemble each other, but not the ends; and copies of one text with a word changed."""
    rng = random.Random(5)
    stream = [f"w{rng.randrange(10**6)}" for _ in range(800)]
    chain = [" ".join(stream[i * 15 : i * 15 + 400]) for i in range(20)]
    base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
    dense = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in range(200)]
    rows = list(enumerate(chain + dense))
    got = {r["doc_id"]: r["component_id"] for r in resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == [0] * 20 + [20] * 200


def missed_by_bands():
    """Pairs of texts whose sets share 40 of 50 shingles, but none of the 25 bands."""
    out = []
    for seed in (15054, 103804, 163655, 168744, 185388):
        rng = random.Random(seed)
        words = [f"w{rng.randrange(10**6)}" for _ in range(49)]
        out.append((" ".join(words), " ".join([*words[:24], f"z{seed}", *words[25:]])))
    return out


def test_pairs_that_share_no_band_are_found(spark):
    """Pairs at 0.8 that share no band stayed apart, and both documents were kept (one in 20,000)."""
    pairs = missed_by_bands()
    for x, y in pairs:
        a, b = (least_hashes(np.unique(shingle_hashes(t.encode(), 5)))[: BANDS * ROWS].reshape(ROWS, BANDS) for t in (x, y))
        assert len(shingles(x) & shingles(y)) == 40 and not (a == b).all(0).any()
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash.one_of_each(docs).collect()} == {2 * i for i in range(len(pairs))}


def test_links_without_bands_are_those_of_the_sets(spark, monkeypatch):
    """Marks that rule out every pair of a band: what is left is found by rare shingles alone, also where most shingles are frequent."""
    monkeypatch.setattr(simhash, "MARK_BITS", -1)
    monkeypatch.setattr(simhash, "FREQUENT", 50)
    monkeypatch.setattr(dedupe, "BLOCK", 100)
    rng = random.Random(9)
    page = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    pairs = planted(200)
    pages = [(" ".join(page + x[:n]), " ".join(page + y[:n])) for n in (5, 20, 60, 200) for x, y in (([f"q{rng.randrange(10**6)}" for _ in range(n)],) * 2 for _ in range(3)) for y in ([*x[: n // 2], "other", *x[n // 2 + 1 :]],)]
    rows = list(enumerate([t for x, y, _ in pairs for t in (x, y)] + [t for p in pages for t in p]))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    lists = {}
    for i, s in enumerate(sets):
        both = {}
        for x in s:
            for j in lists.setdefault(x, []):
                both[j] = both.get(j, 0) + 1
            lists[x].append(i)
        for j, n in both.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    got = {r["doc_id"]: r["component_id"] for r in resembling(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i, _ in rows] == root and len(set(root)) < len(rows)


@pytest.mark.parametrize("pairs_per_set", [8, 0])
def test_large_buckets_are_compared_by_pairs_of_blocks(spark, monkeypatch, pairs_per_set):
    """Blocks of few sets, with pairs named or, where they would be too many, sets compared: the classes stay the same, and no group
    holds more than two blocks."""
    rng = random.Random(6)
    base = [f"v{rng.randrange(10**6)}" for _ in range(150)]
    texts = []
    for i in range(90):  # a family in which some resemble each other and some do not
        gone = set(rng.sample(range(150), rng.choice((0, 1, 2, 6, 9))))
        texts.append(" ".join(f"x{i}y{k}" if k in gone else w for k, w in enumerate(base)))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r["doc_id"]: r["component_id"] for r in resembling(frame).collect()}
    assert 1 < len(set(want.values())) < 90
    monkeypatch.setattr(simhash, "BLOCK_SETS", 10)
    monkeypatch.setattr(simhash, "PAIRS_PER_SET", pairs_per_set)
    assert {r["doc_id"]: r["component_id"] for r in resembling(frame).collect()} == want


def test_a_bucket_of_unlike_sets_is_dealt_out(spark):
    """16,000 sets of one bucket: pairs of blocks, each pair of sets in exactly one group, none with more than two blocks' sets."""
    from pyspark.sql import functions as F

    rows = simhash._dealt(spark.range(16_000).select(F.lit(5).cast("long").alias("code"), F.col("id").alias("key"), F.lit(16_000).cast("long").alias("many")))
    sizes = {(r["low"], r["high"]): r["count"] for r in rows.groupBy("low", "high").count().collect()}
    assert len(sizes) == 8 * 9 // 2 and max(sizes.values()) < 2.2 * simhash.BLOCK_SETS
    blocks = {i: n for (i, j), n in sizes.items() if i == j}
    assert sum(blocks.values()) == 16_000 and all(sizes[i, j] == blocks[i] + blocks[j] for i, j in sizes if i < j)


def test_least_hashes_agree_as_often_as_sets_resemble():
    rng, agree, bands = np.random.default_rng(2), [], []
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 450, dtype=np.uint64)
        x, y = least_hashes(h[:400]), least_hashes(h[50:])  # 350 of 450 shared
        agree.append((x == y).mean())
        bands.append((x == y)[: BANDS * ROWS].reshape(ROWS, BANDS).all(0).any())
    assert abs(np.mean(agree) - 350 / 450) < 0.01 and all(bands)


def test_components_of_a_bucket_equal_all_pairs():
    rng = random.Random(8)
    base = [f"v{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(f"x{i}y{k}" if k in gone else w for k, w in enumerate(base)) for i in range(60) for gone in [rng.sample(range(120), rng.randint(0, 4))]]
    sets = [np.unique(shingle_hashes(t.encode(), 5)) for t in texts]
    got = _linked(pd.DataFrame({"key": range(60), "label": range(60), "shingles": [s.tobytes() for s in sets], "block": 0, "low": 0, "high": 0}))
    alike = {(i, j) for i in range(60) for j in range(60) if i != j and 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j]))}
    edges = set(zip(got["a"], got["b"]))

    def parts(edges):
        root = list(range(60))
        for _ in range(60):
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        return root

    assert edges <= alike and parts(edges) == parts(alike)


def test_written_steps_leave_no_shuffle_files(spark):
    """Near dedup was projected to 4.6 times its input of disk, most of it shuffle files of steps that had been written."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {f for f in files.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f and f.endswith(".data")}
    before = data()
    materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not data() - before
