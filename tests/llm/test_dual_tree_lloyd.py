"""Two trees against all distances in plain integers, for any size of blocks; what the trees promise about distances."""

import hashlib

import numpy as np
import pytest

from ctxforge.llm import dual_tree_lloyd as L


def plain(rows, k=16, rounds=3, dimension=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) with Python's integers."""
    import math

    kept = [(i, [max(-L.MOST, min(L.MOST, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)]
    seats = [v for _, v in sorted(((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept))[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for n in range(rounds + 1):
        label = [min((square(v, s), c) for c, s in enumerate(seats)) for _, v in kept]
        if n < rounds:
            for c in range(len(seats)):
                own = [v for (_, v), x in zip(kept, label) if x[1] == c]
                if own:
                    seats[c] = [sum(col) // len(own) for col in zip(*own)]
    inertia = [sum(d for d, x in label if x == c) for c in range(len(seats))]
    digest = [hashlib.sha256(",".join(map(str, s)).encode()).hexdigest() for s in seats]
    long = lambda n: n if n < 1 << 63 else None
    return sorted(((i, c, d, long(inertia[c]), long(sum(inertia)), digest[c]) for (i, _), (d, c) in zip(kept, label)), key=repr)


def found(frame, **options):
    return sorted(map(tuple, L.with_inertia(*L.cluster(L.whole_vectors(frame, 64, 64), **options)).collect()), key=repr)


def vectors(seed, n=700):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=64) * (0.02, 0.3, 1)[i % 3]]) for i in range(n)]
    return rows + [(5000 + i, rows[3][1]) for i in range(60)] + [rows[9]] * 3  # copies, repeated rows


@pytest.mark.parametrize("block, leaf, fanout", [(4096, 16, 32), (100, 3, 4), (1, 1, 2)])
def test_equals_all_distances(spark, monkeypatch, block, leaf, fanout):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FANOUT", fanout)):
        monkeypatch.setattr(L, name, value)
    rows = vectors(block)[: 60 if block == 1 else None]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)) == plain(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(x) / 64 for x in [(-1) ** i * (i % 4), *[0] * 63]]) for i in range(40)]
    assert found(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == plain(rows)


def test_awkward_rows(spark):
    good = [float(x) for x in range(64)]
    rows = [(0, None), (1, []), (2, good[:63]), (3, [None, *good[1:]]), (4, [float("nan"), *good[1:]]), (5, [float("inf"), *good[1:]]), (None, good), (6, good), (6, good), (7, [1e300, *good[1:]]), (8, [-1e30] * 64), (9, [0.0] * 64)]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(1).alias(n) for n in ("v", "cluster", "distance", "a.b", "ids")))
    assert found(frame) == plain(rows)
    assert found(frame.limit(0)) == [] and found(frame.where("vec_id = 9")) == plain(rows[-1:])


def test_cover_tree():
    """Every point lies within its nodes' radii, children split their parent, and centres of siblings lie further apart than points from their own."""
    points = np.array([v for _, v in vectors(1)]) * 64
    points = np.floor(points).astype(np.int64)
    tree = L.CoverTree(points, 4)
    own = points[tree.order]
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    for node, (lo, hi) in enumerate(tree.rows.tolist()):
        away = np.sqrt(((own[lo:hi] - own[tree.centre[node]]) ** 2).sum(1))
        assert away.max() <= tree.radius[node] + 1e-6 and lo <= tree.centre[node] < hi
        a, b = tree.children[node].tolist()
        if a < b:
            assert tree.rows[a, 0] == lo and tree.rows[b - 1, 1] == hi and (tree.rows[a + 1 : b, 0] == tree.rows[a : b - 1, 1]).all()
            seats = own[tree.centre[a:b]]
            apart = min(np.sqrt(((seats[i] - seats[j]) ** 2).sum()) for i in range(b - a) for j in range(i))
            assert apart >= tree.radius[a:b].max() - 1e-6


def test_pruning_saves_distances():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 64)) * 100
    points = np.floor(centres[rng.integers(0, 16, 4096)] + rng.normal(size=(4096, 64))).astype(np.int64)
    tree = L.CoverTree(points, L.LEAF)
    seats = np.floor(centres).astype(np.int64)
    label, work = L.Block(None, points[tree.order], tree).nearest(seats, L.CoverTree(seats, 1))
    assert (label == ((points[tree.order][:, None] - seats[None]) ** 2).sum(2).argmin(1)).all()
    assert work < 0.05 * 4096 * 16
