"""The permutation index: footrule distances, recall against brute force, independence of partitioning."""

import math

import numpy as np
import pytest

from ctxforge.llm import permutation_index as P


def footrule(a, b):
    """Footrule distance of two top lists; what a list lacks stands just behind its end."""
    m = len(a)
    place = [{p: i + 1 for i, p in enumerate(x)} for x in (a, b)]
    return sum(abs(place[0].get(p, m + 1) - place[1].get(p, m + 1)) for p in set(a) | set(b))


def test_closeness_is_footrule():
    rng = np.random.default_rng(1)
    orders = np.array([rng.permutation(30)[:8] for _ in range(50)], np.int16)
    files = P.InvertedFiles(orders, 30)
    for q in orders[:10]:
        got = files.closeness(q.tolist())
        assert np.allclose(8 * 9 - 2 * got, [footrule(q.tolist(), x.tolist()) for x in orders])


@pytest.mark.parametrize("dimension, clusters", [(64, 0), (256, 0), (768, 0), (256, 50)])
def test_recall(dimension, clusters):
    """At least 0.9 of the 20 nearest, for even directions in many dimensions as well."""
    rng = np.random.default_rng(dimension)
    v = rng.normal(size=(6000, dimension))
    if clusters:
        v = rng.normal(size=(clusters, dimension))[rng.integers(0, clusters, len(v))] + 0.5 * v
    pivots = P.Pivots(v[:4096], math.sqrt((v * v).sum(1).max()))
    share = P.fitted_share(v[:4096], pivots)
    q, found = np.arange(0, 6000, 60), {}
    for at in range(0, 6000, 2000):
        for a, i, s in zip(*P.nearest_in_block(np.arange(at, at + 2000), v[at : at + 2000], q, v[q], pivots, 20, share)):
            found.setdefault(a, []).append((-s, i))
    score = v[q] @ v.T
    score[np.arange(len(q)), q] = -np.inf
    top = np.argsort(-score, axis=1)[:, :20]
    hit = sum(len({i for _, i in sorted(found[a])[:20]} & set(t.tolist())) for a, t in zip(q, top))
    assert hit >= 0.9 * 20 * len(q)
    assert share < 0.05 if clusters else share < 0.9


def test_partitioning_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 400)
    monkeypatch.setattr(P, "BLOCK_BYTES", 40_000)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))]
    rows += [(2000 + i, rows[7][1]) for i in range(200)] + [rows[40], rows[40]]  # many equal vectors, and repeated rows
    frame = P.clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [sorted(map(tuple, P.nearest(f, f.where("vec_id % 20 = 0")).collect())) for f in (frame.repartition(1), frame.repartition(7))]
    assert got[0] == got[1] and P.blocks_of(1102, 16, P.BLOCKS) > 3
    monkeypatch.setattr(P, "BLOCKS", 1)  # a few blocks go ahead: the same rows
    monkeypatch.setattr(P, "AHEAD", 3)
    assert sorted(map(tuple, P.nearest(frame, frame.where("vec_id % 20 = 0")).collect())) == got[0]
    assert all(i != q for q, _, i, _ in got[0]) and len({(q, i) for q, _, i, _ in got[0]}) == len(got[0])
    copies = [(r, i) for q, r, i, _ in got[0] if q == 2000]
    assert copies == [(1, 7), *((k + 2, 2001 + k) for k in range(19))]
