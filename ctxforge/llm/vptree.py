"""Exact Hamming range joins with vantage-point trees, and connected components of their links.

A tree built on the driver from a sample of codes splits the space: each inner node has a vantage
code and a radius, and sends codes within the radius one way and the others the other way. A code lives in one
home leaf; a copy goes to each further leaf that the triangle bound cannot exclude, but only from the inner
side of a boundary to the outer side, since one of the two codes of a pair has to travel. Sample and tree are bounded
(TOP_LEAVES); a leaf that holds more codes than a shard should is split on, by as many further levels as its count
asks for, each with one vantage for the whole level, so what the driver knows does not grow with the data
and a shard does not either. (No more than 65 codes lie within two bits of each other, so no group defies splitting.)

Within a shard, nodes of a deeper tree split the points by their exact distance to a vantage code and
keep, for each distance, the queries that differ by no more than the search radius; what is left is
compared in blocks. Links go into a union-find at once and a shard returns a spanning forest, so a
dense group of k codes gives at most k edges, never k*k pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctxforge.llm.common import forget, materialize

#: Home codes that a shard should hold, leaves of the tree at most, and sampled codes for each leaf.
SHARD_CODES, TOP_LEAVES, SAMPLE_PER_LEAF = 8192, 1024, 24
#: Comparisons that are done as one block.
BLOCK = 1 << 21


def build_tree(sample: np.ndarray, leaves: int, depth: int = 0):
    """A leaf is None; an inner node is (vantage, radius, inner child, outer child)."""
    if leaves <= 1 or len(sample) < 2 or depth > 40:
        return None
    tries = sample[np.linspace(0, len(sample) - 1, min(8, len(sample))).astype(int)]
    spread = [np.std(np.bitwise_count(sample ^ v).astype(np.float32)) for v in tries]
    vantage = tries[int(np.argmax(spread))]
    distance = np.bitwise_count(sample ^ vantage)
    radius = int(np.median(distance))
    inner = distance <= radius
    if inner.all():
        radius -= 1
        inner = distance <= radius
    if not inner.any() or inner.all():
        return None
    below = max(1, min(leaves - 1, round(leaves * inner.mean())))
    return (int(vantage), radius, build_tree(sample[inner], below, depth + 1), build_tree(sample[~inner], leaves - below, depth + 1))


def number_leaves(tree, first: int = 0):
    """The same tree with leaf numbers in place of None, and the next free number."""
    if tree is None:
        return first, first + 1
    inner, n = number_leaves(tree[2], first)
    outer, n = number_leaves(tree[3], n)
    return (tree[0], tree[1], inner, outer), n


def split(codes: np.ndarray, home: np.ndarray, guest: np.ndarray, vantage: int, bound: int, radius: int):
    """((home, guest) of the inner side, and of the outer side): where rows of codes live and copies have to look."""
    d, g = (np.bitwise_count(codes[x] ^ np.uint64(vantage)).astype(np.int16) for x in (home, guest))
    crossing = home[(d <= bound) & (d + radius > bound)]
    return (home[d <= bound], guest[g - radius <= bound]), (home[d > bound], np.concatenate([crossing, guest[g + radius > bound]]))


def route(tree, codes: np.ndarray, radius: int, levels: dict | None = None):
    """(row, shard, is_home) arrays: where each code lives and where copies of it have to look.

    levels: for leaves that are split on, their (vantage, radius) pairs; a shard is a leaf and a side for each level."""
    rows, shards, homes = [], [], []
    levels = levels or {}
    todo = [(tree, 0, 0, np.arange(len(codes)), np.arange(0))]
    while todo:
        node, depth, sides, home, guest = todo.pop()
        if not len(home) and not len(guest):
            continue
        if isinstance(node, tuple):
            inner, outer = split(codes, home, guest, node[0], node[1], radius)
            todo += [(node[2], 0, 0, *inner), (node[3], 0, 0, *outer)]
        elif depth < len(levels.get(node, ())):
            inner, outer = split(codes, home, guest, *levels[node][depth], radius)
            todo += [(node, depth + 1, sides << 1, *inner), (node, depth + 1, sides << 1 | 1, *outer)]
        else:
            rows += [home, guest]
            shards.append(np.full(len(home) + len(guest), sides << 24 | node, np.int64))
            homes.append(np.arange(len(home) + len(guest)) < len(home))
    if not rows:
        return np.arange(0), np.arange(0), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def further_levels(leaf: int, sample: np.ndarray, count: int) -> list[tuple[int, int]]:
    """(vantage, radius) for each level that a leaf of count codes needs; sample: some of its codes. Vantages are drawn from
    the sample and from a generator seeded by the leaf; each level takes what splits the sample's groups into the least squares."""
    rng, out, groups = np.random.default_rng(leaf), [], np.zeros(len(sample), np.int64)
    for _ in range(max(0, math.ceil(math.log2(max(1, count) / SHARD_CODES)))):
        tries = np.concatenate([rng.integers(0, 1 << 63, 8, dtype=np.uint64) << np.uint64(1), sample[rng.integers(0, len(sample), 8)]])
        found = []
        for vantage in tries:
            distance = np.bitwise_count(sample ^ vantage).astype(np.int64)
            for radius in np.unique(np.quantile(distance, (0.25, 0.4, 0.5, 0.6, 0.75)).astype(int)).tolist():
                sides = 2 * groups + (distance > radius)
                squares = int((np.unique(sides, return_counts=True)[1] ** 2).sum())
                found.append((squares, -float(distance.std()), int(vantage), radius, sides))
        _, _, vantage, radius, sides = min(found, key=lambda f: f[:4])
        groups = np.unique(sides, return_inverse=True)[1]
        out.append((vantage, radius))
    return out


class Forest:
    """Union-find over 0..n-1 in which every node points at its root, the smallest of its group."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def search(codes: np.ndarray, points: np.ndarray, queries: np.ndarray, radius: int, forest: Forest, agree=None) -> None:
    """Link each of points with each of queries within radius; agree(a, b) may reject pairs."""
    todo = [(points, queries, 0)]
    while todo:
        p, q, depth = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) * len(q) > BLOCK and depth < 8 and len(p) > 64:
            vantage = codes[p[len(p) // 2]]
            dp, dq = (np.bitwise_count(codes[x] ^ vantage).astype(np.int16) for x in (p, q))
            shells = np.unique(dp)
            if len(shells) > 2 * radius:
                todo += [(p[dp == s], q[np.abs(dq - s) <= radius], depth + 1) for s in shells.tolist()]
                continue
        step = max(1, BLOCK // len(q))
        for at in range(0, len(p), step):
            some, others = p[at : at + step], q
            roots = forest.root[some]
            if roots[0] == roots.max() == roots.min():  # a dense group needs no comparison within itself
                others = q[forest.root[q] != roots[0]]
            near = np.bitwise_count(codes[some][:, None] ^ codes[others][None, :]) <= radius
            a, b = np.nonzero(near)
            a, b = some[a], others[b]
            fresh = forest.root[a] != forest.root[b]
            a, b = a[fresh], b[fresh]
            if agree is not None and len(a):
                good = agree(a, b)
                a, b = a[good], b[good]
            forest.link(a, b)


def links(points: DataFrame, radius: int, wide_bits: int | None = None, label: str = "links") -> DataFrame:
    """Edges (a, b) of a spanning forest per shard over all pairs of keys whose codes are near.

    points: band int, key long, code long, wide binary. Pairs are sought within a band, at radius or
    fewer differing bits of code; with wide_bits, wide codes must also differ in that many bits at most.
    """
    points = points.select("band", "key", "code", "wide")
    sizes = {r["band"]: r["n"] for r in points.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {b: max(1, math.ceil(n / SHARD_CODES)) for b, n in sizes.items()}
    most = max(1, TOP_LEAVES // max(1, len(sizes)))
    leaves = {b: min(n, most) for b, n in wanted.items()}
    trees, levels, first, samples = {}, {}, 0, {}
    if max(wanted.values(), default=1) > 1:
        part = min(1.0, SAMPLE_PER_LEAF * max(leaves.values()) / max(sizes.values()))
        spread = F.pmod(F.xxhash64("code", F.lit("sample")), F.lit(1 << 30)) < int(part * (1 << 30))
        found = points.where(spread).select("band", "code").toPandas().sort_values(["band", "code"])
        samples = {b: found.code[found.band == b].to_numpy().view(np.uint64) for b in sizes}
    for b in sorted(sizes):
        sample = samples.get(b, np.zeros(0, np.uint64))
        order = np.argsort(sample * np.uint64(0x9E3779B97F4A7C15))
        trees[b], first = number_leaves(build_tree(sample[order], leaves[b]), first)

    def routed(batches):
        for pdf in batches:
            for b, own in pdf.groupby("band"):
                own = own.reset_index(drop=True)
                row, leaf, home = route(trees[b], own["code"].to_numpy().view(np.uint64), radius, levels)
                yield pd.DataFrame({"leaf": leaf, "home": home, "key": own["key"].to_numpy()[row], "code": own["code"].to_numpy()[row], "wide": own["wide"].to_numpy()[row]})

    schema = "leaf long, home boolean, key long, code long, wide binary"
    if any(wanted[b] > leaves[b] for b in sizes):
        counts = points.mapInPandas(routed, schema).where("home").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each leaf
        for b, sample in samples.items():
            row, leaf, home = route(trees[b], sample, 0)
            own = {r: sample[row[home & (leaf == r)]] for r in np.unique(leaf).tolist()}
            levels |= {r["leaf"]: further_levels(r["leaf"], own[r["leaf"]], r["n"]) for r in counts if len(own.get(r["leaf"], ()))}

    def in_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "key"], ascending=[False, True])
        codes, key, n = pdf["code"].to_numpy().view(np.uint64), pdf["key"].to_numpy(), int(pdf["home"].sum())
        forest, agree = Forest(len(pdf)), None
        if wide_bits is not None:
            wide = np.frombuffer(b"".join(pdf["wide"]), np.uint64).reshape(len(pdf), -1)
            agree = lambda a, b: np.bitwise_count(wide[a] ^ wide[b]).sum(1) <= wide_bits
        search(codes, np.arange(n), np.arange(len(pdf)), radius, forest, agree)
        moved = np.flatnonzero(forest.root != np.arange(len(pdf)))
        return pd.DataFrame({"a": key[moved], "b": key[forest.root[moved]]})

    shards = points.mapInPandas(routed, schema)
    edges = shards.groupBy("leaf").applyInPandas(in_shard, "a long, b long")
    return materialize(edges.where("a <> b"), label)


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for each vertex of edges (a, b): label is the smallest vertex reachable.

    Each round takes the smallest label among neighbours, then jumps to the label's own label; every
    round's labels are written out, so lineage stays short and hot vertices can be split."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    start = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("label"), F.lit(None).cast("long").alias("old")), "labels")
    labels, last = start.select("v", "label"), start
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels.v == near.a).select("v", F.least("label", "near").alias("next"), "label")
        hooked = materialize(hooked, "labels")
        jump = hooked.select(F.col("v").alias("u"), F.col("next").alias("up"))
        moved = materialize(hooked.join(jump, hooked.next == jump.u).select("v", F.least("next", "up").alias("label"), F.col("label").alias("old")), "labels")
        forget(hooked, last)
        labels, last = moved.select("v", "label"), moved
        if moved.where("label <> old").isEmpty():
            forget(both)
            return labels
