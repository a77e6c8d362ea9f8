"""Approximate nearest neighbours by a permutation index.

Up to 512 pivots order every vector; it is represented by its 64 nearest pivots in order and posted, with their places,
in these pivots' inverted files. A query is ordered the same way and reads the files of its own pivots only: a
vector that shares pivots with it collects, for each, how far below the end of both lists the later place is, which is half
the footrule distance of two such lists taken from its largest value. The nearest share of the vectors are
candidates, and their inner products on the original vectors decide.

The share is fitted: on a sample of at most SAMPLE vectors it is what holds the true nearest of sampled queries nineteen
times in twenty, so that data in which pivots say little (uniform, many dimensions) get more candidates and clustered data
few. Only the sample, the pivots among it, reaches the driver.

The largest inner product becomes a nearest direction by one more coordinate that fills every vector up
to the largest norm (queries get none), which changes nothing for unit vectors.

Vectors and queries are dealt by hash into blocks whose number depends on their counts alone; each pair of blocks is one
group of a join, so no task holds more than two blocks and nothing is broadcast or collected. Where there are many
blocks, a sixteenth of them is searched first, and the others give only what is as near as a query's results so far, so
what is found grows with the queries and not with the pairs of blocks. Equal vectors of a block
are one entry with all their ids, so copies do not crowd others out and their ties are exact.

Edge cases: vectors that are null, zero, hold null or non-finite components, or have another dimension than
most pivots, take no part; repeated rows count once; a query never finds its own row's id; fewer candidates than asked
give fewer rows; empty tables give no rows; null ids take no part; only the id and vector columns are read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctxforge.llm.common import materialize, quoted

#: Pivots, and how many of them represent a vector.
PIVOTS, PREFIX = 512, 64
#: Vectors on which pivots and share are fitted, queries among them, their nearest that must be found, and how often.
SAMPLE, TRIED, NEAREST, FOUND = 4096, 128, 5, 0.95
#: Least candidates of a block.
LEAST = 128
#: Bytes and least rows of a block, the number of blocks that smaller tables are dealt into, and one in how many goes ahead.
BLOCK_BYTES, BLOCK_ROWS, BLOCKS, AHEAD = 32 << 20, 512, 12, 16


def clean_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec): the rows that take part."""
    found = table.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.col(quoted(vector_col)).cast("array<double>").alias("vec"))
    odd = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & ~odd & F.exists("vec", lambda x: x != 0))


class Pivots:
    """Pivot directions of unit length, and the norm that vectors are filled up to."""

    def __init__(self, sample: np.ndarray, norm: float, count: int = PIVOTS, prefix: int = PREFIX):
        self.norm = norm
        _, first = np.unique(sample, axis=0, return_index=True)
        wide = self.filled(sample[np.sort(first)[:count]])
        self.directions = wide / np.linalg.norm(wide, axis=1, keepdims=True)
        self.prefix = min(prefix, len(wide))

    def filled(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([v, np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))])

    def _order(self, wide: np.ndarray) -> np.ndarray:
        out = np.empty((len(wide), self.prefix), np.int16)
        for at in range(0, len(wide), 4096):
            near = -np.round(wide[at : at + 4096] @ self.directions.T, 12)
            out[at : at + 4096] = np.argsort(near, axis=1, kind="stable")[:, : self.prefix]
        return out

    def order(self, v: np.ndarray) -> np.ndarray:
        """Each vector's nearest pivots, the nearest first."""
        return self._order(self.filled(v))

    def query_order(self, q: np.ndarray) -> np.ndarray:
        return self._order(np.column_stack([q, np.zeros(len(q))]))


class InvertedFiles:
    """For each pivot the vectors that have it in their order, and how far above the order's end it stands there."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.m = order.shape
        by = np.argsort(order.ravel(), kind="stable")
        self.start = np.searchsorted(order.ravel()[by], np.arange(pivots + 1)).tolist()
        self.row = (by // self.m).astype(np.int32)
        self.above = (self.m - by % self.m).astype(np.float64)

    def closeness(self, own: list[int]) -> np.ndarray:
        """m (m + 1) / 2 less half the footrule distance between the query's order and that of each vector."""
        ranges = [(self.start[p], self.start[p + 1]) for p in own]
        rows = np.concatenate([self.row[a:b] for a, b in ranges])
        shared = np.concatenate([np.minimum(self.above[a:b], self.m - k) for k, (a, b) in enumerate(ranges)])
        return np.bincount(rows, shared, minlength=self.n)


def fit(vectors: DataFrame) -> tuple[Pivots, float] | None:
    """Pivots, and the share of vectors to take as candidates, from the vectors of smallest hashed id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").select("vec").limit(SAMPLE).collect()
    if not rows:
        return None
    dimension = Counter(len(r["vec"]) for r in rows).most_common(1)[0][0]
    norm = vectors.where(F.size("vec") == dimension).agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    sample = np.array([r["vec"] for r in rows if len(r["vec"]) == dimension])
    pivots = Pivots(sample, float(np.sqrt(norm)))
    return pivots, fitted_share(sample, pivots)


def fitted_share(sample: np.ndarray, pivots: Pivots) -> float:
    """The share of a sample, by closeness to a query, that holds its nearest FOUND of the time."""
    files, places = InvertedFiles(pivots.order(sample), len(pivots.directions)), []
    # The last ones, since the first are pivots.
    for own, q in zip(pivots.query_order(sample[-TRIED:]).tolist(), range(max(0, len(sample) - TRIED), len(sample))):
        place = np.empty(len(sample))
        place[np.argsort(-files.closeness(own), kind="stable")] = np.arange(len(sample))
        score = sample @ sample[q]
        score[q] = -np.inf
        places.append(place[np.argsort(-score, kind="stable")[:NEAREST]])
    return float(np.quantile(np.concatenate(places), FOUND) + 1) / len(sample)


def nearest_in_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: Pivots, k: int, share: float):
    """(query, id, score) of up to k nearest found in a block for each query."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], vectors[order]
    _, first, entry = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    by_id = np.argsort(first, kind="stable")  # entries in the order of their smallest ids
    renamed = np.empty_like(by_id)
    renamed[by_id] = np.arange(len(by_id))
    distinct, entry = vectors[first[by_id]], renamed[entry.ravel()]
    by_entry = np.argsort(entry, kind="stable")  # ids ascending within an entry
    bounds = np.searchsorted(entry[by_entry], np.arange(len(distinct) + 1))
    files = InvertedFiles(pivots.order(distinct), len(pivots.directions))
    n = len(distinct)
    take = min(n, max(LEAST, k + 1, math.ceil(n * share)))
    tie, out = np.arange(n), []
    for q, vector, own in zip(query_ids.tolist(), queries, pivots.query_order(queries).tolist()):
        near = np.argpartition(tie - files.closeness(own) * n, take - 1)[:take] if take < n else tie
        score = distinct[near] @ vector
        keep = np.argpartition(-score, k)[: k + 1] if len(near) > k + 1 else np.arange(len(near))
        keep = np.flatnonzero(score >= score[keep].min())
        found = [(ids[by_entry[bounds[e] : min(bounds[e] + k + 1, bounds[e + 1])]], s) for e, s in zip(near[keep].tolist(), score[keep].tolist())]
        members, scores = np.concatenate([m for m, _ in found]), np.repeat([s for _, s in found], [len(m) for m, _ in found])
        other = members != q
        members, scores = members[other], scores[other]
        best = np.lexsort((members, -scores))[:k]
        out.append((np.full(len(best), q, np.int64), members[best], scores[best]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def blocks_of(rows: int, dimension: int, least: int = 1) -> int:
    """Number of blocks: of a bounded size, and as many as `least` where they keep BLOCK_ROWS rows."""
    return max(1, math.ceil(rows * dimension * 8 / BLOCK_BYTES), min(least, rows // BLOCK_ROWS))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): vectors and queries are clean_vectors() tables."""
    spark = vectors.sparkSession
    found = fit(vectors)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots, fitted = found
    part = fitted if share is None else share
    dimension = pivots.directions.shape[1] - 1
    vectors, queries = (t.where(F.size("vec") == dimension).dropDuplicates() for t in (vectors, queries))
    n_blocks, q_blocks = blocks_of(vectors.count(), dimension, BLOCKS), blocks_of(queries.count(), dimension)
    number = lambda n: F.pmod(F.xxhash64("vec_id", "vec"), F.lit(n)).cast("int")
    vectors, queries = vectors.withColumn("block", number(n_blocks)), queries.withColumn("turn", number(q_blocks))

    def search(block: pa.Table, turn: pa.Table) -> pa.Table:
        if not len(block) or not len(turn):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, own), (query_ids, asked) = ((t["vec_id"].to_numpy(), t["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dimension)) for t in (block, turn))
        q, i, s = nearest_in_block(ids, own, query_ids, asked, pivots, k, part)
        order = np.argsort(query_ids)
        least = turn["least"].to_numpy()[order][np.searchsorted(query_ids[order], q)]
        return pa.table({"query_id": q, "vec_id": i, "score": s}).filter(pa.array(s >= least))

    def searched(first: int, last: int, asked: DataFrame, label: str) -> DataFrame:
        left = vectors.where(F.col("block").between(first, last)).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        right = asked.withColumn("block", F.explode(F.sequence(F.lit(first), F.lit(last))))
        pairs = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn"))
        return materialize(pairs.applyInArrow(search, "query_id long, vec_id long, score double"), label)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda t: t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    # Of many blocks, some go first; what a query found there is the least that the others need to give it.
    ahead = n_blocks if n_blocks <= BLOCKS else math.ceil(n_blocks / AHEAD)
    near = searched(0, ahead - 1, queries.withColumn("least", F.lit(float("-inf"))), "neighbours")
    if ahead < n_blocks:
        least = ranked(near).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("least"))
        asked = materialize(queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), "asked")
        near = near.union(searched(ahead, n_blocks - 1, asked, "neighbours"))
    return ranked(near).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = clean_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
