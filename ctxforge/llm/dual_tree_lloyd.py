"""Lloyd's algorithm with two trees: a cover tree over the vectors of each block, and one over the centroids in each round.

A node of a cover tree has a centre, which is one of its points, and a radius; the centres of its children lie further apart than any
point lies from its own centre. A round walks pairs of a vector node and a centroid node. A pair is dropped if the bounds of
distance say that every vector of the node has a nearer centroid elsewhere; a node that is left with a single centroid goes to it as
a whole, and leaf vectors are compared with the centroids left to them in exact integers. Bounds have a margin for rounding, so
the rounds give what comparing all vectors with all centroids gives, ties to the smaller number included.

Blocks are cut from the rows as they lie, without a shuffle, and written once with their trees; equal vectors share a node of radius zero.
Tasks give sums of k centroids, however many blocks they read; centroids are k rows that go to the tasks by value (k: a parameter, some
thousands at most).

Edge cases: vectors that are null, of another length, or hold null or non-finite components take no part; components beyond +-2^27
after scaling count as that bound, so that squares stay exact; repeated rows count each for itself; a null id hashes as an empty one;
with fewer vectors than centroids there are fewer centroids; sums beyond a long are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import give_back, materialize, quoted

#: Vectors of a block, of a leaf, children of a node at most, and how much smaller a child's radius is to be.
BLOCK = 4096
LEAF = 16
FANOUT = 32
SHRINK = 2.0
#: Largest scaled component.
MOST = 1 << 27
MARGIN = 1e-9

_BLOCKS = "ids array<long>, points binary, centre binary, radius binary, rows binary, children binary"


def whole_vectors(frame: DataFrame, dimension: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): vectors of that dimension as floor(scale * x)."""
    v = F.col(quoted(vector_col)).cast("array<double>")
    good = (F.size(v) == dimension) & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * scale).cast("long"), F.lit(MOST)), F.lit(-MOST)).cast("int"))
    return frame.where(F.coalesce(good, F.lit(False))).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), whole.alias("v"))


class CoverTree:
    """Nodes in order of depth: centre (place of its point), radius, rows[i]:rows[i + 1] its range of the points as reordered, and its
    children, a range of later nodes that is empty for a leaf."""

    def __init__(self, points: np.ndarray, leaf: int):
        own = points.astype(np.float64)
        self.order = np.arange(len(points))
        centre, radius, rows, children = [], [], [], []
        level = [(0, len(points), 0)] if len(points) else []  # range, and the centre's place in it
        base = 0
        while level:
            after = []
            for lo, hi, c in level:
                members = self.order[lo:hi]
                distance = np.sqrt(((own[members] - own[members[c]]) ** 2).sum(1))
                centre.append(members[c])
                radius.append(float(distance.max()))
                rows.append((lo, hi))
                first = base + len(level) + len(after)
                if hi - lo <= leaf or not radius[-1]:
                    children.append((first, first))
                    continue
                owner, nearest, picked = np.zeros(hi - lo, np.int64), distance, [c]
                while len(picked) < FANOUT and nearest.max() > radius[-1] / SHRINK:
                    far = int(nearest.argmax())
                    d = np.sqrt(((own[members] - own[members[far]]) ** 2).sum(1))
                    owner[d < nearest] = len(picked)
                    nearest = np.minimum(nearest, d)
                    owner[far] = len(picked)
                    picked.append(far)
                by = np.argsort(owner, kind="stable")
                place = np.empty(hi - lo, np.int64)
                place[by] = np.arange(hi - lo)
                self.order[lo:hi] = members[by]
                ends = np.cumsum(np.bincount(owner, minlength=len(picked)))
                for n, p in enumerate(picked):
                    begin = int(ends[n - 1]) if n else 0
                    after.append((lo + begin, lo + int(ends[n]), int(place[p]) - begin))
                children.append((first, first + len(picked)))
            base, level = base + len(level), after
        self.radius = np.array(radius)
        self.rows = np.array(rows, np.int64).reshape(-1, 2)
        self.children = np.array(children, np.int64).reshape(-1, 2)
        place = np.empty(len(points), np.int64)
        place[self.order] = np.arange(len(points))
        self.centre = place[np.array(centre, np.int64)] if centre else np.zeros(0, np.int64)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    difference = a - b
    return np.einsum("ij,ij->i", difference, difference)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Block:
    """Vectors in the order of their tree."""

    def __init__(self, ids, points: np.ndarray, tree):
        self.ids, self.points, self.tree = ids, points, tree

    @classmethod
    def read(cls, row: dict) -> Block:
        tree = CoverTree.__new__(CoverTree)
        tree.centre, tree.radius = np.frombuffer(row["centre"], np.int64), np.frombuffer(row["radius"], np.float64)
        tree.rows, tree.children = (np.frombuffer(row[name], np.int64).reshape(-1, 2) for name in ("rows", "children"))
        return cls(row["ids"], np.frombuffer(row["points"], np.int32).reshape(len(row["ids"]), -1).astype(np.int64), tree)

    def nearest(self, centroids: np.ndarray, found: CoverTree) -> tuple[np.ndarray, int]:
        """Each vector's nearest centroid, and how many distances of a vector or node to a centroid were computed. found: the centroids' tree."""
        tree, points, seats = self.tree, self.points.astype(np.float64), centroids.astype(np.float64)
        label = np.full(len(points), -1, np.int64)
        x, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
        work, close = 0, []
        number = found.order  # of the centroid at a place of their tree
        while len(x):
            d = np.sqrt(_squares(points[tree.centre[x]], seats[number[found.centre[c]]]))
            work += len(d)
            most = np.full(len(tree.radius), np.inf)
            np.minimum.at(most, x, d + tree.radius[x])
            keep = d - tree.radius[x] - found.radius[c] <= most[x] * (1 + MARGIN) + MARGIN
            x, c = x[keep], c[keep]
            inner_x, inner_c = tree.children[x, 0] < tree.children[x, 1], found.children[c, 0] < found.children[c, 1]
            left, open_ = np.bincount(x, minlength=len(tree.radius)), np.bincount(x[inner_c], minlength=len(tree.radius))
            # A node with one centroid left is decided as a whole; a leaf with single centroids only is compared.
            alone = (left[x] == 1) & ~inner_c
            for node, seat in zip(x[alone].tolist(), c[alone].tolist()):
                label[tree.rows[node, 0] : tree.rows[node, 1]] = number[found.centre[seat]]
            ready = ~alone & ~inner_x & (open_[x] == 0)
            close.append((x[ready], c[ready]))
            x, c = x[~alone & ~ready], c[~alone & ~ready]
            for side, split in ((0, tree), (1, found)):
                node = (x, c)[side]
                n = split.children[node, 1] - split.children[node, 0]
                child = spread(np.where(n > 0, split.children[node, 0], node), np.maximum(n, 1))
                other = np.repeat((c, x)[side], np.maximum(n, 1))
                x, c = (child, other) if side == 0 else (other, child)
        x, c = (np.concatenate([p[i] for p in close]) if close else np.zeros(0, np.int64) for i in (0, 1))
        size = tree.rows[x, 1] - tree.rows[x, 0]
        row, seat = spread(tree.rows[x, 0], size), np.repeat(number[found.centre[c]], size)
        for at in range(0, len(row), 1 << 16):
            work += len(row[at : at + (1 << 16)])
        exact = np.concatenate([_squares(self.points[row[at : at + (1 << 16)]], centroids[seat[at : at + (1 << 16)]]) for at in range(0, len(row), 1 << 16)] or [np.zeros(0, np.int64)])
        order = np.lexsort((seat, exact, row))
        row, seat = row[order], seat[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        label[row[first]] = seat[first]
        return label, work


def block_trees(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors (vec_id, v) with their trees, written."""
    names = [f.split()[0] for f in _BLOCKS.split(", ")]

    def block(ids, points):
        tree = CoverTree(points, LEAF)
        columns = [pa.array([[ids[i] for i in tree.order.tolist()]], pa.list_(pa.int64()))]
        values = (points[tree.order], tree.centre, tree.radius, tree.rows, tree.children)
        return pa.record_batch(columns + [pa.array([v.tobytes()], pa.binary()) for v in values], names)

    def build(batches):
        ids, parts, size = [], [], 0
        for batch in batches:
            v = batch.column(1)
            ids += batch.column(0).to_pylist()
            parts.append(v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int32) if batch.num_rows else np.zeros((0, 0), np.int32))
            size += batch.num_rows
            while size >= BLOCK:
                points = np.concatenate([p for p in parts if len(p)])
                yield block(ids[:BLOCK], points[:BLOCK])
                ids, parts, size = ids[BLOCK:], [points[BLOCK:]], size - BLOCK
        if size:
            yield block(ids, np.concatenate([p for p in parts if len(p)]))
        give_back()

    return materialize(vectors.mapInArrow(build, _BLOCKS), "vector-trees")


def _sums(blocks: DataFrame, centroids: np.ndarray) -> dict[int, dict[int, int]]:
    """Per cluster, componentwise sums and, at -1, the number of its vectors. A task gives one row for each at most."""
    k, width = centroids.shape

    def scan(batches):
        found, sums, counts = CoverTree(centroids, 1), np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                label, _ = block.nearest(centroids, found)
                order = np.argsort(label, kind="stable")
                begin = np.flatnonzero(np.append(True, label[order][1:] != label[order][:-1]))
                sums[label[order][begin]] += np.add.reduceat(block.points[order], begin)
                counts += np.bincount(label, minlength=k)
        seen = np.flatnonzero(counts)
        cluster, place = np.repeat(seen, width + 1), np.tile(np.arange(-1, width), len(seen))
        yield pa.record_batch({"cluster": cluster, "place": place, "total": np.column_stack([counts, sums])[seen].ravel()})

    found: dict[int, dict[int, int]] = {}
    for cluster, place, total in blocks.mapInArrow(scan, "cluster long, place long, total long").groupBy("cluster", "place").agg(F.sum("total")).collect():
        found.setdefault(cluster, {})[place] = total
    return found


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids hash lowest, in that order."""
    name = F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(name.cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance), written, and the final centroids) of vectors (vec_id, v) after that many rounds."""
    centroids = seeds(vectors, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    blocks = block_trees(vectors)
    for _ in range(rounds):
        moved = centroids.copy()
        for own, sums in _sums(blocks, centroids).items():
            moved[own] = [sums[place] // sums[-1] for place in range(centroids.shape[1])]
        centroids = moved

    def assign(batches):
        found = CoverTree(centroids, 1)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block.read(row)
                label, _ = block.nearest(centroids, found)
                yield pa.record_batch({"vec_id": pa.array(block.ids, pa.int64()), "cluster": label.astype(np.int32), "distance": _squares(block.points, centroids[label])})

    return materialize(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"), "clusters"), centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """assigned with cluster_inertia, inertia and centroid_sha256, from one row for each cluster."""
    spark = assigned.sparkSession
    sums = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)"))).collect()}
    long = lambda n: n if n < 1 << 63 else None
    rows = [(c, long(n), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, n in sums.items()]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 64, 64)))


def _sql() -> str:
    """Three rounds written out; every vector is compared with every centroid."""
    parts = [
        "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v AS m FROM v QUALIFY c < 16)",
    ]
    for n in range(4):
        square = "list_sum(list_transform(list_zip(v, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
        parts.append(f"a{n} AS (SELECT vec_id, any_value(v) AS v, min(CAST({square} AS BIGINT) * 16 + c) AS best FROM v, c{n} GROUP BY vec_id)")
        if n < 3:
            parts.append(f"s{n} AS (SELECT c, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT best % 16 AS c, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM a{n}) GROUP BY c, place)")
            parts.append(f"c{n + 1} AS (SELECT c, coalesce(any_value(w), any_value(m)) AS m FROM (SELECT c, m, NULL AS w FROM c{n} UNION ALL SELECT c, NULL, list(x ORDER BY place) FROM s{n} GROUP BY c) GROUP BY c)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, CAST(best % 16 AS INT) AS cluster, best // 16 AS distance, CAST(sum(best // 16) OVER (PARTITION BY best % 16) AS BIGINT) AS cluster_inertia,
       CAST(sum(best // 16) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON best % 16 = c"""


OP11_SQL = _sql()
