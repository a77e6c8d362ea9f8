"""SimHash fingerprints, exact near pairs by vantage-point trees, one class per document; and resemblance of
shingle sets, found by least hashes and checked on the sets.

Edge cases: a null text counts as empty; a text without words has fingerprint zero and is linked like
any other; a text of fewer words than a shingle is one shingle; null ids never become a class id unless
a class has no other; repeated rows are repeated in the result; an empty table gives no rows; only the id
and text columns are read, whatever the others are called.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import all_columns, documents, forget, give_back, materialize, quoted, sent_if_small, small_batches
from ctxforge.llm.vptree import Forest, components, links
from ctxforge.operators.dedupe import met

#: Odd multipliers that derive further 64-bit hashes of a shingle from the first.
LANES = (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of k words of the text in ASCII lower case."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """One 64-bit word per lane; a bit is set if it is set in over half of the hashes."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        h = hashes
        if lane:
            h = (h ^ (h >> np.uint64(29))) * np.uint64(LANES[lane])
            h ^= h >> np.uint64(32)
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
        out[lane] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, fp long, wide binary): fp is the first lane, wide all of them."""
    small_batches(docs.sparkSession)

    def scan(batches):
        for batch in batches:
            prints = np.array([fingerprint(shingle_hashes(t, k), lanes) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, lanes)
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(prints[:, 0].view(np.int64)), "wide": pa.array([p.tobytes() for p in prints], pa.binary())})

    own = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    return own.mapInArrow(scan, "doc_id long, fp long, wide binary")


def classes(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """groups (key, rep) with component_id, the smallest rep that links lead to."""
    labels = materialize(components(edges), "labels")
    joined = materialize(labels.join(groups, labels.v == groups.key).select("v", "label", "rep"), "labels")
    least = materialize(joined.groupBy("label").agg(F.min("rep").alias("component_id")), "labels")
    linked = joined.join(least, "label").select(F.col("v").alias("key"), "component_id")
    found = groups.join(linked, "key", "left").select("key", F.coalesce("component_id", "rep").alias("component_id"))
    found = materialize(found, "classes")
    forget(labels, joined, least)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): documents whose fingerprints are linked at radius or fewer bits."""
    prints = materialize(fingerprints(docs, id_col, text_col, k).select("doc_id", "fp"), "simhash")
    groups = materialize(prints.groupBy(F.col("fp").alias("key")).agg(F.min("doc_id").alias("rep")), "simhash-groups")
    points = groups.select(F.lit(0).alias("band"), "key", F.col("key").alias("code"), F.lit(None).cast("binary").alias("wide"))
    found = classes(groups, links(points, radius))
    return prints.join(found, prints.fp == found.key).select("doc_id", "fp", "component_id")


#: Two sets resemble each other if they share this part, 4 / 5, of what either holds. Of HASHES least hashes a set has BANDS
#: bands of ROWS; a pair at 4 / 5 shares no band once in 20,000. Their lowest bits are a mark, their lowest four bits a sketch: a
#: pair at 4 / 5 differs in 13 bits and 24 places on average, in more than MARK_BITS or SKETCH_PLACES once in 50,000.
PART, BANDS, ROWS, HASHES, MARK_BITS, SKETCH_PLACES = (4, 5), 25, 5, 128, 28, 43
#: Pairs that a bucket may name for each of its sets; a bucket with more is compared as a whole.
PAIRS_PER_SET = 8
#: Sets of a bucket that one task holds against as many others; the pairs of a larger bucket's blocks are tasks of their own.
BLOCK_SETS = 2048
#: Texts, about, whose shingles are counted to tell frequent ones, and frequent shingles that are known at most. They order the words of
#: a set and leave nothing out: any order finds the same pairs, rare shingles first finds them sooner.
COUNTED, FREQUENT = 10_000, 1 << 19
#: A set's rarest shingles by which it is found: as many as two sets that resemble each other share this part of the smaller one of.
EXTRA = 12
#: Parts of the shingles' hashes that are looked through in turn, so that one part at a time is shuffled.
ROUNDS = 4
#: Bits of a set's parities. Two sets that resemble each other differ in a ninth of their sizes' sum at most, and so do their parities.
PARITY_BITS = 4096
_SKETCH = "doc_id long, mark long, key long, n int, low long, high long, sketch binary, bands array<long>, rare array<long>"


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of HASHES further hashes over a set's hashes; zeros for an empty set."""
    rng = np.random.default_rng(11)
    factors, terms = (rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    out = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF) if len(shingles) else np.uint64(0))
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[at : at + 4096] * factors + terms).min(1), out=out)
    return out


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col))
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("text"))


def frequent(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Shingles, in order, that several of about COUNTED different texts hold, and how many hold them."""
    small_batches(docs.sparkSession, 200)

    def scan(batches):
        for batch in batches:
            yield pa.record_batch({"code": pa.array(np.concatenate([np.zeros(0, np.uint64), *(np.unique(shingle_hashes(t, 5)) for t in batch.column(0).to_pylist())]).view(np.int64))})

    some = _rows(docs, id_col, text_col).where(F.pmod("mark", F.lit(max(1, docs.count() // COUNTED))) == 0).dropDuplicates(["mark"])
    counted = some.select("text").mapInArrow(scan, "code long").groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = counted.orderBy(F.desc("n"), "code").limit(FREQUENT).toArrow()
    codes = found["code"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    return codes[order], found["n"].to_numpy()[order]


def rare_first(shingles: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The rarest of a set's shingles: those not known as frequent in order of their hashes, then by how many texts hold them. Two sets that
    resemble each other have a part of 4 / 5 in common, so of the first n // 5 + s of either, s are shared, s being that of the smaller set."""
    codes, counts = often
    keep = len(shingles) // PART[1] + max(1, len(shingles) // EXTRA)
    if not len(codes) or not len(shingles):
        return shingles[:keep]
    at = np.minimum(np.searchsorted(codes, shingles), len(codes) - 1)
    rank = np.where(codes[at] == shingles, counts[at], 0)
    return shingles[np.argsort(rank, kind="stable")[:keep]]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's mark (a hash of its text) and, of its set of five-word shingles, key (a digest), size n, lowest bits and
    places of its least hashes, band codes and rarest shingles. The sets themselves are not kept."""
    small_batches(docs.sparkSession, 200)
    often = docs.sparkSession.sparkContext.broadcast(frequent(docs, id_col, text_col))

    def scan(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, 5)) for t in batch.column(2).to_pylist()]
            least = np.array([least_hashes(s) for s in sets], np.uint64).reshape(-1, HASHES)
            nibbles = (least >> np.uint64(32)).astype(np.uint8) & np.uint8(15)
            bits = np.packbits(nibbles & np.uint8(1), axis=1).view(np.int64)
            codes = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(LANES[1]), (len(sets), 1))
            for r in range(ROWS):
                codes = (codes ^ least[:, r * BANDS : (r + 1) * BANDS]) * np.uint64(LANES[2])
                codes ^= codes >> np.uint64(29)
            keys = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch({
                "doc_id": batch.column(0), "mark": batch.column(1), "key": pa.array(keys), "n": pa.array(np.array([len(s) for s in sets], np.int32)), "low": pa.array(bits[:, 0]), "high": pa.array(bits[:, 1]),
                "sketch": pa.array([(x[0::2] << 4 | x[1::2]).tobytes() for x in nibbles], pa.binary()), "bands": pa.array(codes.view(np.int64).tolist(), pa.list_(pa.int64())),
                "rare": pa.array([rare_first(s, often.value).view(np.int64) for s in sets], pa.list_(pa.int64())),
            })
        give_back()

    return _rows(docs, id_col, text_col).mapInArrow(scan, _SKETCH)


def _may_resemble(a: str, b: str):
    """Sizes allow a resemblance of PART and the marks do not speak against it."""
    fit = (F.col(f"{a}.n") * PART[1] >= F.col(f"{b}.n") * PART[0]) & (F.col(f"{b}.n") * PART[1] >= F.col(f"{a}.n") * PART[0])
    apart = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in ("low", "high")), F.lit(0))
    return fit & (apart <= MARK_BITS)


def places_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many places two sketches, rows of 64 bytes, differ."""
    differ = x ^ y
    return ((differ & 15) > 0).sum(-1) + (differ > 15).sum(-1)


def near_sketches(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches that do not speak against a resemblance; they do for a few pairs that have one."""
    return places_apart(x, y) <= SKETCH_PLACES


def parities(shingles: np.ndarray) -> bytes:
    """A bit for each remainder of hashes: whether an odd number of the set's have it."""
    odd = np.bincount((shingles >> np.uint64(32)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def near_parities(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Parities that allow a resemblance, sizes being the sums of the sets' sizes. They differ in a bit only where the sets differ, so no
    pair that has a resemblance of PART is ruled out."""
    return (PART[0] + PART[1]) * np.bitwise_count(x ^ y).sum(-1, dtype=np.int64) <= (PART[1] - PART[0]) * sizes


class Sets:
    """Shingle sets of keys, made from the text of one document of each."""

    def __init__(self, docs: DataFrame, groups: DataFrame, id_col: str, text_col: str):
        self.rows, self.groups = _rows(docs, id_col, text_col), groups

    def of(self, keys: DataFrame) -> DataFrame:
        def scan(batches):
            for batch in batches:
                sets = [np.unique(shingle_hashes(t, 5)).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.record_batch({"key": batch.column(0), "shingles": pa.array(sets, pa.binary())})

        wanted = materialize(keys.join(self.groups.select("key", "rep"), "key").select("key", F.col("rep.doc_id").alias("_i"), F.col("rep.mark").alias("_m")), "wanted")
        found = self.rows.join(sent_if_small(wanted, 64), F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("mark") == F.col("_m")))
        # A row may be repeated.
        made = materialize(found.select("key", "text").mapInArrow(scan, "key long, shingles binary").dropDuplicates(["key"]), "shingles")
        forget(wanted)
        return made


def verified(pairs: DataFrame, sets: Sets, marked: DataFrame, near_by=near_sketches) -> DataFrame:
    """The pairs (a, b) of keys whose shingle sets resemble each other: by their sketches (marked: key, n, sketch), then by the sets
    themselves."""

    def alike(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(near_by(x, y, batch.column(4).to_numpy())))

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(PART[1] * both >= PART[0] * (len(x) + len(y) - both))
            yield pa.record_batch({"a": batch.column(0), "b": batch.column(1)}).filter(pa.array(good, pa.bool_()))

    left, right = (marked.select(F.col("key").alias(k), F.col("sketch").alias(f"s{k}"), F.col("n").cast("long").alias(f"n{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb", (F.col("na") + F.col("nb")).alias("n"))
    near = materialize(both.mapInArrow(alike, "a long, b long"), "alike")
    own = sets.of(near.select(F.col("a").alias("key")).union(near.select("b")).distinct())
    left, right = (own.select(F.col("key").alias(k), F.col("shingles").alias(f"s{k}")) for k in "ab")
    joined = near.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
    found = materialize(joined.mapInArrow(check, "a long, b long"), "verified")
    forget(near, own)
    return found


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (code, key, many, ...) once for each pair of blocks, low and high, of their bucket that holds the row's own block."""
    blocks = F.ceil(F.col("many") / BLOCK_SETS)
    own = rows.withColumn("block", F.pmod(F.xxhash64("key", "code"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int")))
    return own.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("many", "other")


def _named(pdf: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b) of different components, within a block or between two, whose sizes and sketches allow a resemblance; if
    they are more than PAIRS_PER_SET times the sets, (code, null), for a comparison of the sets themselves."""
    key, size, label, block = pdf["key"].to_numpy(), pdf["n"].to_numpy(np.int64), pdf["label"].to_numpy(), pdf["block"].to_numpy()
    where, crossing = {"low": pdf["low"].iloc[0], "high": pdf["high"].iloc[0]}, pdf["low"].iloc[0] != pdf["high"].iloc[0]
    sketch = np.frombuffer(b"".join(pdf["sketch"]), np.uint8).reshape(len(pdf), -1)
    a, b, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    for r in range(len(pdf) - 1):
        able = (label[r + 1 :] != label[r]) & (PART[1] * size[r + 1 :] >= PART[0] * size[r]) & (PART[1] * size[r] >= PART[0] * size[r + 1 :])
        if crossing:
            able &= block[r + 1 :] != block[r]
        rest = r + 1 + np.flatnonzero(able)
        rest = rest[places_apart(sketch[rest], sketch[r]) <= SKETCH_PLACES]
        many += len(rest)
        if many > PAIRS_PER_SET * len(pdf):
            return pd.DataFrame({"a": pd.array([pdf["code"].iloc[0]], "Int64"), "b": pd.array([None], "Int64"), **where})
        a.append(np.minimum(key[rest], key[r]))
        b.append(np.maximum(key[rest], key[r]))
    return pd.DataFrame({"a": pd.array(np.concatenate(a), "Int64"), "b": pd.array(np.concatenate(b), "Int64"), **where})


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    """(a, b) that join components (label) within a block or between two where sets resemble each other; all pairs of different
    components are counted through the sets' inverted lists, and one link for two components is given."""
    pdf = pdf.sort_values("key")
    block, crossing = pdf["block"].to_numpy(), pdf["low"].iloc[0] != pdf["high"].iloc[0]
    key, label = pdf["key"].to_numpy(), np.unique(pdf["label"], return_inverse=True)[1]
    sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    each, place = np.unique(np.concatenate(sets), return_inverse=True)
    lists = np.repeat(np.arange(len(sets)), sizes)[np.argsort(place, kind="stable")]
    length = np.bincount(place, minlength=len(each))
    start, first = np.cumsum(length) - length, np.cumsum(sizes) - sizes
    forest, a, b = Forest(int(label.max()) + 1), [], []
    for r in range(len(sets)):
        if (forest.root == forest.root[0]).all():
            break
        own = place[first[r] : first[r] + sizes[r]]
        many = length[own]
        both = np.bincount(lists[np.repeat(start[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())], minlength=len(sets))
        alike = PART[1] * both >= PART[0] * (sizes[r] + sizes - both)
        if crossing:
            alike &= block != block[r]
        for q in np.flatnonzero(alike & (forest.root[label] != forest.root[label[r]])).tolist():
            if forest.root[label[q]] != forest.root[label[r]]:
                forest.link(label[[r]], label[[q]])
                a.append(key[r])
                b.append(key[q])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def resembling(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) for a resemblance of 0.8 or more between sets of five-word shingles."""
    prints = materialize(sketches(docs, id_col, text_col), "sketches")
    return prints.select("doc_id", "key").join(classes_of(prints, docs, id_col, text_col), "key").select("doc_id", F.col("component_id.doc_id").alias("component_id"))


def _place():
    """Order of documents in sketches(): those without an id come last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("mark"))


def _left_out(prints: DataFrame, linked: DataFrame, sets: Sets) -> DataFrame:
    """Links (a, b) between components of linked (v, label) that no band or no sketch led to, by what all pairs that resemble each other
    have: shared shingles among the rarest of both (rare_first), and enough of them. A set with fewer in other components has no link."""
    rows = prints.select("key", "n", "rare").join(sent_if_small(linked, 16), F.col("key") == F.col("v"), "left")
    rows = rows.select("key", "n", F.coalesce("label", "key").alias("label"), "rare")
    across = lambda p: p.groupBy("code").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("code")
    found = []
    for r in range(ROUNDS):
        points = rows.select("key", "n", "label", F.explode(F.filter("rare", lambda x: F.pmod(x, F.lit(ROUNDS)) == r)).alias("code"))  # noqa: B023
        shared = materialize(across(points), "shared")
        found.append(materialize(points.join(sent_if_small(shared, 16), "code").dropDuplicates(["key", "code"]), "hits"))
        forget(shared)
    hits = materialize(reduce(DataFrame.union, found), "hits")
    forget(*found)
    # A partner has 4 / 5 of the set's size at least. Sets that go take shingles with them, and others then have too few.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PART[0] / PART[1]) / EXTRA))
    for _ in range(2):
        able = hits.groupBy("key").agg(F.count(F.lit(1)).alias("found"), F.first("n").alias("n")).where(F.col("found") >= least).select("key")
        able = materialize(hits.join(able, "key", "left_semi"), "able")
        fewer = materialize(able.join(across(able), "code", "left_semi"), "hits")
        forget(hits, able)
        hits = fewer
    rows = hits.groupBy(F.col("key").alias("ord")).agg(F.first("n").cast("long").alias("n"), F.collect_list("code").alias("prefix"), F.first("label").alias("best"))
    rows = materialize(rows, "asked")
    forget(hits)
    pairs = met(rows, PART[0] / PART[1], lambda a, label_a, b, label_b: label_a != label_b, (1, EXTRA))

    def scan(batches):
        for batch in batches:
            yield pa.record_batch({"key": batch.column(0), "sketch": pa.array([parities(np.frombuffer(x, np.uint64)) for x in batch.column(1).to_pylist()], pa.binary())})

    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(rows.select(F.col("ord").alias("key"), "n"), "key")
    own = sets.of(keys.select("key"))
    marked = materialize(own.select("key", "shingles").mapInArrow(scan, "key long, sketch binary").join(keys, "key"), "parities")
    forget(own)
    found = verified(pairs, sets, marked, near_parities)
    forget(rows, marked)
    return found


def classes_of(prints: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, component_id) for each set of sketches(docs); component_id is the place of the class's first document.

    Sets that share a band of least hashes are candidates, and each link is checked on the sets. First each set of a
    bucket is held against one of the bucket. Buckets that still hold more than one component then name their
    pairs of different components, and these are checked; one with too many gets its sets, and all its pairs of different
    components are compared in the task, which gives a spanning forest. Large buckets are compared by pairs of blocks.

    Bands and sketches miss a few pairs; those between different components are found by the sets' rarest shingles, which all pairs share."""
    rest = F.first(F.struct("n", "low", "high", "sketch", "bands")).alias("s")
    groups = materialize(prints.groupBy("key").agg(F.min(_place()).alias("rep"), rest).select("key", "rep", "s.*"), "sketch-groups")
    sets = Sets(docs, groups, id_col, text_col)
    points = groups.select(F.struct("key", "n", "low", "high").alias("p"), F.explode("bands").alias("code"))
    hubs = materialize(points.groupBy("code").agg(F.min(F.struct(F.xxhash64("p.key", "code").alias("turn"), "p")).alias("m"), F.count(F.lit(1)).alias("many")).where("many > 1").select("code", F.col("m.p").alias("hub")), "hubs")
    found = points.join(hubs, "code").where((F.col("p.key") != F.col("hub.key")) & _may_resemble("p", "hub"))
    ends = F.least("p.key", "hub.key").alias("a"), F.greatest("p.key", "hub.key").alias("b")
    tried = materialize(found.select(*ends).distinct(), "tried")
    first = verified(tried, sets, groups)

    marked = groups.join(components(first).withColumnRenamed("v", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    marked = materialize(marked.select("key", "label", "n", "low", "high", "sketch", "bands"), "marked")
    points = marked.select(F.struct("key", "n", "low", "high").alias("p"), "label", F.explode("bands").alias("code"))
    ranges = points.groupBy("code").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("many"))
    mixed = materialize(ranges.where("least <> most").select("code", "many"), "mixed")
    mixed_points = materialize(points.join(mixed, "code").select("code", "p", "label", "many"), "mixed-points")
    # A bucket of so few sets has no more pairs than it may name.
    small = mixed_points.where(F.col("many") <= 2 * PAIRS_PER_SET)
    other = small.select("code", F.col("p").alias("q"), F.col("label").alias("other"))
    pairs = small.join(other, "code").where((F.col("p.key") < F.col("q.key")) & (F.col("label") != F.col("other")) & _may_resemble("p", "q"))
    own = _dealt(mixed_points.where(F.col("many") > 2 * PAIRS_PER_SET).select("code", "p.key", "label", "many"))
    large = own.join(marked.select("key", "n", "sketch"), "key").groupBy("code", "low", "high").applyInPandas(_named, "a long, b long, low int, high int")
    none = F.lit(None).cast("int")
    named = materialize(pairs.select(F.col("p.key").alias("a"), F.col("q.key").alias("b"), none.alias("low"), none.alias("high")).distinct().union(large), "named")
    second = verified(named.where("b IS NOT NULL").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), sets, groups)
    crowded = named.where("b IS NULL").select(F.col("a").alias("code"), "low", "high")
    dense = own.join(crowded, ["code", "low", "high"], "left_semi")
    with_sets = dense.join(sets.of(dense.select("key").distinct()), "key")
    more = materialize(with_sets.select("code", "low", "high", "block", "key", "label", "shingles").groupBy("code", "low", "high").applyInPandas(_linked, "a long, b long"), "more")
    forget(hubs, tried, marked, mixed, mixed_points, named)
    edges = first.union(second).union(more)
    edges = edges.union(_left_out(prints, components(edges), sets))
    out = classes(groups.select("key", "rep"), edges)
    forget(groups, first, second, more)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that resemble one of smaller id, directly or over others.

    A document is an id and a text: of a group the one of smallest id, then of smallest text hash, stays, once if its
    row is repeated; different texts under one id are different documents. Rows without an id cannot be told
    apart and stay. Columns may have any names."""
    none = F.col(quoted(id_col)).isNull()
    keyed = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col(quoted(id_col)).cast("long").alias("_id"), F.xxhash64(F.col(quoted(text_col))).alias("_mark"))
    prints = materialize(sketches(docs.where(~none), id_col, text_col), "sketches")
    rows = prints.groupBy("key", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).join(classes_of(prints, docs.where(~none), id_col, text_col), "key")
    judged = rows.select("doc_id", "mark", "n", (_place() == F.col("component_id")).alias("stays"))
    # Rows to drop, and rows that stay once though they are repeated.
    odd = materialize(judged.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_i"), F.col("mark").alias("_m"), F.col("stays").alias("_once")), "near-odd")
    forget(prints)
    both = keyed.join(sent_if_small(odd, 64), (F.col("_id") == F.col("_i")) & (F.col("_mark") == F.col("_m")), "left")
    kept = both.where(F.col("_once").isNull())
    if not odd.where("_once").isEmpty():
        kept = kept.union(both.where("_once").dropDuplicates(["_id", "_mark"]))
    return kept.select(*(F.col(f"_row.{quoted(c)}").alias(c) for c in docs.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
