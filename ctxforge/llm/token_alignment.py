"""Alignment of two tokenizers over the same bytes, with corpus-wide counts of linked id pairs.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Byte offsets where tokens of both end cut it into
groups; the two tokens that end at such an offset are linked. A pair of ids is one int64 key, B's id in the upper half.
np.unique counts a chunk's keys, and a task sums those of its chunks, before anything is shuffled; partial counts are sorted by ranges of
keys, equal neighbours summed, and written as sorted shards. A chunk asks the shards for its distinct keys: keys and counts of a shard
are arrays over the Arrow buffer that Spark hands to the worker, mapped without a copy and read by searchsorted (a memory map
of a file would need a store that workers can open by path). Answers go back to the chunk, whose links point at its distinct keys.

Shards are bounded by the product of the vocabularies, requests of a shard are dealt over as many groups as their size needs, and the
table of highest counts has a row for each of B's ids. Texts are encoded once; chunks are written with their links.

Edge cases: texts null or empty, or not given back byte by byte by both vocabularies, have no tokens: zeros and an empty column; strings of
special tokens are plain text; ids may be null or repeated and are passed on; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.bpe import FragmentCoder, on_worker
from ctxforge.llm.common import documents, forget, give_back, materialize, per_worker, quoted, shuffle_partitions, small_batches

#: Bytes of text in a chunk, keys in a shard, and keys of requests that a group of the lookup takes.
CHUNK = 4 << 20
SHARD = 1 << 20
ASKED = 8 << 20

_CHUNKS = "ids array<long>, n_a array<long>, n_b array<long>, n_links array<long>, groups array<string>, links binary, keys binary, counts binary, n_keys long"


class Pair:
    """Both vocabularies: ids, bytes of the tokens, and how ids are written in a group."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.coder = FragmentCoder(on_worker(a))
        self.coder.special = {}  # special tokens' strings are plain text
        self.coder.library.encode_special_tokens = True
        self.piece = sentencepiece.SentencePieceProcessor(model_file=on_worker(b))
        p = self.piece
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.b = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.a = self.coder.pieces
        self.sizes = [np.array([len(x) for x in tokens], np.int64) for tokens in (self.a, self.b)]
        # An id and what follows it: A within a group, A at its end, B within a group, B at its end.
        self.written = [b"%d%s" % (i, mark) for n, marks in ((len(self.a), b",|"), (len(self.b), b",;")) for mark in (marks[:1], marks[1:]) for i in range(n)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text under A and B; none where the bytes of either are not those of the text behind a space."""
        a = [np.frombuffer(x, "<u4").astype(np.int64) for x in self.coder.encode_all([b" " + t.encode() if t else b"" for t in texts])]
        b = [np.array(x, np.int64) for x in self.piece.encode(texts, num_threads=1)] if texts else []
        for k, text in enumerate(texts):
            own = (b" " + text.encode()) if text else None
            if b"".join(map(self.a.__getitem__, a[k].tolist())) != own or b"".join(map(self.b.__getitem__, b[k].tolist())) != own:
                a[k] = b[k] = np.zeros(0, np.int64)
        return a, b

    def align(self, texts: list[str]):
        """(n_a, n_b, n_links, groups' digests, keys of all links in order), the first four by text. Every common end closes one group with one link."""
        a, b = self.encode(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (a, b))
        a, b = (np.concatenate(ids) if ids else np.zeros(0, np.int64) for ids in (a, b))
        # Both sides cover the same bytes, so ends within the joined texts can be compared.
        ends = [np.cumsum(size[ids]) for size, ids in zip(self.sizes, (a, b))]
        total = int(ends[0][-1]) if len(a) else 0
        marks = [np.zeros(total + 1, bool) for _ in ends]
        for mark, end in zip(marks, ends):
            mark[end] = True
        shared = [marks[1][ends[0]], marks[0][ends[1]]]
        group = [np.cumsum(s) - s for s in shared]
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        codes = np.concatenate([a + shared[0] * len(self.a), 2 * len(self.a) + b + shared[1] * len(self.b)])[order].tolist()
        digests, at = [], 0
        for n in (n_a + n_b).tolist():
            text = b"".join(map(self.written.__getitem__, codes[at : at + n]))[:-1]
            digests.append(hashlib.sha256(text).hexdigest() if n else "")
            at += n
        closed = np.append(0, np.cumsum(shared[0]))
        last = np.append(0, np.cumsum(n_a))
        return n_a, n_b, np.diff(closed[last]), digests, (b[shared[1]] << 32) | a[shared[0]]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), "zstd", asbytes=True)


def _unpacked(x, n: int, kind) -> np.ndarray:
    return np.frombuffer(pa.decompress(x, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys with equal neighbours summed."""
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(counts, begin) if len(keys) else counts


def aligned_chunks(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Chunks of documents (written): counts by document, digests of groups, links as places in the chunk's distinct keys."""
    small_batches(docs.sparkSession)

    def chunk(ids, texts, pair):
        n_a, n_b, n_links, digests, links = pair.align(texts)
        keys, place, counts = np.unique(links, return_inverse=True, return_counts=True)
        values = (ids, n_a.tolist(), n_b.tolist(), n_links.tolist(), digests, _packed(place.astype(np.int32)), _packed(keys), _packed(counts.astype(np.int64)), len(keys))
        kinds = (*[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds)], [f.split()[0] for f in _CHUNKS.split(", ")])

    def scan(batches):
        pair = per_worker(("alignment", a, b), lambda: Pair(a, b))
        ids, texts, size = [], [], 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(id_)
                texts.append(text or "")
                size += len(texts[-1])
                if size >= CHUNK:
                    yield chunk(ids, texts, pair)
                    ids, texts, size = [], [], 0
        if ids:
            yield chunk(ids, texts, pair)
        give_back()

    own = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return materialize(own.mapInArrow(scan, _CHUNKS).withColumn("chunk", F.monotonically_increasing_id()), "aligned-chunks")


def count_shards(chunks: DataFrame) -> DataFrame:
    """(shard, lo, keys, counts, n) of all pairs, sorted (written): shard n holds the keys from lo up to the next shard's."""
    spark = chunks.sparkSession

    def partial(batches):
        held = [(_unpacked(r["keys"], r["n_keys"], np.int64), _unpacked(r["counts"], r["n_keys"], np.int64)) for batch in batches for r in batch.to_pylist()]
        if held:
            keys, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(keys, kind="stable")
            keys, counts = _summed(keys[order], counts[order])
            for at in range(0, len(keys), 1 << 16):
                yield pa.record_batch({"key": keys[at : at + (1 << 16)], "n": counts[at : at + (1 << 16)]})

    def shard(keys, counts):
        return pa.record_batch({"lo": keys[:1], "keys": pa.array([keys.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    def run_lengths(batches):
        held, size = [], 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy() for i in (0, 1)))
            size += batch.num_rows
            if size >= SHARD:
                keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
                if len(keys) > 1:  # the last key may go on
                    yield shard(keys[:-1], counts[:-1])
                held, size = [(keys[-1:], counts[-1:])], 1
        if held:
            keys, counts = _summed(*(np.concatenate(x) for x in zip(*held)))
            if len(keys):
                yield shard(keys, counts)

    rows = chunks.select("keys", "counts", "n_keys").mapInArrow(partial, "key long, n long")
    dealt = rows.repartitionByRange(shuffle_partitions(spark), "key").sortWithinPartitions("key")
    return materialize(dealt.mapInArrow(run_lengths, "lo long, keys binary, counts binary, n long"), "count-shards")


def highest_counts(shards: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """B's ids and the highest count of a pair with each: at most one row for each entry of its vocabulary."""

    def highest(batches):
        for batch in batches:
            for r in batch.to_pylist():
                b = np.frombuffer(r["keys"], np.int64) >> 32
                begin = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                yield pa.record_batch({"b": b[begin], "most": np.maximum.reduceat(np.frombuffer(r["counts"], np.int64), begin)})

    found = shards.select("keys", "counts").mapInArrow(highest, "b long, most long").groupBy("b").agg(F.max("most").alias("most")).toArrow().sort_by("b")
    return found["b"].to_numpy(), found["most"].to_numpy()


def looked_up(chunks: DataFrame, shards: DataFrame) -> DataFrame:
    """(chunk, found): per chunk the (shard, counts, best) of its distinct keys, in their order; best: whether a count is its B id's highest."""
    lows = np.array(sorted(r[0] for r in shards.select("lo").collect()), np.int64)
    b_ids, most = highest_counts(shards)
    asked = chunks.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0]
    deals = max(1, -(-asked // (max(1, len(lows)) * ASKED)))

    def ask(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys = _unpacked(r["keys"], r["n_keys"], np.int64)
                cuts = np.append(np.searchsorted(keys, lows), len(keys)).tolist()
                rows = [(s, r["chunk"] % deals, r["chunk"], keys[x:y].tobytes()) for s, (x, y) in enumerate(zip(cuts, cuts[1:])) if x < y]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["shard", "deal", "chunk", "asked"])

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if right.num_rows:
            keys, counts = (np.frombuffer(right.column(name)[0].as_buffer(), np.int64) for name in ("keys", "counts"))
            for shard, chunk, asked_ in zip(left["shard"].to_pylist(), left["chunk"].to_pylist(), left["asked"]):
                wanted = np.frombuffer(asked_.as_buffer(), np.int64)
                n = counts[np.searchsorted(keys, wanted)]
                best = n == most[np.searchsorted(b_ids, wanted >> 32)]
                out.append((chunk, shard, n.tobytes(), best.tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)], ["chunk", "shard", "n", "best"])

    requests = chunks.select("chunk", "keys", "n_keys").mapInArrow(ask, "shard long, deal long, chunk long, asked binary")
    number = shards.sparkSession.createDataFrame([(int(lo), i) for i, lo in enumerate(lows)], "lo long, shard long")
    held = shards.join(number, "lo").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))).select("shard", F.col("deal").cast("long").alias("deal"), "keys", "counts")
    answers = requests.groupBy("shard", "deal").cogroup(held.groupBy("shard", "deal")).applyInArrow(answer, "chunk long, shard long, n binary, best binary")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "best"))).alias("found"))


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document. a, b: files, or public names by which
    each worker finds them."""
    chunks = aligned_chunks(docs, a, b, id_col, text_col)
    shards = count_shards(chunks)
    answers = materialize(looked_up(chunks, shards), "pair-counts")
    forget(shards)

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                found = r["found"] or []
                counts, best = (np.frombuffer(b"".join(f[name] for f in found), kind) for name, kind in (("n", np.int64), ("best", bool)))
                links = _unpacked(r["links"], sum(r["n_links"]), np.int32)
                last = np.append(0, np.cumsum(r["n_links"]))
                sums = [np.diff(np.append(0, np.cumsum(x[links], dtype=np.int64))[last]) for x in (best, counts)]
                yield pa.record_batch({
                    "doc_id": pa.array(r["ids"], pa.int64()), "n_a": pa.array(r["n_a"], pa.int64()), "n_b": pa.array(r["n_b"], pa.int64()), "n_groups": pa.array(r["n_links"], pa.int64()), "n_links": pa.array(r["n_links"], pa.int64()),
                    "n_best": sums[0], "count_sum": sums[1], "groups_sha256": pa.array(r["groups"], pa.string()),
                })

    own = chunks.drop("keys", "counts").join(answers, "chunk", "left")
    return own.select("ids", "n_a", "n_b", "n_links", "groups", "links", "found").mapInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir).select("doc_id", "text"))
