"""Language-model scores by online logistic context mixing, beside a unigram base score.

Text is coded byte by byte (UTF-8, A-Z lowered, byte 255 as the end). A byte becomes a few binary decisions by a
Huffman code that depends on the two bytes before (the first of them by its class); each decision is predicted by
counts under four hashed contexts (the last 2, 3, 4 and 6 bytes) and by the exact counts of its code's context. The
predictions' logits are added with weights that a gate chooses by the longest context seen in training, and a
scale and offset refine the sum. Weights, scale and offset adapt online while a text is read: after each block
of bytes, by the gradient of its code length, so a block is predicted from earlier ones only. Every text starts
from the same state; its score depends on the text and the training counts alone. The sum of log10 probabilities
of all decisions is the text's score, and total bits per byte follow from it.

Training counts are exact sums over all training texts for 31-bit hashes of context and decision. Tasks count each distinct
byte with the six in front of it first, make decisions of what is left, sort them and deal them by ranges of hashes; partial counts of a large corpus are summed in two steps, groups of tasks first. The finished
model is a table for each context length with twice as many slots as hashes were seen, up to 2 ** MOST_BITS, so its
size has a proven bound (64 MB in all) and it is broadcast; a slot holds eight more bits of the hash, so that a context
that training did not see reads as unseen, and goes to the most frequent of the hashes that want it.

The base score needs a count for each distinct token, which has no such bound: each chunk of texts asks for
the counts of its distinct tokens once, requests are dealt by token hash into buckets whose number grows with the
corpus, and replies go back to the chunk.

Edge cases: null texts are empty and score their end alone; ids may be null or of any size; repeated (id, text) rows
get the same scores; without training rows every count is zero (base score: log10 of 1 for each token; the model
predicts evenly); texts of any length are read in segments; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import crc_mod, documents, forget, fresh_path, give_back, materialize, shuffle_partitions, small_batches

#: Context lengths in bytes, beside the previous byte alone.
ORDERS = (2, 3, 4, 6)
#: Classes of the byte before the last in a code's context: white space, letters, digits, other ASCII, bytes of other
#: characters (two), the end; contexts with a code of their own, and how often they must occur.
CLASSES = np.array([0 if b in b" \t\n\x0b\x0c\r" else b - 96 if 97 <= b < 123 else 27 if 48 <= b < 58 else 28 if b < 128 else 29 if b < 192 else 30 if b < 255 else 31 for b in range(256)], np.int32)
OWN_CODES, OWN_LEAST = 384, 1000
#: Bits of the hash of a context and a decision; binary logarithm of a table's slots; and of the ranges of hashes that are
#: merged as one.
HASH_BITS, LEAST_BITS, MOST_BITS, RANGE_BITS = 31, 16, 23, 8
END, PAD = 0xFF, b"\xff" * 8
#: Bytes between two updates of the weights; learning rates of weights, and of scale and offset.
BLOCK, RATE, SCALE_RATE = 96, 0.003, 0.001
#: Bytes of text in a chunk of token requests, and counted at once by the bit model; bytes with what is in front of them that
#: wait in a task before equal ones are counted together, and distinct ones that it holds at most; groups of tasks merged at once; bytes of text for a bucket of
#: requests, and of training text whose partial counts are merged at once.
CHUNK, PIECE, WAITING, HELD, TASKS, BUCKET, GROUP = 8 << 20, 2 << 17, 3 << 20, 2 << 20, 64, 64 << 20, 4 << 30
#: Texts that are scored side by side, and bytes of them that are read at once (so that arrays stay in a core's cache).
TOGETHER, SLICE = 128, 1 << 16
#: First weights: row g holds when the g-th hashed context is the longest seen in training.
WEIGHTS = ((1.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.8, 0.0, 0.0, 0.0), (0.0, 0.3, 0.7, 0.0, 0.0), (0.0, 0.1, 0.3, 0.6, 0.0), (0.0, 0.0, 0.1, 0.3, 0.7))
#: Logits are kept as sixteenths in a byte; PRIOR is added to both counts of a decision.
STEP, PRIOR = 16.0, 0.4
#: Logit of each byte of a slot, and whether it is one; 0 is an empty slot, 256 another hash's. Signs of the bits' opposites.
#: (Places are in range; numpy's take() is fastest where it need not raise.)
LOGITS = np.array([0.0, *((x - 128) / STEP for x in range(1, 256)), 0.0], np.float32)
GATES, SIGNS = np.array([0, *[1] * 255, 0], np.int8), np.array([1, -1], np.float32)


def byte_code(counts: np.ndarray) -> SimpleNamespace:
    """Huffman codes of a byte after the two before it, as flat paths of decisions. counts: (classes of a byte * 256, 256); the
    most frequent contexts have a code of their own (which says where), others that of the previous byte alone."""
    alone = counts.reshape(-1, 256, 256).sum(0)
    size = counts.sum(1)
    own = np.argsort(-size, kind="stable")[:OWN_CODES]
    own = own[size[own] >= OWN_LEAST]
    which = np.tile(np.arange(256, dtype=np.int32), len(counts) // 256)
    which[own] = 256 + np.arange(len(own), dtype=np.int32)
    rows = np.concatenate([alone, counts[own]])
    length, start = np.zeros(rows.size, np.int64), np.zeros(rows.size, np.int64)
    nodes, bits, logits = [], [], []
    for at, row in enumerate(rows):
        # (weight, order, symbol or node, node's children)
        heap: list[tuple] = [(c * 512 + 1, s, s, None) for s, c in enumerate(row.tolist())]
        heapq.heapify(heap)
        made = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a[0] + b[0], 256 + made, made, (a, b)))
            made += 1
        todo: list[tuple] = [(heap[0], (), (), ())]
        while todo:
            (weight, _, node_or_symbol, kids), node, bit, logit = todo.pop()
            if kids is None:
                length[at << 8 | node_or_symbol], start[at << 8 | node_or_symbol] = len(node), len(nodes)
                nodes += node
                bits += bit
                logits += logit
                continue
            one = (*logit, np.log((kids[1][0] / 512 + PRIOR) / (kids[0][0] / 512 + PRIOR)))
            todo += [(kid, (*node, node_or_symbol), (*bit, i), one) for i, kid in enumerate(kids)]
    salt = (np.array(nodes, np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(1)).astype(np.int32)
    return SimpleNamespace(which=which, length=length.astype(np.int32), start=start.astype(np.int32), salt=salt, bit=np.array(bits, np.uint8), logit=np.array(logits, np.float32))


def segments(text: bytes) -> list[tuple[bytes, bytes]]:
    """(bytes in front, bytes to code) of a text, PIECE bytes at a time, its end as the last byte."""
    whole = text + b"\xff"
    return [((PAD + whole[max(0, at - len(PAD)) : at])[-len(PAD) :], whole[at : at + PIECE]) for at in range(0, len(whole), PIECE)]


def laid_out(parts: list[tuple[bytes, bytes]]):
    """Bytes of all segments, each behind those in front of it, the places of the bytes to code, where each segment
    begins and its size."""
    data = np.frombuffer(b"".join([x for p in parts for x in p]), np.uint8)
    sizes = np.fromiter((len(own) for _, own in parts), np.int64, len(parts))
    first = np.cumsum(sizes + len(PAD)) - sizes
    place = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return data, place, first, sizes


def places_before(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The context of a code for each place: the class of the byte before the last, and the last."""
    return CLASSES.take(data.take(place - 2, mode="clip"), mode="clip") << 8 | data.take(place - 1, mode="clip")


def decisions(code: SimpleNamespace, data: np.ndarray, place: np.ndarray):
    """(row in the flat code for each decision, decisions of each byte) for the bytes at place."""
    return paths(code, code.which.take(places_before(data, place), mode="clip") << 8 | data.take(place, mode="clip"))


def paths(code: SimpleNamespace, pair: np.ndarray):
    """The same for pairs of a code and a byte."""
    length, start = code.length.take(pair, mode="clip"), code.start.take(pair, mode="clip")
    ends = np.cumsum(length)
    # Steps of one along a byte's path, and a jump where the next byte's path begins.
    flat = np.ones(ends[-1], np.int32)
    flat[0] = start[0]
    flat[ends[:-1]] = start[1:] - start[:-1] - length[:-1] + 1
    return np.cumsum(flat, dtype=np.int32), length


def contexts(data: np.ndarray, place: np.ndarray, length: np.ndarray):
    """For each context length, the hash of every decision's context."""
    # The eight bytes before each place as one number, the latest on top.
    window = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), strides=(1,))[place - 8]
    byte = np.repeat(np.arange(len(place)), length)
    for order in ORDERS:
        yield hashed(window >> np.uint64(64 - 8 * order)).take(byte, mode="clip")


def hashed(h: np.ndarray) -> np.ndarray:
    """Hashes of contexts, bytes as one number each, which is overwritten."""
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - HASH_BITS)
    return h.astype(np.int32)


def in_pieces(sizes: list[int], most: int = PIECE):
    """Ranges of texts or segments of about most bytes each."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield first, i
            first, total = i, 0
        total += size + len(PAD)
    if first < len(sizes):
        yield first, len(sizes)


def runs(ordered: np.ndarray, n: np.ndarray | None = None):
    """Distinct values of a sorted array, and how often each occurs or the sum of its n."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    at = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    return ordered[at], np.diff(np.append(at, len(ordered))) if n is None else np.add.reduceat(n, at)


def summed(some: list[tuple[np.ndarray, np.ndarray]]):
    """One sorted array of keys with their counts from several."""
    if not some:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    if len(some) == 1:
        return some[0]
    return totals(*(np.concatenate(x) for x in zip(*some)))


def totals(keys: np.ndarray, n: np.ndarray):
    """Distinct keys in order, with the sums of their counts."""
    if n.max(initial=0) < 1 << 32:  # a key and its count fit in one number, which sorts ten times as fast
        both = keys.astype(np.uint64)
        both <<= np.uint64(32)
        both |= n.astype(np.uint64)
        both.sort()
        keys, n = (both >> np.uint64(32)).astype(np.uint32), (both & np.uint64(0xFFFFFFFF)).astype(np.int64)
    else:
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
    return runs(keys, n)


def packed(keys: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys of one range as differences, by place: the lowest bytes as they are, the two others compressed; and counts as
    one byte each, with those from 255 on behind."""
    few, n = n < 255, n.astype(np.int64)
    steps = np.diff(keys.astype(np.uint32), prepend=np.uint32(0))
    high = (steps >> np.uint32(8) & np.uint32(255)).astype(np.uint8).tobytes() + (steps >> np.uint32(16)).astype(np.uint8).tobytes()
    small = zstandard.ZstdCompressor(level=1).compress
    return len(keys).to_bytes(4, "little") + steps.astype(np.uint8).tobytes() + small(high), small(np.where(few, n, 255).astype(np.uint8).tobytes() + n[~few].tobytes())


def unpacked(p1: bytes, p2: bytes) -> tuple[np.ndarray, np.ndarray]:
    whole, size = zstandard.ZstdDecompressor().decompress, int.from_bytes(p1[:4], "little")
    high, p2 = np.frombuffer(whole(p1[4 + size :]), np.uint8).astype(np.uint32), whole(p2)
    steps = np.frombuffer(p1, np.uint8, size, 4) | high[:size] << np.uint32(8) | high[size:] << np.uint32(16)
    n = np.frombuffer(p2, np.uint8, size).astype(np.int64)
    n[n == 255] = np.frombuffer(p2[size:], np.int64)
    return np.cumsum(steps, dtype=np.uint32), n


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts of a byte after the context of its code over the training texts, ends included."""
    contexts_of = 256 * (int(CLASSES.max()) + 1)

    def scan(batches):
        total = np.zeros(contexts_of << 8, np.int64)
        for batch in batches:
            parts = [p for t in batch.column(0).to_pylist() for p in segments((t or b"").lower())]
            for a, b in in_pieces([len(own) for _, own in parts], 8 * PIECE):
                data, place, _, _ = laid_out(parts[a:b])
                total += np.bincount(places_before(data, place) << 8 | data.take(place, mode="clip"), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    found = docs.where("train").select("text").mapInArrow(scan, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    out = np.zeros(contexts_of << 8, np.int64)
    for r in found.toLocalIterator():  # at most a row for each class of bytes and pair of bytes
        out[r["at"]] = r["n"]
    return out.reshape(contexts_of, 256)


def tokens(lowered: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, between ASCII white space, and how many each text has."""
    trimmed = pc.ascii_trim_whitespace(lowered)
    split = pc.ascii_split_whitespace(trimmed)
    # A text without a word splits into one empty string.
    sizes = np.where(pc.binary_length(trimmed).to_numpy() > 0, pc.list_value_length(split).to_numpy(), 0).astype(np.int64)
    values = split.flatten()
    return values.filter(pc.greater(pc.binary_length(values), 0)), sizes


def decision_keys(coder: SimpleNamespace, parts: list[tuple[bytes, bytes]]):
    """For each context length, a key for every decision: its hash with the context, and its bit."""
    data, place, _, _ = laid_out(parts)
    flat, length = decisions(coder, data, place)
    for context in contexts(data, place, length):
        yield keyed(coder, flat, context)


def keyed(coder: SimpleNamespace, flat: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Keys of decisions from their rows in the flat code and the hashes of their contexts, which are overwritten."""
    context ^= coder.salt.take(flat, mode="clip")
    keys = context.view(np.uint32)
    keys <<= np.uint32(1)
    keys |= coder.bit.take(flat, mode="clip")
    return keys


def grams(parts: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Each byte to code and the six in front of it as one number, the latest on top; the lowest eight bits are a count, here 1."""
    data, place, _, _ = laid_out(parts)
    found = np.ndarray((len(data) - 7,), np.uint64, data.tobytes(), strides=(1,))[place - 7]
    found &= np.uint64(0xFFFFFFFFFFFFFF00)
    found |= np.uint64(1)
    return found


def tallied(some: list[np.ndarray], kind: str | None = None) -> np.ndarray:
    """Several arrays of grams as one in order; equal ones are one, or as many as their counts of up to 255 take. The stable kind of
    sort is fast where each array is in order."""
    both = np.concatenate(some)
    both.sort(kind=kind)
    at = np.flatnonzero(np.append(True, (both[1:] ^ both[:-1]) > 255))
    own, n = both[at] & np.uint64(0xFFFFFFFFFFFFFF00), np.add.reduceat(both & np.uint64(255), at).astype(np.int64)
    more = (n - 1) // 255
    if more.any():
        last = np.cumsum(more + 1) - 1
        own, rest = np.repeat(own, more + 1), n - 255 * more
        n = np.full(len(own), 255)
        n[last] = rest
    return own | n.astype(np.uint64)


def gram_counts(coder: SimpleNamespace, some: np.ndarray):
    """For each context length, the distinct keys of decision_keys() in order and their counts, from tallied() grams: what a context
    and a byte have in common with others is hashed once, however often they occur."""
    n = (some & np.uint64(255)).astype(np.int64)
    for order in ORDERS:
        own, m = runs(some >> np.uint64(56 - 8 * order), n)
        last, before, third = ((own >> np.uint64(8 * (order - i))).astype(np.uint8) for i in range(3))
        flat, length = paths(coder, coder.which.take(CLASSES.take(third) << 8 | before) << 8 | last)
        own &= np.uint64((1 << 8 * order) - 1)
        yield totals(keyed(coder, flat, np.repeat(hashed(own), length)), np.repeat(m, length))


def partial_counts(docs: DataFrame, code) -> DataFrame:
    """(part, chunk, p1, p2): sparse partial counts of training decisions, by ranges of hashes. Nothing is written: they go straight
    into the shuffle that sums them."""

    def scan(batches):
        coder = code.value
        held, waiting = np.zeros(0, np.uint64), []
        task = TaskContext.get().partitionId()

        def tally():
            fresh = tallied(waiting)
            waiting.clear()
            return tallied([held, fresh], "stable") if len(held) else fresh

        def partial():
            for k, (keys, n) in enumerate(gram_counts(coder, held)):
                bounds = np.searchsorted(keys, np.arange(1 << RANGE_BITS, dtype=np.uint64) << np.uint64(32 - RANGE_BITS)).tolist() + [len(keys)]
                full = [p for p in range(1 << RANGE_BITS) if bounds[p] < bounds[p + 1]]
                rows = [packed(keys[bounds[p] : bounds[p + 1]] & np.uint32((1 << 32 - RANGE_BITS) - 1), n[bounds[p] : bounds[p + 1]]) for p in full]
                yield pa.record_batch({"part": pa.array([k << RANGE_BITS | p for p in full], pa.int32()), "chunk": pa.array([str(task)] * len(full)), "p1": pa.array([r[0] for r in rows], pa.binary()), "p2": pa.array([r[1] for r in rows], pa.binary())})

        def count(texts):
            nonlocal held
            parts = [p for t in texts for p in segments(t)]
            for a, b in in_pieces([len(own) for _, own in parts]):
                waiting.append(grams(parts[a:b]))
                if sum(map(len, waiting)) > WAITING:
                    held = tally()
                    if len(held) > HELD:
                        yield from partial()
                        held = held[:0]

        for batch in batches:
            lowered = pc.ascii_lower(pc.fill_null(batch.column(0).cast(pa.string(), safe=False), ""))
            yield from count(lowered.cast(pa.binary()).to_pylist())
        if waiting:
            held = tally()
        if len(held):
            yield from partial()
        give_back()

    return docs.where("train").select("text").mapInArrow(scan, "part int, chunk string, p1 binary, p2 binary")


def asked(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over all texts: requests for token counts (kind 1) and the chunks that will use the replies (2)."""

    def scan(batches):
        held: list = []
        task, chunks, size = TaskContext.get().partitionId(), 0, 0

        def record(**columns):
            n = len(next(iter(columns.values())))
            kinds = {"kind": pa.int32(), "part": pa.int32(), "chunk": pa.string(), "p1": pa.binary(), "p2": pa.binary(), "ids": pa.list_(pa.int64()), "keys": pa.list_(pa.int64()), "sizes": pa.list_(pa.int64())}
            return pa.record_batch({k: pa.array(columns.get(k, [None] * n), t) for k, t in kinds.items()})

        def chunk():
            nonlocal chunks, size
            name, size = f"{task}-{chunks}", 0
            chunks += 1
            values, sizes = tokens(pa.concat_arrays([t for _, t in held]))
            encoded = values.dictionary_encode()
            local, words = encoded.indices.to_numpy(), encoded.dictionary.cast(pa.binary()).to_pylist()
            n, rows = len(words), [r for some, _ in held for r in some]
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
            used = np.repeat(np.array([r[2] for r in rows], bool), sizes)
            counts = np.bincount(local[used], minlength=n).astype(np.int64)
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(n, np.uint32)
            place[order] = np.arange(n, dtype=np.uint32)
            full, start = np.unique(bucket[order], return_index=True)
            bounds = np.append(start, n).tolist()
            hashes, counts = hashes[order], counts[order]
            if len(full):
                ranges = list(zip(bounds, bounds[1:]))
                yield record(kind=[1] * len(full), part=full.tolist(), chunk=[name] * len(full), p1=[hashes[a:b].tobytes() for a, b in ranges], p2=[counts[a:b].tobytes() for a, b in ranges])
            yield record(kind=[2], chunk=[name], p1=[place[local].tobytes()], ids=[[r[0] for r in rows]], keys=[[r[1] for r in rows]], sizes=[sizes.tolist()])
            held.clear()

        for batch in batches:
            lowered = batch.column(3).cast(pa.string(), safe=False)
            lowered = pc.ascii_lower(pc.fill_null(lowered, ""))
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            lengths = pc.binary_length(lowered).to_numpy()
            # Whole texts until a chunk is full.
            first = 0
            for i, length in enumerate(lengths.tolist(), 1):
                size += length
                if size >= CHUNK or i == len(rows):
                    held.append((rows[first:i], lowered[first:i]))
                    first = i
                    if size >= CHUNK:
                        yield from chunk()
        if held:
            yield from chunk()
        give_back()

    schema = "kind int, part int, chunk string, p1 binary, p2 binary, ids array<long>, keys array<long>, sizes array<long>"
    return docs.select("doc_id", "key", "train", "text").mapInArrow(scan, schema)


def gather(docs: DataFrame, code, buckets: int) -> dict[str, DataFrame]:
    """The partial counts (tables), and what is asked of token counts (asked); neither is computed yet, so that the files of
    one are gone before those of the other are made."""
    return {"tables": partial_counts(docs, code), "asked": asked(docs, buckets)}


def by_kind(found: DataFrame) -> dict[str, DataFrame]:
    """What is asked, written once as requests and chunks."""
    path = fresh_path(found.sparkSession, "lm-scan")
    found.write.partitionBy("kind").option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)
    rest = "part int, chunk string, p1 binary, p2 binary, ids array<long>, keys array<long>, sizes array<long>, kind int"
    written = found.sparkSession.read.schema(rest).parquet(path)
    out = {name: written.where(F.col("kind") == k).drop("kind") for k, name in ((1, "requests"), (2, "chunks"))}
    for k, name in ((1, "requests"), (2, "chunks")):
        out[name]._written = f"{path}/kind={k}"
    return out


def merged(tables: DataFrame, groups: int = 1) -> DataFrame:
    """(part, p1, p2, n): a row for each range of hashes, from the partial counts of all tasks. With more than one group, tasks are
    summed by groups first, so what a task reads does not grow with the corpus beyond the distinct hashes of its range. Shuffle files
    go, and sums of groups are deleted, once what follows from them is written."""

    def merge(table: pa.Table) -> pa.Table:
        some, held = [], 0
        for p1, p2 in zip(table["p1"], table["p2"]):
            some.append(unpacked(p1.as_py(), p2.as_py()))
            held += len(some[-1][0])
            if held > WAITING:
                some = [summed(some)]
                held = len(some[0][0])
        keys, n = summed(some)
        p1, p2 = packed(keys, n)
        return pa.table({"part": table["part"][:1], "p1": pa.array([p1], pa.binary()), "p2": pa.array([p2], pa.binary()), "n": pa.array([len(keys)], pa.int64())})

    schema = "part int, p1 binary, p2 binary, n long"
    sums = None
    while True:
        dealt = tables.select("part", "p1", "p2", F.pmod(F.xxhash64("p1"), F.lit(groups)).alias("g"))
        counts = materialize(dealt.groupBy("part", "g").applyInArrow(merge, schema), "lm-counts")
        if sums is not None:
            forget(sums)
        if groups == 1:
            return counts
        sums = tables = counts
        groups = -(-groups // TASKS) if groups > TASKS else 1


def table_of(keys: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """Slots of a range of hashes: eight bits that check the hash, and its logit; 0 for none. keys: hash and bit, sorted."""
    h, at = np.unique(keys >> np.uint32(1), return_inverse=True)
    zero, one = (np.bincount(at[(keys & np.uint32(1)) == b], n[(keys & np.uint32(1)) == b], minlength=len(h)) for b in (0, 1))
    slot = (h >> np.uint32(HASH_BITS - bits)).astype(np.int64)
    order = np.lexsort((h, -(zero + one), slot))
    slot, first = np.unique(slot[order], return_index=True)
    best = order[first]
    logit = np.clip(np.rint(STEP * np.log((one[best] + PRIOR) / (zero[best] + PRIOR))), -127, 127).astype(np.int64)
    out = np.zeros(1 << bits - RANGE_BITS, np.uint16)
    out[slot] = (h[best] >> np.uint32(HASH_BITS - 8 - bits) & np.uint32(255)).astype(np.int64) << 8 | logit + 128
    return out


def finished_tables(counts: DataFrame) -> list[np.ndarray]:
    """The model's tables; twice as many slots as there are hashes, within bounds."""
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.shiftright("part", RANGE_BITS).alias("k")).agg(F.sum("n").alias("n")).collect()}
    bits = [min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, 2 * sizes.get(k, 0)))))) for k in range(len(ORDERS))]

    def build(batches):
        for batch in batches:
            for part, p1, p2 in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                slots = table_of(*unpacked(p1.as_py(), p2.as_py()), bits[part >> RANGE_BITS])
                yield pa.record_batch({"part": pa.array([part], pa.int32()), "slots": pa.array([slots.tobytes()], pa.binary())})

    out = [np.zeros(1 << b, np.uint16) for b in bits]
    for r in counts.select("part", "p1", "p2").mapInArrow(build, "part int, slots binary").collect():  # a row is a range; two bytes for each slot
        k, p = r["part"] >> RANGE_BITS, r["part"] & (1 << RANGE_BITS) - 1
        step = len(out[k]) >> RANGE_BITS
        out[k][p * step : (p + 1) * step] = np.frombuffer(r["slots"], np.uint16)
    return out


def score_texts(texts: list[bytes], code: SimpleNamespace, tables: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text, its end included. Texts of like size are read side by side, a slice of whole blocks at
    a time, so that a step has many decisions whatever the texts' lengths."""
    out = np.zeros(len(texts))
    by_size = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for first in range(0, len(texts), TOGETHER):
        group = by_size[first : first + TOGETHER]
        whole, state, at = [texts[i] + b"\xff" for i in group], first_state(len(group)), 0
        sizes = np.array([-len(w) for w in whole])
        while n := int(np.searchsorted(sizes, -at)):  # the first n go on beyond this place
            step = BLOCK * max(1, SLICE // (BLOCK * n))
            parts = [((PAD + w[max(0, at - len(PAD)) : at])[-len(PAD) :], w[at : at + step]) for w in whole[:n]]
            out[group[:n]] += _score_piece(parts, code, tables, SimpleNamespace(weights=state.weights[:n], scale=state.scale[:n], offset=state.offset[:n]))
            at += step
    return out


def first_state(n: int) -> SimpleNamespace:
    """Weights, scale and offset of n texts that were not read yet."""
    return SimpleNamespace(weights=np.tile(np.array(WEIGHTS, np.float32)[None], (n, 1, 1)), scale=np.ones(n, np.float32), offset=np.zeros(n, np.float32))


def _score_piece(parts: list[tuple[bytes, bytes]], code: SimpleNamespace, tables: list[np.ndarray], state: SimpleNamespace) -> np.ndarray:
    """log10 probability of each segment; the state is carried on to the texts' next ones."""
    data, _, first, sizes = laid_out(parts)
    n = len(parts)
    # Blocks of all texts, ordered by number within the text, then by text.
    blocks = -(-sizes // BLOCK)
    text = np.repeat(np.arange(n), blocks)
    number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    order = np.argsort(number, kind="stable")
    text, number = text[order], number[order]
    start = first[text] + number * BLOCK
    size = np.minimum(BLOCK, sizes[text] - number * BLOCK)
    place = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    flat, length = decisions(code, data, place)
    minus = SIGNS.take(code.bit.take(flat, mode="clip"), mode="clip")
    inputs, gate = [code.logit.take(flat, mode="clip")], np.zeros(len(flat), np.int8)
    salt = code.salt.take(flat, mode="clip")
    for k, hashed in enumerate(contexts(data, place, length)):
        hashed ^= salt
        bits = len(tables[k]).bit_length() - 1
        entry = tables[k].take(hashed >> (HASH_BITS - bits), mode="clip")
        # The check's bits become zero where they are right, and what is left is the logit's byte.
        check = hashed.astype(np.uint16)
        check <<= np.uint16(16 + bits - HASH_BITS)
        check &= np.uint16(0xFF00)
        entry ^= check
        np.minimum(entry, np.uint16(256), out=entry)
        inputs.append(LOGITS.take(entry, mode="clip"))
        np.maximum(gate, (GATES * np.int8(k + 1)).take(entry, mode="clip"), out=gate)
    # Decisions of a block are adjacent; those of all blocks of one number too.
    per_block = np.add.reduceat(length, np.cumsum(size) - size, dtype=np.int64)
    ends = np.cumsum(per_block)
    steps = np.searchsorted(number, np.arange(number[-1] + 2))
    gates, weights, scale, offset, total = len(WEIGHTS), state.weights, state.scale, state.offset, np.zeros(n)
    for s in range(len(steps) - 1):
        x, y = steps[s], steps[s + 1]
        lo, hi = int(ends[x] - per_block[x]), int(ends[y - 1])
        own, many = text[x:y], per_block[x:y]
        at = np.cumsum(many) - many
        row = np.repeat(np.arange(y - x, dtype=np.int32) * gates, many) + gate[lo:hi]
        table = weights[own].reshape(-1, len(inputs))
        here = [value[lo:hi] for value in inputs]
        mixed = np.ascontiguousarray(table[:, 0]).take(row, mode="clip")
        mixed *= here[0]
        for k in range(1, len(here)):
            part = np.ascontiguousarray(table[:, k]).take(row, mode="clip")
            part *= here[k]
            mixed += part
        odds = np.repeat(scale[own], many)
        odds *= mixed
        odds += np.repeat(offset[own], many)
        odds *= minus[lo:hi]  # the logit of the other bit
        np.minimum(odds, np.float32(60), out=odds)
        np.exp(odds, out=odds)
        both = odds + np.float32(1)
        odds /= both
        total[own] -= np.add.reduceat(np.log(both), at, dtype=np.float64)
        odds *= minus[lo:hi]  # probability of the other bit, against the bit's sign
        scale[own] -= SCALE_RATE * np.add.reduceat(odds * mixed, at)
        offset[own] -= SCALE_RATE * np.add.reduceat(odds, at)
        weights[own] -= np.stack([RATE * np.add.reduceat(odds * value, at) for value in here], axis=1)[:, None]
    return total / np.log(10)


def base_scores(found: dict[str, DataFrame], train_docs: int) -> tuple[DataFrame, int]:
    """(doc_id, key, n_tokens, n_known, base_score) and the number of training tokens."""

    def reply(pdf: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(x, np.uint64) for x in pdf["p1"]]
        flat, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.zeros(len(flat), np.int64)
        np.add.at(total, inverse, np.concatenate([np.frombuffer(x, np.int64) for x in pdf["p2"]]))
        cuts = np.cumsum([len(h) for h in hashes])[:-1]
        return pd.DataFrame({"part": pdf["part"], "chunk": pdf["chunk"], "counts": [c.tobytes() for c in np.split(total[inverse], cuts)], "v": [int((total > 0).sum())] + [0] * (len(pdf) - 1), "n": [int(total.sum())] + [0] * (len(pdf) - 1)})

    answers = found["requests"].select("part", "chunk", "p1", "p2").groupBy("part").applyInPandas(reply, "part int, chunk string, counts binary, v long, n long")
    answers = materialize(answers, "lm-answers")
    totals = answers.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    n_train = (totals["n"] or 0) + train_docs
    vocabulary = (totals["v"] or 0) + (train_docs > 0)
    norm = n_train + 0.5 * (vocabulary + 1)

    def score(chunk: pa.Table, got: pa.Table) -> pa.Table:
        counts = np.frombuffer(b"".join(got.sort_by("part")["counts"].to_pylist()), np.int64)
        tables = []
        for local, ids, keys, sizes in zip(chunk["p1"].to_pylist(), chunk["ids"], chunk["keys"], chunk["sizes"]):
            c = np.append(counts[np.frombuffer(local, np.uint32)], 0)  # a last zero keeps reduceat in range
            sizes = sizes.values.to_numpy()
            starts = np.minimum(np.cumsum(sizes) - sizes, len(c) - 1)
            some = sizes > 0
            logs = np.where(some, np.add.reduceat(np.log10((c + 0.5) / norm), starts), 0.0)
            known = np.where(some, np.add.reduceat((c > 0).astype(np.int64), starts), 0)
            if len(some) and some[-1]:  # its sum also took the zero that was added
                logs[-1] -= np.log10(0.5 / norm)
            end = np.log10((train_docs + 0.5) / norm)
            tables.append(pa.table({"doc_id": ids.values, "key": keys.values, "n_tokens": sizes + 1, "n_known": known + (train_docs > 0), "base_score": logs + end}))
        return pa.concat_tables(tables) if tables else pa.table({n: pa.array([], t) for n, t in (("doc_id", pa.int64()), ("key", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()))})

    chunks = found["chunks"].select("chunk", "p1", "ids", "keys", "sizes")
    scored = chunks.groupBy("chunk").cogroup(answers.select("chunk", "part", "counts").groupBy("chunk")).applyInArrow(score, "doc_id long, key long, n_tokens long, n_known long, base_score double")
    return scored, n_train


def lm_scores(docs: DataFrame, train: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    train: boolean column that says which rows teach the model."""
    spark = docs.sparkSession
    small_batches(spark, 500)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(train, F.lit(False)).alias("train"), text.cast("binary").alias("text"))
    pairs = pair_counts(own)
    sent_code = spark.sparkContext.broadcast(byte_code(pairs))
    found = gather(own, sent_code, max(shuffle_partitions(spark), -(-int(pairs.sum()) // BUCKET)))
    counts = merged(found["tables"], max(1, -(-int(pairs.sum()) // GROUP)))
    tables = spark.sparkContext.broadcast(finished_tables(counts))
    forget(counts)
    found = by_kind(found["asked"])
    base, n_train = base_scores(found, own.where("train").count())

    def scan(batches):
        for batch in batches:
            texts = [(t or b"").lower() for t in batch.column(3).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "key": batch.column(1), "train": batch.column(2), "bytes": pa.array([len(t) for t in texts], pa.int64()), "score": pa.array(score_texts(texts, sent_code.value, tables.value), pa.float64())})

    model = own.mapInArrow(scan, "doc_id long, key long, train boolean, bytes long, score double")
    base = materialize(base, "lm-base")
    forget(found["requests"], found["chunks"])
    base = base.dropDuplicates(["doc_id", "key"]).withColumnsRenamed({"doc_id": "_id", "key": "_key"})
    both = model.join(base, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")))
    bits = -F.col("score") * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1))
    return both.select("doc_id", "train", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score", bits.alias("bits_per_byte"))


def op5_lm_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    found = lm_scores(documents(spark, sf_dir), ~held_out)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
