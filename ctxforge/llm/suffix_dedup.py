"""Removal of repeated byte strings by a suffix sort that stops at the threshold.

Every place of a document with 50 bytes ahead of it is a suffix, ordered through those 50 bytes only. The sort is by most
significant digits: the first digit, the least hash among the 16-byte strings of the 50, deals suffixes to buckets; within a bucket
digits of eight bytes follow, and after each digit suffixes whose group has a single document left drop out. Groups that
last through all digits are exactly the strings that several documents hold; in all but the smallest doc_id they go.

Neighbouring suffixes mostly have the same first digit, so a run of them travels as one string (about four bytes for a suffix
where a suffix alone takes fifty). A chunk sends the same run once: where it occurs in documents of larger ids as well, it is
settled there. Buckets grow in number with the corpus. A first digit that a sample of the documents shows to be frequent does not
bind its suffixes to one bucket: they travel one by one, dealt by all their bytes.

Edge cases: a null text counts as empty; documents under 50 bytes, and those without an id (no id is smaller or larger
than none), lose nothing; rows are told apart by id and text, so repeated rows get the same result and rows that share an id never cost
each other bytes; long texts are cut into segments that overlap by 49 bytes; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import documents, give_back, materialize, quoted, sent_if_small, shuffles_removed, small_batches

#: Bytes that must repeat, and bytes of the strings that give the first digit.
WINDOW = 50
GRAM = 16
#: Bytes of text that a worker takes at a time, suffixes that a run holds at most, and suffixes of a bucket on average.
CHUNK = 4 << 20
RUN = 64
BUCKET = 4 << 20
#: Documents in the sample for frequent first digits (at least, and at most), and runs from which on one counts as frequent.
SAMPLE = (4096, 65536)
FREQUENT = 1 << 15

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_RUNS = "bucket int, n long, settled long, ids binary, keys binary, starts binary, runs binary, digits binary, size long, text binary"
#: Columns of a run as integers; ids are stored as differences. Those of settled runs have no digit.
_KINDS = {"ids": np.int64, "keys": np.int64, "starts": np.int32, "runs": np.uint8, "digits": np.uint32}


def _words(buffer: np.ndarray, kind: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as an integer; a view."""
    return np.ndarray((len(buffer) - 7,), kind, buffer, strides=(1,))


def first_digits(buffer: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each place the least hash of the gram-byte strings within the window bytes ahead; gram: a multiple of eight."""
    words, n = _words(buffer), len(buffer) - gram + 1
    mixed = words[:n] * _A
    for at in range(8, gram, 8):
        mixed ^= mixed >> np.uint64(32)
        mixed += words[at : at + n]
        mixed *= _B
    mixed ^= mixed >> np.uint64(29)
    mixed *= _C
    least, width, most = (mixed >> np.uint64(32)).astype(np.uint32), 1, window - gram + 1
    while width < most:
        step = min(width, most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def digest(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the size[i] >= 8 bytes from at[i] on."""
    out, last = size.astype(np.uint64) * _A, at + size - 8
    for step in range(0, int(size.max(initial=0)), 8):
        out ^= words[np.minimum(at + step, last)]
        out *= _B
        out ^= out >> np.uint64(31)
    return out


def settled(words: np.ndarray, at: np.ndarray, size: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which strings also occur here with a smaller id. Equal hashes are compared byte by byte."""
    out = np.zeros(len(at), bool)
    if not len(at):
        return out
    code = digest(words, at, size)
    order = np.lexsort((ids, code))
    fresh = np.append(True, code[order][1:] != code[order][:-1])
    first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    ours, theirs = order[ids[order] > ids[first]], first[ids[order] > ids[first]]
    same = size[ours] == size[theirs]
    for step in range(0, int(size.max()), 8):
        a, b = (words[np.minimum(at[x] + step, at[x] + size[x] - 8)] for x in (ours, theirs))
        same &= a == b
    out[ours[same]] = True
    return out


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def sorted_groups(words: np.ndarray, at: np.ndarray, digit: np.ndarray, ids: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(members, least id) of the suffixes that occur with several ids, least id repeated for each member. at: their places, digit: the
    first digit. One pass for each eight bytes; what is left of a group with one id drops out between passes."""
    live = np.arange(len(at))
    group = digit.astype(np.uint64)
    for step in [None, *range(0, window - 8, 8), window - 8]:
        if step is None:
            order = np.argsort(group, kind="stable")
            group, live = group[order], live[order]
            fresh = np.append(True, group[1:] != group[:-1])
        else:
            value = words[at[live] + step].astype(np.uint64)
            order = np.lexsort((value, group))
            group, value, live = group[order], value[order], live[order]
            fresh = np.append(True, (group[1:] != group[:-1]) | (value[1:] != value[:-1]))
        if not len(live):
            return
        begin = np.flatnonzero(fresh)
        least, most = np.minimum.reduceat(ids[live], begin), np.maximum.reduceat(ids[live], begin)
        number = np.cumsum(fresh) - 1
        keep = (least < most)[number]
        live, group, least = live[keep], number[keep].astype(np.uint64), least[number[keep]]
    yield live, least


def _packed(x: np.ndarray) -> bytes:
    """Integers byte by byte of their width, compressed."""
    return pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T), asbytes=True)


def _unpacked(x: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = np.frombuffer(pa.decompress(x, n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(width, n).T).reshape(-1).view(kind)


def _runs_of(parts: list[tuple[int, int, int, bytes]], n_buckets: int, frequent: np.ndarray, window: int, gram: int) -> pa.RecordBatch | None:
    """A chunk's runs, a row for each bucket. parts: (id, key, place in the text, bytes)."""
    sizes = np.array([len(p[3]) for p in parts])
    base = np.concatenate([[0], np.cumsum(sizes)])
    buffer = np.frombuffer(b"".join(p[3] for p in parts) + bytes(window + gram + 8), np.uint8)
    digits = first_digits(buffer, window, gram)
    whole = np.ones(base[-1], bool)
    for end in base[1:].tolist():
        whole[end - window + 1 : end] = False
    digits = digits[: base[-1]]
    change = np.append(True, digits[1:] != digits[:-1])
    change[1:] |= whole[1:] != whole[:-1]
    change[base[:-1]] = True
    begin = np.flatnonzero(change)
    count = np.diff(np.append(begin, base[-1]))
    begin, count = begin[whole[begin]], count[whole[begin]]
    if len(count) and count.max() > RUN:
        pieces = -(-count // RUN)
        nth = spread(np.zeros(len(count), np.int64), pieces)
        begin, left = np.repeat(begin, pieces) + nth * RUN, np.repeat(count, pieces) - nth * RUN
        count = np.minimum(left, RUN)
    alone = np.isin(digits[begin], frequent)
    if alone.any():
        each = spread(begin[alone], count[alone])
        begin, count = np.concatenate([begin[~alone], each]), np.concatenate([count[~alone], np.ones(len(each), count.dtype)])
        alone = np.arange(len(begin)) >= len(begin) - len(each)
    if not len(begin):
        return None
    words, digit, size = _words(buffer), digits[begin], count + window - 1
    part = np.searchsorted(base, begin, "right") - 1
    ids, keys = (np.array([p[i] for p in parts], np.int64)[part] for i in (0, 1))
    place = np.array([p[2] for p in parts], np.int64)[part] + begin - base[part]
    code = digit.astype(np.uint64)
    code[alone] = digest(words, begin[alone], size[alone])
    bucket = ((code * _A) >> np.uint64(33)).astype(np.int64) % n_buckets
    gone = settled(words, begin, size, ids)
    order = np.lexsort((begin, gone, bucket))
    ends = np.flatnonzero(np.append(bucket[order][1:] != bucket[order][:-1], True)) + 1
    rows, left = [], 0
    for right in ends.tolist():
        own = order[left:right]
        n_gone = int(gone[own].sum())
        sent = own[: len(own) - n_gone]
        text = buffer[spread(begin[sent], size[sent])]
        held = (np.diff(ids[own], prepend=0), keys[own], place[own].astype(np.int32), count[own].astype(np.uint8), digit[sent])
        rows.append((int(bucket[own[0]]), len(own), n_gone, *map(_packed, held), len(text), pa.Codec("zstd", compression_level=3).compress(text, asbytes=True)))
        left = right
    kinds = (pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5, pa.int64(), pa.binary())
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], [f.split()[0] for f in _RUNS.split(", ")])


def _segments(batches, window: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (id, key, place, bytes) of about CHUNK bytes; long texts in segments that overlap."""
    held, size = [], 0
    for batch in batches:
        for id_, key, text in zip(*(c.to_pylist() for c in batch.columns)):
            for at in range(0, len(text) - window + 1, CHUNK):
                piece = text[at : at + CHUNK + window - 1]
                held.append((id_, key, at, piece))
                size += len(piece)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _repeats(rows: list[dict], window: int) -> pa.RecordBatch:
    """Places to remove, as (_id, _key, at, end), from the runs of one bucket."""
    held = []
    for r in rows:
        own = {name: _unpacked(r[name], r["n"] - (r["settled"] if name == "digits" else 0), kind) for name, kind in _KINDS.items()}
        held.append((own | {"ids": np.cumsum(own["ids"])}, r["n"] - r["settled"]))
    out = [tuple(np.concatenate([h[name][sent:] for h, sent in held]) for name in ("ids", "keys", "starts", "runs"))]
    ids, keys, starts, runs, digit = (np.concatenate([h[name][:sent] for h, sent in held]) for name in _KINDS)
    starts, runs = starts.astype(np.int64), runs.astype(np.int64)
    text = np.frombuffer(b"".join(pa.decompress(r["text"], r["size"], "zstd", asbytes=True) for r in rows) + bytes(8), np.uint8)
    size = runs + window - 1
    at = np.cumsum(size) - size
    gone = settled(_words(text), at, size, ids)
    out.append((ids[gone], keys[gone], starts[gone], runs[gone]))
    left = np.flatnonzero(~gone)
    # First digits that one document alone has need no suffixes of their own.
    order = left[np.argsort(digit[left], kind="stable")]
    if len(order):
        fresh = np.append(True, digit[order][1:] != digit[order][:-1])
        begin = np.flatnonzero(fresh)
        several = np.minimum.reduceat(ids[order], begin) < np.maximum.reduceat(ids[order], begin)
        left = order[several[np.cumsum(fresh) - 1]]
    run, offset = np.repeat(left, runs[left]), spread(np.zeros(len(left), np.int64), runs[left])
    for member, least in sorted_groups(_words(text, ">u8"), at[run] + offset, digit[run], ids[run], window):
        later = np.sort(member[ids[run[member]] > least])
        if len(later):
            fresh = np.append(True, (np.diff(later) != 1) | (run[later][1:] != run[later][:-1]))
            begin = np.flatnonzero(fresh)
            own = later[begin]
            out.append((ids[run[own]], keys[run[own]], starts[run[own]] + offset[own], np.diff(np.append(begin, len(later)))))
    ids, keys, starts, runs = (np.concatenate([x[i] for x in out]).astype(np.int64) for i in range(4))
    return pa.record_batch({"_id": ids, "_key": keys, "at": starts, "end": starts + runs + window - 1})


def frequent_digits(texts: DataFrame, n_docs: int, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """First digits with FREQUENT runs or more in the corpus, by a sample of its documents. They only change the way
    that suffixes are dealt out, not what is found."""
    wanted = min(SAMPLE[1], max(SAMPLE[0], n_docs // 64))
    part = max(1, n_docs // wanted)

    def count(batches):
        for parts in _segments(batches, window):
            buffer = b"".join(p[3] for p in parts)
            digits = first_digits(np.frombuffer(buffer + bytes(window + gram), np.uint8), window, gram)[: len(buffer)]
            value, n = np.unique(digits[np.append(True, digits[1:] != digits[:-1])], return_counts=True)
            yield pa.record_batch({"digit": value.astype(np.int64), "n": n.astype(np.int64)})

    sample = texts.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(part)) == 0)
    sums = sample.mapInArrow(count, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n"))
    return np.array([r[0] for r in sums.where((F.col("n") >= 4) & (F.col("n") * part >= FREQUENT)).collect()], np.uint32)


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col)).cast("string")
    return docs.select(F.col(quoted(id_col)).cast("long").alias("_id"), F.xxhash64(text).alias("_key"), text.cast("binary").alias("_text"))


def _size(texts: DataFrame) -> tuple[int, int, bool]:
    """Rows, bytes, and whether rows of one id have different texts."""
    by_id = texts.groupBy("_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("_text")).alias("size"), (F.min("_key") != F.max("_key")).alias("several"))
    return tuple(by_id.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("several"), F.lit(False))).first())


def repeated_places(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _key, at, end): stretches of the texts' bytes that window bytes of a smaller id cover; they may overlap. _key: xxhash64 of
    the text, or zero where no id has several texts."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _identified(docs, id_col, text_col).where(F.col("_id").isNotNull() & (F.octet_length("_text") >= window))
    n_docs, size, several = _size(texts)
    # A hash of the text tells rows of one id apart; it is carried only where there are such rows.
    texts = texts.withColumn("_key", F.col("_key") if several else F.lit(0).cast("long"))
    n_buckets = max(1, min(-(-size // BUCKET), 1 << 30))
    frequent = frequent_digits(texts, n_docs, window, gram) if n_docs >= FREQUENT else np.zeros(0, np.uint32)

    def runs(batches):
        for parts in _segments(batches, window):
            found = _runs_of(parts, n_buckets, frequent, window, gram)
            if found:
                yield found
        give_back()

    def repeats(batches):
        held = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield _repeats(held, window)
                    held = []
                held.append(row)
        if held:
            yield _repeats(held, window)
        give_back()

    dealt = texts.mapInArrow(runs, _RUNS).repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(repeats, "_id long, _key long, at long, end long")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): each text without the bytes that documents of smaller ids hold too."""
    places = repeated_places(docs, id_col, text_col, window, gram)
    with shuffles_removed(docs.sparkSession):
        spans = materialize(places.groupBy("_id", "_key").agg(F.collect_list(F.struct("at", "end")).alias("_spans")), "repeated-spans")
    width = spans.agg(F.avg(F.size("_spans"))).first()[0] or 0
    spans = sent_if_small(spans.withColumnsRenamed({"_id": "_sid", "_key": "_skey"}), int(64 + 32 * width))
    own = _identified(docs, id_col, text_col)
    both = own.join(spans, (F.col("_id") == F.col("_sid")) & F.col("_skey").isin(F.col("_key"), F.lit(0)), "left")
    both = both.select(F.col("_id").alias("doc_id"), F.coalesce("_text", F.lit(b"")).alias("text"), F.col("_spans.at").alias("at"), F.col("_spans.end").alias("end"))

    def cut(batches):
        for batch in batches:
            n_removed, n_spans, kept = [], [], []
            for text, at, end in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                parts, done, spans = [], 0, 0
                for a, b in sorted(zip(at or (), end or ())):
                    if a > done or not spans:
                        parts.append(text[done:a])
                        spans += 1
                    done = max(done, b)
                parts.append(text[done:])
                kept.append(b"".join(parts))
                n_removed.append(len(text) - len(kept[-1]))
                n_spans.append(spans)
            n_bytes = pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())
            yield pa.record_batch({"doc_id": batch.column(0), "n_bytes": n_bytes, "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits, so that positions are bytes; texts are cut first, as substr walks from a string's start.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
c AS (SELECT doc_id, q, substr(h, 2 * q + 1, 298) AS h FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49, 100)) AS q FROM d WHERE length(h) >= 100)),
w AS (SELECT doc_id, q + r AS p, substr(h, 2 * r + 1, 100) AS w FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS r FROM c)),
v AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS owner FROM w),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER o <= 50 THEN 0 ELSE 1 END AS fresh FROM v WHERE owner < doc_id WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
n AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS nth FROM g),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM n GROUP BY doc_id, nth),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC) AS last FROM s),
j AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || any_value(CASE WHEN last = 1 THEN substr(h, 2 * b + 1) END) AS kept
      FROM k JOIN d ON k.doc_id = d.doc_id GROUP BY k.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
"""
