"""Suffix sort: removed bytes against a plain dictionary of all windows, whatever the sizes of chunks, runs and buckets."""

import hashlib
import random

import pytest
from edges import documents, empty

from ctxforge.llm import suffix_dedup as S


def plain(rows, window=50):
    """Per row (id, n_bytes, n_removed, n_spans, kept)."""
    least, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        if i is not None:
            for p in range(len(b) - window + 1):
                w = b[p : p + window]
                least[w] = min(i, least.get(w, i))
    for i, b in data:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - window + 1):
                if least[b[p : p + window]] < i:
                    gone[p : p + window] = b"\1" * window
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def texts(seed, n=120):
    r = random.Random(seed)
    words = [("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))) for _ in range(60)]
    passages = [" ".join(r.choices(words, k=k)) for k in (9, 12, 20, 60, 300)]
    rows = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.choice((0, 1, 8, 10, 50, 200))))
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(t))
            t = t[:at] + r.choice(passages) + t[at:]
        rows.append((i, t if r.random() < 0.9 or not rows else r.choice(rows)[1]))
    rows += [(900, "a" * 700), (901, "a" * 400 + "b" + "a" * 49), (902, "a" * 49), (903, "ab" * 200), (904, "é" * 25), (905, "é" * 25), (7, "é" * 30)]
    return rows


def found(frame):
    from pyspark.sql import functions as F

    rows = S.without_repeats(frame).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    return sorted(map(tuple, rows.collect()), key=repr)


@pytest.mark.parametrize("chunk, run, bucket, frequent", [(4 << 20, 64, 4 << 20, 1 << 15), (700, 5, 3000, 4), (3000, 20, 2000, 1 << 15)])
def test_equals_all_windows(spark, monkeypatch, chunk, run, bucket, frequent):
    """Small chunks cut long texts; small buckets and a low bound of frequency deal suffixes one by one."""
    for name, value in (("CHUNK", chunk), ("RUN", run), ("BUCKET", bucket), ("FREQUENT", frequent)):
        monkeypatch.setattr(S, name, value)
    rows = texts(chunk)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(frame) == plain(rows)


def test_awkward_rows(spark):
    frame = documents(spark)
    assert found(frame) == plain([(r["doc_id"], r["text"]) for r in frame.collect()])
    assert found(empty(spark)) == []


def test_equal_hashes_are_compared():
    """With a hash that is the same for all strings only equal ones count as copies."""
    import numpy as np

    text = np.frombuffer(b"abcdefghij" + b"abcdefghij" + b"abcdefghiX" + bytes(8), np.uint8)
    at, size, ids = np.array([0, 10, 20]), np.array([10, 10, 10]), np.array([1, 2, 3])
    real, S.digest = S.digest, lambda w, a, s: np.zeros(len(a), np.uint64)
    try:
        assert S.settled(S._words(text), at, size, ids).tolist() == [False, True, False]
    finally:
        S.digest = real
