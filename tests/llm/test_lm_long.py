"""Long texts are scored by the same model as short ones."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import functions as F

from ctxforge.llm import lm_score
from ctxforge.llm.lm_score import ORDERS, byte_code, score_texts


def test_a_byte_more_changes_little():
    rng = np.random.default_rng(4)
    counts = np.zeros((32 * 256, 256), np.int64)
    counts[97:107, 97:107] = rng.integers(1, 30, (10, 10))
    code, tables = byte_code(counts), [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint16) for _ in ORDERS]
    text = bytes(rng.integers(97, 107, 14_000).astype(np.uint8))
    sizes = [11_900, 11_998, 11_999, 12_000, 12_001, 12_100]
    scores = score_texts([text[:n] for n in sizes], code, tables)
    steps = -np.diff(scores) / np.diff(sizes)
    # The end costs the same within a few decisions; beyond that each byte costs at most a few digits.
    assert (np.abs(steps) < 20).all(), steps


def test_ids_of_any_size_beside_nulls(spark):
    big = 2**60 + 1
    rows = [(big, "one two"), (None, "three one"), (None, "three one"), (7, None), (-big, "two two")]
    got = lm_score.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)


def test_segments_of_a_long_text_are_one_text(monkeypatch):
    rng = np.random.default_rng(8)
    code = byte_code(rng.integers(0, 50, (32 * 256, 256)))
    tables = [rng.integers(0, 1 << 16, 1 << 16).astype(np.uint16) for _ in ORDERS]
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 95, 96, 4 * 96 - 1, 4 * 96, 4 * 96 + 1, 3000)]
    whole = score_texts(texts, code, tables)
    keys = [np.concatenate(k) for k in zip(*(lm_score.decision_keys(code, lm_score.segments(t)) for t in texts))]
    monkeypatch.setattr(lm_score, "PIECE", 4 * 96)
    monkeypatch.setattr(lm_score, "SLICE", 3 * 96)
    monkeypatch.setattr(lm_score, "TOGETHER", 3)
    assert np.allclose(score_texts(texts, code, tables), whole, rtol=1e-5)
    cut = [np.concatenate(k) for k in zip(*(lm_score.decision_keys(code, lm_score.segments(t)) for t in texts))]
    assert all((a == b).all() for a, b in zip(keys, cut))


def test_partial_counts_are_exact_sums(spark, monkeypatch):
    """Whatever is held, emitted early or merged in groups, the counts are those of all texts at once."""
    texts = [f"text {i % 7} of the cat that sat {i % 3} times on mat {i}" for i in range(60)]
    frame = spark.createDataFrame([(i, 0, True, bytearray(t.encode())) for i, t in enumerate(texts)], "doc_id long, key long, train boolean, text binary").repartition(5)
    pairs = lm_score.pair_counts(frame)
    code = byte_code(pairs)
    want = [lm_score.runs(np.sort(k)) for k in lm_score.decision_keys(code, [p for t in texts for p in lm_score.segments(t.encode())])]
    for held, groups in ((lm_score.HELD, 1), (100, 1), (100, 5)):
        monkeypatch.setattr(lm_score, "HELD", held)
        monkeypatch.setattr(lm_score, "WAITING", held)
        monkeypatch.setattr(lm_score, "TASKS", 2)
        found = lm_score.gather(frame, spark.sparkContext.broadcast(code), 3)
        got: list = [[] for _ in ORDERS]
        for r in lm_score.merged(found["tables"], groups).collect():
            u, n = lm_score.unpacked(r["p1"], r["p2"])
            got[r["part"] >> 8].append((u.astype(np.uint64) | np.uint64((r["part"] & 255) << 24), n))
        for (u, n), rows in zip(want, got):
            assert np.array_equal(np.sort(np.concatenate([x for x, _ in rows])), u) and sum(x.sum() for _, x in rows) == n.sum()


def test_words_are_those_of_split():
    rng = np.random.default_rng(9)
    alphabet = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x85", "\xa0", "a", "B", "é", "\u2003", "\0", "😀"]
    texts = ["", " ", "\n a"] + ["".join(rng.choice(alphabet, rng.integers(0, 30))) for _ in range(300)]
    values, sizes = lm_score.tokens(pa.array(texts))
    want = [t.encode().split() for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [v.encode() for v in values.to_pylist()] == [x for w in want for x in w]
    raw = pa.array([b"a\xff b", b"\xfe"]).cast(pa.string(), safe=False)  # bytes that are no characters stay as they are
    assert lm_score.tokens(pc.ascii_lower(raw))[0].cast(pa.binary()).to_pylist() == [b"a\xff", b"b", b"\xfe"]


def test_partial_counts_are_not_written_twice(spark):
    """op5 was stopped beyond its disk: partial counts lay in a table and in the shuffle that read it. Now no files are made before they
    are summed, and the summed ones are all that is left."""
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "ctxforge"
    written = lambda: {f.name for f in shared.glob("lm-*") if any(f.rglob("*.parquet"))}
    frame = spark.createDataFrame([(i, 0, True, bytearray(f"text {i}".encode())) for i in range(20)], "doc_id long, key long, train boolean, text binary")
    code = spark.sparkContext.broadcast(byte_code(lm_score.pair_counts(frame)))
    before = written()
    found = lm_score.gather(frame, code, 3)
    assert written() == before
    for groups in (1, 3):
        counts = lm_score.merged(found["tables"], groups)
        assert len(written() - before) == 1 and all(n.startswith("lm-counts") for n in written() - before)
        lm_score.forget(counts)


def test_what_occurs_often_is_hashed_once(monkeypatch):
    """op5 needed 1104 CPU seconds a GB: it hashed and sorted every decision of every byte for each context length. Now distinct bytes with
    what is in front of them are counted first; counts are the same, and copies make no more decisions."""
    rng = np.random.default_rng(3)
    code = byte_code(rng.integers(0, 50, (32 * 256, 256)))
    texts = [b"", b"a", "ünï 😀".encode(), b"aaaaaaaaaaaa" * 90, bytes(rng.integers(97, 123, 3000).astype(np.uint8))]
    made, real = [], lm_score.keyed
    monkeypatch.setattr(lm_score, "keyed", lambda coder, flat, context: made.append(len(flat)) or real(coder, flat, context))

    def counted(times):
        parts = [p for t in texts * times for p in lm_score.segments(t)]
        some = lm_score.tallied([lm_score.grams(parts[:7]), lm_score.grams(parts[7:])] if len(parts) > 7 else [lm_score.grams(parts)])
        some = lm_score.tallied([some[::2], some[1::2]], "stable")
        made.clear()
        return list(lm_score.gram_counts(code, some)), sum(made)

    (_, once), (got, often) = counted(1), counted(600)
    want = [lm_score.runs(np.sort(k)) for k in lm_score.decision_keys(code, [p for t in texts for p in lm_score.segments(t)])]
    for (u, n), (v, m) in zip(want, got):
        assert np.array_equal(u, v) and np.array_equal(600 * n, m)
    assert often < 3 * once
