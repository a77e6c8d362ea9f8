import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from edges import ROWS, documents, empty
from pyspark.sql import functions as F

from ctxforge.llm import lm_score
from ctxforge.llm.bpe import FragmentCoder, encode_decode, tokenizer_path
from ctxforge.llm.common import crc_mod
from ctxforge.llm.packing import pack, pieces
from ctxforge.llm.permutation_index import clean_vectors, nearest


def brute_base(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t, _ in rows]
    count = Counter(w for own, (i, _, _) in zip(tokens, rows) if i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for w in own)
    n, v = sum(count.values()), len(count)
    return [(len(own), sum(count[w] > 0 for w in own), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)) for own in tokens]


def test_lm_edges(spark):
    got = lm_score.lm_scores(documents(spark), crc_mod(F.col("doc_id"), 5) != 1).collect()
    assert len(got) == len(ROWS)
    want = sorted(brute_base(ROWS))
    for r, w in zip(sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), want):
        assert r[:3] == w[:3] and abs(r[3] - w[3]) < 1e-6 * max(1, abs(w[3]))
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.lm_scores(empty(spark), F.lit(True)).count() == 0
    none = lm_score.lm_scores(documents(spark), F.lit(False)).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(abs(r["base_score"]) < 1e-9 for r in none)


def _model(texts, bits=16):
    """Code and tables of training texts, made without Spark."""
    pairs = np.zeros((32 * 256, 256), np.int64)
    for t in texts:
        for first, a, b in zip(b"\xff\xff" + t, b"\xff" + t, t + b"\xff"):
            pairs[lm_score.CLASSES[first] << 8 | a, b] += 1
    code = lm_score.byte_code(pairs)
    tables = []
    for keys in lm_score.decision_keys(code, [p for t in texts for p in lm_score.segments(t)]):
        u, n = lm_score.runs(np.sort(keys))
        ranges = [(u >> 24) == p for p in range(256)]
        tables.append(np.concatenate([lm_score.table_of(u[r] & np.uint32(0xFFFFFF), n[r], bits) for r in ranges]))
    return code, tables


def test_model_is_a_distribution():
    """Codes are complete, and the probabilities of all one-byte texts, two decisions being the same at the start, sum to one."""
    texts = [b"the cat sat on the mat", b"the dog sat", b"a cat and a dog"]
    code, tables = _model(texts)
    assert all(abs(sum(2.0 ** -code.length[p << 8 : (p + 1) << 8].astype(float)) - 1) < 1e-9 for p in range(len(code.length) >> 8))
    # The first block of a text is predicted with the first weights, so p(a text) = p(its bytes) p(end | bytes).
    for head in (b"", b"the c", b"zz"):
        whole = 10.0 ** plain_score(head, code, tables, end=False)
        total = sum(10.0 ** plain_score(head + bytes([b]), code, tables, end=False) for b in range(256))
        assert abs(total / whole - 1) < 1e-6


def plain_score(text, code, tables, end=True):
    """The mixer one decision at a time, in plain Python."""
    orders, weights, scale, offset = lm_score.ORDERS, [list(map(float, w)) for w in lm_score.WEIGHTS], 1.0, 0.0
    whole, total, waiting = text + (b"\xff" if end else b""), 0.0, []
    for at, byte in enumerate(whole):
        if at and at % lm_score.BLOCK == 0:
            # The gradient of the block's code length, taken at once.
            d_scale = sum(miss * mixed for miss, mixed, _ in waiting)
            d_offset = sum(miss for miss, _, _ in waiting)
            step = [sum(miss * x[k] for miss, _, x in waiting) for k in range(len(orders) + 1)]
            scale, offset = scale + lm_score.SCALE_RATE * d_scale, offset + lm_score.SCALE_RATE * d_offset
            weights = [[w + lm_score.RATE * d for w, d in zip(row, step)] for row in weights]
            waiting = []
        before = (lm_score.PAD + whole[:at])[-8:]
        pair = int(code.which[lm_score.CLASSES[before[-2]] << 8 | before[-1]]) << 8 | byte
        for d in range(int(code.start[pair]), int(code.start[pair] + code.length[pair])):
            inputs, gate = [float(code.logit[d])], 0
            for k, order in enumerate(orders):
                h = int.from_bytes(before, "little") >> (64 - 8 * order)
                h = h * 0x9E3779B97F4A7C15 % 2**64
                h = (h ^ h >> 29) * 0xBF58476D1CE4E5B9 % 2**64
                h = (h >> 33) ^ int(code.salt[d])
                bits = len(tables[k]).bit_length() - 1
                entry = int(tables[k][h >> (31 - bits)])
                seen = entry > 0 and entry >> 8 == (h >> (23 - bits)) & 255
                inputs.append(((entry & 255) - 128) / lm_score.STEP if seen else 0.0)
                gate = k + 1 if seen else gate
            mixed = sum(w * x for w, x in zip(weights[gate], inputs))
            sign = 1 if code.bit[d] else -1
            p = 1 / (1 + math.exp(-sign * (scale * mixed + offset)))
            total += math.log10(p)
            waiting.append(((1 - p) * sign, mixed, inputs))
    return total


def test_scores_equal_a_plain_mixer(monkeypatch):
    rng = random.Random(7)
    words = ["the", "cat", "sat", "on", "a", "mat", "dog", "ünï", "zz9"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))).encode() for _ in range(24)]
    monkeypatch.setattr(lm_score, "OWN_LEAST", 20)
    code, tables = _model(texts[:16])
    assert code.which.max() > 256
    got = lm_score.score_texts(texts, code, tables)
    for t, s in zip(texts, got):
        assert abs(s - plain_score(t, code, tables)) < 1e-4 * max(1.0, abs(s))


def test_tables_check_their_hashes():
    rng = np.random.default_rng(5)
    keys = np.sort(rng.integers(0, 1 << 24, 3000).astype(np.uint32))
    u, n = lm_score.runs(keys)
    assert lm_score.summed([(u, n), (u[:7], n[:7])])[1].sum() == n.sum() + n[:7].sum()
    n[5] = 70_000
    back = lm_score.unpacked(*lm_score.packed(u, n))
    assert back[0].tolist() == u.tolist() and back[1].tolist() == n.tolist()
    table = lm_score.table_of(u, n, 16)  # 256 slots for some 3000 hashes: the most frequent of each stays
    best: dict = {}
    for h in np.unique(u >> 1).tolist():
        zero, one = (int(n[u == (h << 1 | b)].sum()) for b in (0, 1))
        best.setdefault(h >> 15, []).append((-(zero + one), h, zero, one))
    for slot, rows in best.items():
        _, h, zero, one = min(rows)
        logit = max(-127, min(127, round(lm_score.STEP * math.log((one + lm_score.PRIOR) / (zero + lm_score.PRIOR)))))
        assert int(table[slot]) >> 8 == h >> 7 & 255 and (int(table[slot]) & 255) - 128 == logit
    assert (table > 0).sum() == len(best)


def test_scores_do_not_depend_on_company():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc de") for _ in range(rng.randint(0, 900))).encode() for _ in range(40)] + [b"ab " * 9000]
    code, tables = _model(texts[:20])
    together = lm_score.score_texts(texts, code, tables)
    alone = np.array([lm_score.score_texts([t], code, tables)[0] for t in texts])
    assert np.allclose(together, alone, rtol=1e-4)
    assert together[20:].sum() > -sum(len(t) for t in texts[20:]) * 8 * math.log10(2)


def test_bpe_edges(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    coder = FragmentCoder(path)
    rows = encode_decode(documents(spark), path).collect()
    assert len(rows) == len(ROWS)
    want = sorted((t or "", tuple(coder.library.encode(t or "", add_special_tokens=False).ids)) for _, t, _ in ROWS)
    assert sorted((r["decoded"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == want
    assert encode_decode(empty(spark), path).count() == 0


def test_packing_edges(spark):
    path = tokenizer_path("word_bpe_49k.json")
    rows = pack(pieces(documents(spark), path, capacity=64), 64).collect()
    filled: dict = {}
    for r in rows:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = sum(r["length"] for r in rows)
    assert len(filled) <= math.ceil(total / 64) + 2
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS} and pack(pieces(empty(spark), path)).count() == 0
    for i in (5, 6):
        own = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(s == 64 * p for p, s, _ in own) and all(n == 64 for _, _, n in own[:-1])


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2, size=(1500, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [None] + [1.0] * 15), (2003, [float("nan")] * 16), (2004, [1.0] * 3), (None, [1.0] * 16), (2020, vectors[0].tolist()), (2040, vectors[0].tolist())]
    frame = clean_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got: dict = {}
    for r in nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    full = {i: v for i, v in rows if i is not None and v and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(full))
    matrix = np.array([full[i] for i in ids])
    assert set(got) == {i for i in full if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = matrix @ np.array(full[q])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hit += len({i for i, _ in found} & set(ids[order].tolist()))
        assert len(found) == 20 and all(abs(s - float(np.dot(full[i], full[q]))) < 1e-9 for i, s in found)
        assert [(-s, i) for i, s in found] == sorted((-s, i) for i, s in found)
    assert hit >= 0.9 * 20 * len(got)
    few = frame.where("vec_id < 5")
    assert nearest(few, few.where("vec_id = 0")).count() == 4
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_bound_of_likeness_comes_from_all_scores(spark):
    from ctxforge.llm import language_id

    scores = spark.range(50_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003).alias("score")).withColumn("score", F.col("score") * F.col("score"))
    for share in (0.0, 0.001, 0.5, 1.0):
        assert abs(language_id.low_score(scores, share) - scores.agg(F.percentile("score", share)).first()[0]) < 1e-12
    assert language_id.low_score(scores.where("score < 0")) is None
    assert language_id.low_score(scores.limit(1)) == scores.limit(1).first()[0]
