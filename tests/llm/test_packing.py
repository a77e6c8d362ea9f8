import random

import numpy as np
import pytest

from ctxforge.llm.bpe import tokenizer_path
from ctxforge.llm.packing import WordCoder, pack, pieces, sum_of_squares


@pytest.fixture(scope="module")
def coder():
    return WordCoder(tokenizer_path("word_bpe_49k.json"), 1)


CASES = ["", " ", "It's a DON'T 'S !'s ''s", "ÉÀ é. «à» —'! x—y", "J̌ ẖ İ K Σσς ΟΔΟΣ.", "a<|endoftext|>B <|startoftext|> <|ENDOFTEXT|>", "中文 。x 　y !z", "a_b-c__d 12x34 ²½ ªº", "a\x1cb\x85c \x00d", "x" * 500]


def same(coder, text):
    assert np.frombuffer(coder.encode_all([text.encode()])[0], "<u4").tolist() == coder.library.encode(text, add_special_tokens=False).ids + [1], repr(text)


@pytest.mark.parametrize("text", CASES)
def test_equals_library(coder, text):
    same(coder, text)


def test_random_texts_equal_library(coder):
    rng = random.Random(3)
    alphabet = list("abJHTzAB019'' \t\n.,!-_#\x1c\x00éÉñßİ中Σ😀 　́̌̇") + ["'s", "'LL", "the ", "<|endoftext|>"]
    for _ in range(3000):
        same(coder, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))))


def test_sum_of_squares_minimises_at_each_step():
    rng = random.Random(2)
    for _ in range(30):
        capacity = rng.randint(5, 20)
        lengths = np.array([rng.randint(1, capacity) for _ in range(60)])
        sequence, offset = sum_of_squares(lengths, capacity)
        fill: dict[int, int] = {}

        def cost(f):
            gaps = [capacity - x for x in f.values() if x < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))

        for s, b, o in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
            assert fill.get(b, 0) == o and o + s <= capacity
            choices = [k for k, v in fill.items() if v + s <= capacity] + [max(fill, default=-1) + 1]
            best = min(cost(fill | {k: fill.get(k, 0) + s}) for k in choices)
            fill[b] = o + s
            assert cost(fill) == best


def test_ids_of_any_size_beside_nulls(spark):
    big = 2**60 + 1
    rows = [(big, "one two"), (None, "three"), (None, "three"), (3, None), (big, "one two"), (-big, "x " * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    path = tokenizer_path("word_bpe_49k.json")
    got = pack(pieces(frame, path, capacity=16, keep_ids=True), 16).collect()
    assert sorted(str(r["doc_id"]) for r in got if r["piece"] == 0) == sorted(str(i) for i, _ in rows)
    coder = WordCoder(path, 1)
    want = {str(i): coder.encode_all([(t or "").encode()])[0] for i, t in rows}
    for r in got:
        assert bytes(r["ids"]) == want[str(r["doc_id"])][4 * r["start"] : 4 * (r["start"] + r["length"])]
    places = [(r["sequence_id"], r["offset"]) for r in got]
    assert len(set(places)) == len(places)
