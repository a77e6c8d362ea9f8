"""Words of the language model against the pattern that defines them."""

import numpy as np

from ctxforge.llm import language_id as L


def test_words_are_runs_of_letters():
    """Few characters between words, and more than are replaced one by one; other scripts, marks of number, line ends, case that changes length."""
    many = "a".join(map(chr, range(33, 64))) + "b".join(map(chr, range(0x2000, 0x2100)))
    assert len(L.WORD.sub("", "".join(set(many.lower())))) > L.BETWEEN
    for text in ("", None, "12 _ 3", "Das ist_ein Test-Fall, 3x\r\nno break line", "İstanbul ß ŽĆ ²x Ⅻ½", "слово, слово! 数字和文字", "a\x00b\x1cc", many):
        want = L.WORD.findall(text.lower()) if text and any(map(str.isalpha, text)) else []
        assert L.words_of(text) == want


def test_grams_of_a_word():
    """One to three characters, padded."""
    grams = L.Grams()
    names = lambda word: [list(grams.ids)[k] for k in grams.of([word]).tolist()]
    for word in ("a", "ab", "straße"):
        p = f"_{word}_"
        assert names(word) == [*word, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]
    assert grams.of(["a"]).dtype == np.uint32
