import random

import numpy as np
import pytest

from ctxforge.llm.bpe import FragmentCoder, tokenizer_path

CASES = ["", " ", "  ", "\n\n \n x", "a  b", "it's 'tis !'s ''s don't'll x''ll I'M", "<|endoftext|>a<|endoftext|>", "<|endo ftext|>", "é  b　c  d", "中文 字符😀😀 z", "a\tb\x0bc \x1c d\x85e", "#'re (a) --'d 12'34 ' s", "x\r\n\r\n  y", "́a ́", "0123456789012 a1b2", "tab\t\tx   \t y  ", "a" * 300, "qzxj" * 50]


@pytest.fixture(scope="module")
def coder():
    return FragmentCoder(tokenizer_path("byte_bpe_50k.json"))


def same(coder, text):
    want = coder.library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(coder.encode_all([text.encode()])[0], "<u4").tolist()
    assert got == want, repr(text)
    assert coder.decode(coder.encode_all([text.encode()])[0]) == coder.library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", CASES)
def test_equals_library(coder, text):
    same(coder, text)


def test_random_texts_equal_library(coder):
    rng = random.Random(5)
    alphabet = list("abzqABZ019'' \t\n\x0b.,!-#\"\x1c\x7f\x00éñß中😀 　́") + ["'s", "'ll", "  ", "the ", "<|endoftext|>"]
    for _ in range(3000):
        same(coder, "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14))))
