"""Exact token counts with a table of merge ranks: Spark cuts texts into words, workers merge distinct words only.

A ranks file has a token (base64) and its rank on each line. A word's tokens come from merging, again and again, the two neighbours whose
joined bytes have the lowest rank; bytes have ranks of their own. Words repeat, so a batch's distinct words are counted once,
and a worker remembers those of earlier batches up to a bound."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how byte-level vocabularies of this family cut texts. White space and letters are those of Unicode.
WORDS = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a task remembers before it starts anew, and their bytes at most.
REMEMBERED, REMEMBERED_BYTES = 1_000_000, 64


class MergeRanks:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.known: dict[bytes, int] = {}

    def merged(self, word: bytes) -> int:
        """Tokens of a word. Neighbours are linked, and merges taken from a heap, so long words take n log n."""
        import heapq

        if word in self.ranks:
            return 1
        n, ranks = len(word), self.ranks
        end, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and (rank := ranks.get(word[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, b, end[b]))

        for i in range(n - 1):
            offer(i)
        left, alive = n, [True] * n
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not alive[a] or end[a] != b or not alive[b] or end[b] != c:
                continue
            end[a], alive[b], left = c, False, left - 1
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return left

    def count(self, words: list[bytes]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        out = []
        for word in words:
            n = self.known.get(word)
            if n is None:
                n = self.merged(word)
                if len(word) <= REMEMBERED_BYTES:
                    self.known[word] = n
            out.append(n)
        return out


def ranks_file(name: str) -> str:
    """Where this machine has a ranks file: a path is taken as it is, a name is that of a public tokenizer."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_counter(name: str, words: str = WORDS):
    """A column function that counts the tokens of a text by a ranks file, given by path or public name; null counts as empty."""

    @F.arrow_udf("long")
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = MergeRanks(ranks_file(name))
        for batch in batches:
            flat = pc.dictionary_encode(batch.flatten())
            counts = np.array(table.count([w.encode() for w in flat.dictionary.to_pylist()]), np.int64)
            sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(counts[flat.indices.to_numpy()])) if len(flat) else np.zeros(1, np.int64)
            last = np.append(0, np.cumsum(sizes))
            yield pa.array(ends[last[1:]] - ends[last[:-1]], pa.int64())

    def counted(text: Column) -> Column:
        return count(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(words), F.lit(0)))

    return counted
