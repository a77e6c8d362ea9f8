"""Packing of tokenized documents by the sum-of-squares rule.

Every document is cut into pieces of at most the capacity (only longer ones are cut). A piece goes into
the open sequence, or a new one, for which the sum over gaps g of N(g)^2 afterwards is smallest, where
N(g) counts open sequences whose remaining gap is g. Moving one sequence from gap g to gap g-s changes
the sum by 2*(N(g-s) - N(g) + 1), opening a new one by 2*N(capacity-s) + 1, and filling a gap exactly
by 1 - 2*N(g), so the state is one array of counts and a piece costs one vector operation.

Pieces are dealt to shards by hash; a shard takes its pieces both longest first and in hash order, with ties by
document and piece, and keeps the packing of fewer sequences, so the result does not depend on how the input was
partitioned. The number of shards grows with the number of pieces; each leaves only a few sequences open.

Edge cases: a null text counts as empty and is one piece that holds the end token only; repeated rows are
packed once each; ids of any size are passed on as they are, null ones too; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import os
import re
import zlib
from functools import reduce
from itertools import compress
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.bpe import byte_alphabet, on_worker
from ctxforge.llm.common import documents, materialize, per_worker, quoted, small_batches
from ctxforge.llm.merges import MergeTable

CAPACITY = 4096
#: Pieces that one shard should pack.
SHARD_PIECES = 200_000
#: Stretches whose ids a worker remembers, about 200 bytes each, before it starts anew.
CACHE = 1_000_000
STRETCH = re.compile(r"[^\W_]+|(?:[^\w \t\n\x0b\x0c\r]|_)+")
RUN = re.compile(r"[^ \t\n\x0b\x0c\r]+")
#: First byte of the characters from U+0300 on.
HIGH = 0xCC
#: Below this first byte all characters beyond ASCII are letters, but for those that begin with, or are, one of
#: NO_LETTERS; U+0130 (whose lower case combines), the apostrophe and the start of a special token are there too.
LETTERS_END, NO_LETTERS = 0xCA, (b"\xc2", b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0", b"'", b"<|")
#: Classes of bytes: 0 white space, 1 letters and digits, 2 the rest of ASCII.
KIND = np.full(256, 2, np.uint8)
KIND[list(b" \t\n\x0b\x0c\r")] = 0
KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class WordCoder:
    """Encodes with a vocabulary that lowers case and drops white space.

    A text is cut into alphanumeric and other stretches between white space, which the vocabulary's
    pre-tokenizer keeps apart too; each distinct stretch is encoded once and looked up afterwards.
    Where a text has apostrophes (contractions), characters that may combine with their neighbours or
    whose lower case does, or the start of a special token, its units are the runs between white space."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.merges = MergeTable(spec["model"], byte_alphabet(), spec["model"]["end_of_word_suffix"])
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        self.known: dict[str | bytes, bytes] = {}

    def _units(self, data: bytes) -> list:
        """Stretches (bytes where classes of bytes tell them apart, else text) or runs."""
        raw = np.frombuffer(data, np.uint8)
        if raw.max(initial=0) < LETTERS_END and not any(x in data for x in NO_LETTERS):
            data = data.lower()
            kind = KIND[np.frombuffer(data, np.uint8)]
            cut = np.flatnonzero(kind[1:] != kind[:-1]) + 1
            start, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(data)]])
            solid = kind[start] > 0 if len(data) else np.zeros(1, bool)
            return [data[a:b] for a, b in zip(start[solid].tolist(), end[solid].tolist())]
        text = data.decode("utf-8")
        if b"'" in data or np.frombuffer(data, np.uint8).max(initial=0) >= HIGH or "\u0130" in text or "<|" in text:
            return RUN.findall(text)
        return STRETCH.findall(text.lower())

    def _learn(self, new: list) -> None:
        # Letters of the Latin blocks need no normalizer but lower case, and are one piece.
        plain, pieces, rest, texts = [], [], [], []
        for p in new:
            if p.isalpha() and isinstance(p, bytes):  # ASCII, and lowered before
                plain.append(p)
                pieces.append(p)
                continue
            t = p.decode("utf-8") if isinstance(p, bytes) else p
            if t.isalpha() and (t is not p or max(t) < "\u0300" and "\u0130" not in t):
                plain.append(p)
                pieces.append(t.lower().encode())
            else:
                rest.append(p)
                texts.append(t)
        done = self.merges.encode(pieces)
        self.known.update(zip(plain, done))
        for p, t, d in zip(plain, pieces, done):
            if d is None:
                rest.append(p)
                texts.append(t.decode())
        for p, e in zip(rest, self.library.encode_batch_fast(texts, add_special_tokens=False)):
            self.known[p] = np.array(e.ids, "<u4").tobytes()

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, the end id included."""
        if len(self.known) > CACHE:
            self.known.clear()
        units, known = list(map(self._units, texts)), self.known
        found = [list(map(known.get, some)) for some in units]
        lacking = [[x is None for x in f] if None in f else None for f in found]
        self._learn(list({u for some, no in zip(units, lacking) if no for u in compress(some, no)}))
        out = []
        for some, f, no in zip(units, found, lacking):
            if no:
                for i in compress(range(len(no)), no):
                    f[i] = known[some[i]]
            out.append(b"".join(f) + self.end)
        return out


def pieces(docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for each piece of each document."""
    small_batches(docs.sparkSession, 500)

    def scan(batches):
        coder = per_worker(("words", path, end_id), lambda: WordCoder(on_worker(path), end_id))
        for batch in batches:
            rows, ids = [], []
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc, data in zip(batch.column(0).to_pylist(), coder.encode_all(texts)):
                for at in range(0, len(data), 4 * capacity):
                    cut = data[at : at + 4 * capacity]
                    rows.append((doc, at // (4 * capacity), at // 4, len(cut) // 4, zlib.crc32(cut)))
                    ids.append(cut)
            columns = list(zip(*rows)) or [()] * 5
            out = {n: pa.array(c, t) for n, c, t in zip(("doc_id", "piece", "start", "length", "ids_crc32"), columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))}
            yield pa.record_batch(out | ({"ids": pa.array(ids, pa.binary())} if keep_ids else {}))

    own = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    return own.mapInArrow(scan, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) for each length, in the order given."""
    count = np.zeros(capacity + 1, np.int64)  # open sequences per gap
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    none = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        gap = 0
        if s < capacity:
            # Change of the sum for each gap g = s..capacity-1.
            left, here = count[: capacity - s], count[s:capacity]
            change = np.where(here > 0, 2 * (left - here + 1), none)
            if here[0]:
                change[0] = 1 - 2 * here[0]
            best = int(change.argmin())
            if change[best] <= 2 * count[capacity - s] + 1:
                gap = s + best
        if gap:
            which = open_at[gap].pop()
            count[gap] -= 1
        else:
            gap, which = capacity, used
            used += 1
        sequence[i], offset[i] = which, capacity - gap
        if gap - s:
            count[gap - s] += 1
            open_at[gap - s].append(which)
    return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows of pieces() with sequence_id and offset. Token ids, if there, stay out of the shards and are joined back."""
    found = materialize(found, "pieces")
    if "ids" in found.columns:
        keys = [c for c in found.columns if c != "ids"]
        with_ids = found.dropDuplicates(keys).select(*(F.col(c).alias(f"_{c}") for c in keys), "ids")
        placed = pack(found.drop("ids"), capacity)
        same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys))
        return placed.join(with_ids, same).select(*found.columns, "offset", "sequence_id")
    shards = max(1, math.ceil(found.count() / SHARD_PIECES))

    def place(table: pa.Table) -> pa.Table:
        ties = [("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("copy", "ascending")]
        tries = []
        for keys in ([("length", "descending"), *ties], [("ids_crc32", "ascending"), *ties]):
            order = pc.sort_indices(table, sort_keys=keys)
            tries.append((order, *sum_of_squares(table["length"].take(order).to_numpy(), capacity)))
        order, sequence, offset = min(tries, key=lambda t: t[1].max(initial=-1))
        shard = table["shard"].to_numpy()[:1]
        dealt = table.take(order).drop_columns(["shard", "copy"])
        return dealt.append_column("offset", pa.array(offset)).append_column("sequence_id", pa.array(sequence + (shard << 40)))

    # Rows that are equal in all columns are told apart by a number, so that they are dealt to shards too.
    names = found.columns
    once = found.groupBy(*names).agg(F.count(F.lit(1)).alias("times"))
    blocks = once.withColumn("from", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(SHARD_PIECES))))
    copies = blocks.withColumn("copy", F.explode(F.sequence("from", F.least(F.col("from") + SHARD_PIECES, "times") - 1)))
    dealt = copies.select(*names, "copy", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(shards)).alias("shard"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    return dealt.groupBy("shard").applyInArrow(place, f"{fields}, offset long, sequence_id long")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir), "word_bpe_49k.json"))
