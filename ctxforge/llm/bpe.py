"""Byte-pair encoding of fragments cut at byte pairs that no vocabulary token contains.

A merge can only join bytes that some token holds side by side, so between two bytes whose pair occurs
inside no token every encoding has a boundary. Texts are cut at such pairs, fragments are encoded
independently (each distinct one once per cache) and their ids are concatenated.

The vocabulary's pre-tokenizer sees fragments instead of whole texts, so only cuts that leave its
matches unchanged are used: before ASCII white space; elsewhere after an ASCII character that is
neither white space nor a control, in front of a character's first byte. A cut in front of an apostrophe
is used only after a letter or digit, since elsewhere it could turn punctuation into a contraction.
Strings of special tokens are cut out first, as the library does.

Edge cases: a null text counts as empty and gives no ids; ids may be null or repeated and are passed on;
other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import documents, per_worker, quoted, small_batches
from ctxforge.llm.merges import MergeTable

#: Fragments whose ids a worker remembers before it starts anew.
CACHE = 300_000
WHITE = b" \t\n\x0b\x0c\r"


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies write bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(spec: dict) -> dict[int, bytes]:
    alphabet = byte_alphabet()
    return {i: bytes(alphabet[c] for c in token) for token, i in spec["model"]["vocab"].items()}


def forced_pairs(tokens) -> np.ndarray:
    """256x256: True where the second byte never follows the first inside a token."""
    inside = np.zeros(1 << 16, bool)
    for token in tokens:
        b = np.frombuffer(token, np.uint8).astype(np.uint16)
        inside[(b[:-1] << 8) | b[1:]] = True
    return ~inside.reshape(256, 256)


def usable_cuts(forced: np.ndarray) -> np.ndarray:
    """Flat table of the forced pairs at which the pre-tokenizer's matches do not change."""
    before, after = np.arange(256)[:, None], np.arange(256)[None, :]
    white = np.isin(after, list(WHITE))
    alnum = ((before >= 48) & (before <= 57)) | ((before >= 65) & (before <= 90)) | ((before >= 97) & (before <= 122))
    printable = (before > 32) & (before < 127)
    starts = ((after > 32) & (after < 127)) | ((after >= 0xC2) & (after < 0xF5))
    plain = printable & starts & ((after != ord("'")) | alnum)
    left = (before >= 32) & (before != 127) | np.isin(before, list(WHITE))
    return (forced & ((white & left) | plain)).ravel()


class FragmentCoder:
    """Encodes and decodes texts with a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        tokens = token_bytes(spec)
        self.merges = MergeTable(spec["model"], byte_alphabet())
        self.cuts = usable_cuts(forced_pairs(tokens.values()))
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        size = max([*tokens, *self.special.values()]) + 1
        self.pieces = [tokens.get(i, b"") for i in range(size)]
        for content, i in self.special.items():
            self.pieces[i] = content
        self.cache: dict[bytes, bytes] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        b = np.frombuffer(data, np.uint8).astype(np.uint16)
        at = (np.flatnonzero(self.cuts[(b[:-1] << 8) | b[1:]]) + 1).tolist()
        return [data[x:y] for x, y in zip([0, *at], [*at, len(data)])]

    def _learn(self, new: list[bytes]) -> None:
        # A word with or without a space in front is one match of the pre-tokenizer.
        plain = [p for p in new if p.removeprefix(b" ").decode("utf-8").isalpha()]
        self.cache.update(zip(plain, self.merges.encode(plain)))
        rest = [p for p in new if self.cache.get(p) is None]
        for p, e in zip(rest, self.library.encode_batch_fast([p.decode("utf-8") for p in rest], add_special_tokens=False)):
            self.cache[p] = np.array(e.ids, "<u4").tobytes()

    def _parts(self, data: bytes) -> list[bytes]:
        """Fragments of a text, with special tokens as parts of their own."""
        for content in self.special:
            if content in data:
                first, *rest = data.split(content)
                return self._parts(first) + [x for r in rest for x in (content, *self._parts(r))]
        return self.fragments(data) if data else []

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, cache = [self._parts(t) for t in texts], self.cache
        new = {p for parts in split for p in parts if p not in cache}
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = {p for parts in split for p in parts}
        self._learn(list(new))
        return [b"".join(map(cache.__getitem__, parts)) for parts in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included."""
        pieces = self.pieces
        return b"".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): ids as little-endian u32, and the text they give back. path: of the vocabulary
    file, or its public name, by which each worker finds it."""
    small_batches(docs.sparkSession, 500)

    def scan(batches):
        coder = per_worker(("fragments", path), lambda: FragmentCoder(on_worker(path)))
        for batch in batches:
            ids = coder.encode_all([t or b"" for t in batch.column(1).to_pylist()])
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.binary()), "decoded": pa.array([coder.decode(i) for i in ids], pa.string())})

    own = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("binary").alias("text"))
    return own.mapInArrow(scan, "doc_id long, ids binary, decoded string")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def on_worker(path: str) -> str:
    """Where this machine has a vocabulary file that is given by name; a path is taken as it is."""
    return path if os.path.isabs(path) else tokenizer_path(path)


def op7_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(documents(spark, sf_dir), "byte_bpe_50k.json")
    count = F.floor(F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
