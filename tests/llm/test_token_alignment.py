"""Alignment of two tokenizers against the libraries and a plain dictionary of pairs, for any size of chunks and shards."""

import collections
import hashlib

import pytest
from edges import documents, empty

from ctxforge.llm import token_alignment as A
from ctxforge.llm.bpe import byte_alphabet, tokenizer_path


def plain(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    alphabet, texts = byte_alphabet(), []
    for i, text in rows:
        own = (" " + text).encode() if text else b""
        a = lib.encode(" " + text, add_special_tokens=False) if text else None
        a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(a.ids, a.tokens)] if a else []
        b = [(i, bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in (sp.encode(text) if text else [])]
        if not text or any(b"".join(x for _, x in side) != own for side in (a, b)):
            a = b = []
        ends = []
        for side in (a, b):
            at, places = 0, {}
            for k, (_, x) in enumerate(side):
                at += len(x)
                places[at] = k
            ends.append(places)
        groups, links, ka, kb = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(str(t) for t, _ in a[ka:x]) + "|" + ",".join(str(t) for t, _ in b[kb:y]))
            links.append((a[x - 1][0], b[y - 1][0]))
            ka, kb = x, y
        texts.append((i, len(a), len(b), groups, links))
    counts = collections.Counter(x for t in texts for x in t[4])
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = [(i, na, nb, len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "") for i, na, nb, g, ls in texts]
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def found(frame):
    return sorted(map(tuple, A.align(frame).select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("chunk, shard, asked", [(4 << 20, 1 << 20, 8 << 20), (20_000, 300, 50)])
def test_equals_the_libraries(spark, sf, monkeypatch, chunk, shard, asked):
    """Small bounds make many chunks, shards of a few keys, and requests dealt over several groups."""
    for name, value in (("CHUNK", chunk), ("SHARD", shard), ("ASKED", asked)):
        monkeypatch.setattr(A, name, value)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = plain([tuple(r) for r in docs.collect()])
    assert found(docs.repartition(3)) == want
    assert sum(r[5] for r in want) < sum(r[4] for r in want)


def test_awkward_rows(spark):
    frame = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert found(frame) == plain(rows)
    more = [(20, "a▁b"), (21, " two  spaces "), (22, "tab\tand\nline\r\n"), (23, " 　"), (24, "<s></s><unk>"), (25, "\x00\x01"), (26, "é ﬁ"), (27, " ")]
    assert found(documents(spark, [(i, t, "en") for i, t in more])) == plain(more)
    assert found(empty(spark)) == []
