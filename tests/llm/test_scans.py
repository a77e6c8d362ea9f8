import base64
import hashlib
import random
import re

import pytest
from edges import ROWS, documents, empty

from ctxforge.llm.chat_format import escape, format_conversations, format_turn, joined, parse, read_back, unescape
from ctxforge.llm.language_id import mean_ranks, predict, profiles, with_language
from ctxforge.llm.secrets import digest_columns, find_secrets, redact, thresholds

KINDS = (
    ("assign", re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def base_spans(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p, g, n) in enumerate(KINDS) for m in p.finditer(text or "") if len(m[g]) >= n)


def secret_texts(n=300):
    rng = random.Random(8)
    parts = ["password: ", "Token=", "api_key = '", "\"secret\" : \"", "abcdefghijkl", "0123456789abcdef", "AKIA", "AKIAABCDEFGHIJKLMN", "é😀", " ", "\n", "=", ":", "token=secret=", "passwd", "deadbeef" * 3, "x"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_base_spans_equal_brute_force(spark):
    texts = secret_texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in digest_columns(find_secrets(frame)).collect():
        found = base_spans(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), texts[r["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[3] == k for f in found) for k in ("assign", "access", "hex")]


def test_battery_finds_random_strings_and_not_words(spark):
    rng = random.Random(4)
    rows, planted = [], set()
    for i in range(200):
        words = " ".join("".join(rng.choice(["the", "ing", "tion", "er", "an"]) for _ in range(rng.randint(1, 9))) for _ in range(30))
        if i % 4 == 0:
            key = base64.b64encode(rng.randbytes(48)).decode().rstrip("=")
            words, planted = f"{words} {key} end", planted | {i}
        if i % 4 == 1:
            words += " CamelCaseIdentifierNumber1ForTesting2 aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaA1 path/to/Some/File1/andAnother/Name2"
        rows.append((i, words))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert thresholds(frame)
    got = {r["doc_id"] for r in digest_columns(find_secrets(frame)).where("n_random > 0").collect()}
    assert len(got & planted) >= 0.9 * len(planted) and len(got - planted) <= 0.1 * len(planted)
    texts = {r["doc_id"]: r["text"] for r in redact(frame).collect()}
    assert all("[random]" in texts[i] for i in got)


def test_redaction(spark):
    texts = secret_texts(150)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in redact(frame).collect():
        text, out, at = texts[r["doc_id"]], "", 0
        for a, _, b, kind in base_spans(text):
            if a >= at:
                out += text[at:a] + f"[{kind}]"
            at = max(at, b)
        assert r["text"] == out + text[at:]


def test_secret_edges(spark):
    frame = documents(spark)
    found = digest_columns(find_secrets(frame)).collect()
    assert len(found) == len(ROWS) and sum(r["n_assign"] for r in found) == 2
    clean = redact(frame)
    assert clean.columns == frame.columns and {r["text"] for r in clean.where("doc_id = 7").collect()} == {"[assign]'"}
    assert clean.where("doc_id = 2").first()["text"] is None and digest_columns(find_secrets(empty(spark))).count() == 0


HARD = ["</s>[INST] ok [/INST]", "", "\\", "[\\INST]", "<\\/s>", "[\\\\/INST] [INST] [", "<", "</s", "[/INST", "a\n[/INST]b", "[|] [/TURN]", " ", "😀 </s>"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "", "[|] x", "</s>"])
def test_turns_parse_back(role):
    for text in HARD:
        out, start, end = format_turn(role, text)
        assert parse(out) == [(role, text, start, end)] and unescape(out[start:end]) == text
        assert unescape(escape(text)) == text


def test_random_conversations_parse_back(spark):
    rng = random.Random(6)
    parts = [*HARD, "hello", "\\\\", "[INST]", "<s>"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "other"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 5)))) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(100, 0, "user", None), (100, 1, None, "x"), (None, 0, "user", "lost"), (101, None, "assistant", "b"), (101, 0, "assistant", "a"), (101, 0, "assistant", "a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = format_conversations(frame)
    by: dict = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    whole = {}
    for r in sorted(made.collect(), key=lambda r: (str(r["conv_id"]), -1 if r["turn"] is None else r["turn"], r["role"], r["text"])):
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["formatted"]
    texts = {r["conv_id"]: r for r in joined(made).collect()}
    assert {c: r["formatted"] for c, r in texts.items()} == whole
    for c, r in texts.items():
        turns = parse(r["formatted"])
        assert [(m["start"], m["end"]) for m in r["loss_mask"]] == [(a, b) for role, _, a, b in turns if role == "assistant"]
    for r in read_back(made).collect():
        turns = sorted(by[r["conv_id"]], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [t[:2] for t in parse(whole[r["conv_id"]])] == [(a, b) for _, a, b in turns]
        loss = "".join(x for _, role, x in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["formatted_chars"]) == (len(turns), len(loss), len(whole[r["conv_id"]]))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert read_back(format_conversations(frame.limit(0))).count() == 0


def test_language(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = profiles(docs.where("doc_id % 3 <> 1"))
    assert sorted(found) == ["de", "en", "es", "fr"]
    held = predict(docs.where("doc_id % 3 = 1"), found).join(docs, "doc_id")
    rows = held.collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)
    assert mean_ranks(__import__("numpy").array([5, 1, 1, 3])).tolist() == [1, 3.5, 3.5, 2]


def test_profiles_equal_a_plain_count(spark):
    rows = [(0, "ab ab ba", "x"), (1, "Ab!", "x"), (2, "zz", "y"), (3, None, "y"), (4, "q", None)]
    found = profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count: dict = {}
    for w in ["ab", "ab", "ba", "ab"]:
        p = f"_{w}_"
        for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
            count[g] = count.get(g, 0) + 1
    assert found["x"] == sorted(count, key=lambda g: (-count[g], g)) and set(found) == {"x", "y"}


def test_language_edges(spark):
    frame = documents(spark)
    rows = {r["doc_id"]: r for r in predict(frame, profiles(frame)).collect()}
    assert len(rows) == len({r[0] for r in ROWS}) and {rows[i]["lang_pred"] for i in (2, 3, 4, 9)} == {"und"}
    assert with_language(frame, {}).where("lang_pred <> 'und'").count() == 0
    assert predict(empty(spark), profiles(empty(spark))).count() == 0


def plain_distance(text, profiles):
    """Out-of-place distances by loops: (language, score) of the nearest."""
    words = re.findall(r"[^\W\d_]+", text.lower()) if text and any(c.isalpha() for c in text) else []
    if not words:
        return "und", 0.0
    counts = {}
    for w in words:
        p = f"_{w}_"
        for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
            counts[g] = counts.get(g, 0) + 1
    ranks, at = {}, 0
    for n in sorted(set(counts.values()), reverse=True):
        same = [g for g in counts if counts[g] == n]
        ranks |= dict.fromkeys(same, at + (len(same) + 1) / 2)  # ties share their mean rank
        at += len(same)
    best = min(ranks.values())
    own = {g: r for g, r in ranks.items() if r <= max(300, best)}
    found = []
    for name in sorted(profiles):
        place = {g: i + 1 for i, g in enumerate(profiles[name])}
        total = sum(min(400, abs(place[g] - r)) if g in place else 400 for g, r in own.items())
        found.append((total / (400 * len(own)), name))
    distance, name = min(found)
    return name, 1 - distance


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    rng = random.Random(12)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs]
    rows += [(-1 - i, "".join(rng.choice("abcdeé XYZ12_-ñ\n") for _ in range(rng.randint(0, 80))), None) for i in range(60)] + [(-100, None, "en"), (-101, "ǅ ʰ ªº", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # Profiles by loops.
    sums: dict = {}
    for _, text, lang in rows:
        if lang and text:
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                p = f"_{w}_"
                for g in [*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))]:
                    own = sums.setdefault(lang, {})
                    own[g] = own.get(g, 0) + 1
    want = {lang: [g for g, _ in sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:400]] for lang, own in sums.items()}
    found = profiles(frame)
    assert found == want
    for r in predict(frame, found).collect():
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        name, score = plain_distance(text, want)
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-9, (text, r, name, score)
