"""The randomness battery against plain Python, and what it finds of planted strings."""

import math
import random
import re
import string
import time
from collections import Counter

from pyspark.sql import functions as F
from test_scans import base_spans

from ctxforge.llm import secrets as S


def words_counts(texts):
    pairs = Counter()
    for t in texts:
        for w in re.split("[^a-z0-9]+", (t or "").lower()):
            if 2 <= len(w) < 16:
                pairs.update(w[i : i + 2] for i in range(len(w) - 1))
    return pairs


def text_log_p(tok, pairs):
    symbols = string.ascii_lowercase + string.digits
    row = {a: sum(pairs[a + b] + 0.5 for b in symbols) for a in symbols}
    total = sum(row.values())
    surprise = {a + b: -math.log((pairs[a + b] + 0.5) / row[a]) for a in symbols for b in symbols}
    low = tok.lower()
    s = sum(surprise[low[i : i + 2]] for i in range(len(low) - 1))
    best = 0.0
    for i in range(1, 20):
        t = i / 20
        k = math.log(sum((pairs[ab] + 0.5) / total * math.exp(t * v) for ab, v in surprise.items()))
        best = min(best, (len(tok) - 1) * k - t * s)
    return best


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def encoded(tok):
    """(alphabet, symbols) of a candidate, or None."""
    plain = re.sub("[+/_-]", "", tok)
    lower, upper = string.ascii_lowercase, string.ascii_uppercase
    has = [any(c in tok for c in some) for some in (lower, upper, string.digits)]
    if not has[0] and not has[1]:
        return None
    if has[0] and has[1]:
        if has[2] or plain != tok:
            return upper + lower + string.digits + "+/", tok.replace("-", "+").replace("_", "/")
        return upper + lower, plain
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", plain):
        return string.digits + "abcdef", plain.lower()
    if not has[2]:
        return lower, plain.lower()
    if re.fullmatch("[A-Z2-7]+", plain):
        return upper + "234567", plain
    return string.digits + lower, plain.lower()


def looks_random(alphabet, sym):
    n, k = len(sym), len(alphabet)
    chi2 = k / n * sum(c * c for c in Counter(sym).values()) - n
    d = k - 1
    p1 = tail(((chi2 / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)))
    bits = [alphabet.index(c) >= k // 2 for c in sym]
    ones, runs = sum(bits), 1 + sum(a != b for a, b in zip(bits, bits[1:]))
    both = 2 * ones * (n - ones)
    spread = both * (both - n) / (n * n * (n - 1))
    z2 = 12.0 if not ones or ones == n or spread <= 0 else abs(runs - both / n - 1) / math.sqrt(spread)
    values = [alphabet.index(c) for c in sym]
    mean = sum(values) / n
    square = sum((v - mean) ** 2 for v in values)
    z3 = 12.0 if square == 0 else abs(sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / square + 1 / n) * math.sqrt(n)
    x = max(0.0, -(math.log(p1) + math.log(2 * tail(z2)) + math.log(2 * tail(z3))))
    return math.exp(-x) * (1 + x + x * x / 2) >= 0.001


def brute(texts):
    """Spans of every text by loops."""
    pairs, tested = words_counts(texts), {}
    for i, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", t):
            own = [(m.start(), m.end(), True)]
            if re.search("[+/_-]", m[0]):
                own += [(m.start() + p.start(), m.start() + p.end(), False) for p in re.finditer("[A-Za-z0-9]{16,}", m[0])]
            for a, b, whole in own:
                found = encoded(t[a:b])
                if found and len(found[1]) >= 16:
                    size = max(x for x in (16, 20, 24, 28, 32, 40, 64, 128) if x <= len(found[1]))
                    bin_ = min(600, math.floor(-10 / math.log(10) * text_log_p(re.sub("[+/_-]", "", t[a:b]), pairs)))
                    tested.setdefault((i, m.start()), []).append((a, b, whole, size, bin_, looks_random(*found)))
    accept = {}
    for size in {r[3] for rows in tested.values() for r in rows}:
        bins = sorted((r[4] for rows in tested.values() for r in rows if r[3] == size), reverse=True)
        for rank, b in enumerate(bins, 1):
            rank = sum(x >= b for x in bins)
            if 10 ** (-b / 10) <= 0.01 * rank / len(bins):
                accept[size] = b
    out = []
    for i, t in enumerate(texts):
        spans = [(a, r, b, k) for a, r, b, k in base_spans(t)]
        for (j, _), rows in sorted(tested.items()):
            if j == i:
                good = [r for r in rows if r[5] and r[3] in accept and r[4] >= accept[r[3]]]
                for a, b, *_ in [r for r in good if not r[2]] or good:
                    if not any(x <= a and b <= y for x, _, y, _ in base_spans(t)):
                        spans.append((a, 3, b, "random"))
        out.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)))
    return out, accept


def mixed_texts(rng, n):
    syllables = ["the", "ing", "tion", "er", "an", "or", "re", "st", "in", "le", "café", "data", "path"]
    parts = []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 5))) for _ in range(30)]
        words += [rng.choice(["someLongCamelCaseName", "path/to/the/file_name", "a-b-c-d-e-f-g-h-i-j-k", "2024-01-02-03-04-05-06", "x" * 30, "password: abcdefghijklm", "AKIAABCDEFGHIJKLMN"]) for _ in range(2)]
        if i % 3 == 0:
            alphabet = rng.choice([string.ascii_letters + string.digits, string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + "234567", string.ascii_lowercase])
            words.append(rng.choice(["", "sk-live-", "conf/", "token="]) + "".join(rng.choice(alphabet) for _ in range(rng.choice([15, 16, 20, 32, 50, 200]))) + rng.choice(["", "/end", "."]))
        rng.shuffle(words)
        parts.append(" ".join(words))
    return parts


def test_equals_brute_force(spark):
    texts = mixed_texts(random.Random(17), 240)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want, accept = brute(texts)
    assert S.thresholds(frame) == accept and accept
    got = {r["doc_id"]: r["spans"] for r in S.digest_columns(S.find_secrets(frame)).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert sum("random" in w for w in want) > 40


def test_tail(spark):
    zs = [x / 4 for x in range(-48, 49)]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.log_upper(F.col("z")).alias("p")).collect()
    for r in rows:
        assert abs(r["p"] - math.log(tail(r["z"]))) <= 0.0001 * max(1e-6, abs(math.log(tail(r["z"])))) + 1e-7, r


def test_recall_by_encoding_and_length(spark):
    """In a corpus where one candidate in five or so is random, strings of 16 to 64 symbols are found."""
    rng, rows = random.Random(5), []
    alphabets = {"HEX": "0123456789ABCDEF", "base26": string.ascii_lowercase, "base32": string.ascii_uppercase + "234567", "base36": string.ascii_lowercase + string.digits, "base52": string.ascii_letters, "base64": string.ascii_letters + string.digits + "+/"}
    for name, alphabet in alphabets.items():
        for n in (16, 20, 32, 64):
            for _ in range(25):
                rows.append((f"{name}-{n}", "of the words " + "".join(rng.choice(alphabet) for _ in range(n)) + " in some text"))
    for _ in range(100):
        rows.append(("uuid", "id " + "-".join("".join(rng.choice("0123456789abcdef") for _ in range(k)) for k in (8, 4, 4, 4, 12))))
        rows.append(("prefixed", "key sk-live-" + "".join(rng.choice(alphabets["base36"]) for _ in range(24))))
        rows.append(("path", "see config/files/" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(24)) + "/name"))
    clean = [("clean", t) for t in (" ".join(rng.choice(["understandableconsequences", "path/to/another/file", "internationalisation", "well-known-and-often-used", "someLongCamelCaseName", "NORMALISATIONSOFTHINGS"]) for _ in range(5)) for _ in range(600))]
    clean += [("words", "understandable consequences of another path to a file international realisation is well known and often used some long camel case name normal") for _ in range(300)]
    frame = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows + clean)], "doc_id long, kind string, text string")
    found = S.digest_columns(S.find_secrets(frame)).join(frame.select("doc_id", "kind"), "doc_id")
    recall = {r["kind"]: r["r"] for r in found.groupBy("kind").agg(F.avg((F.col("n_random") > 0).cast("int")).alias("r")).collect()}
    assert recall.pop("clean") <= 0.01 and recall.pop("words") == 0
    assert min(recall.values()) >= 0.9, recall


def test_many_matches_in_one_text(spark):
    text = "token=abcdefghijkl " * 40_000
    frame = spark.createDataFrame([(0, text)], "doc_id long, text string")
    began = time.perf_counter()
    row = S.digest_columns(S.find_secrets(frame)).first()
    assert row["n_assign"] == 40_000 and row["spans"].endswith(f"assign:{19 * 39_999}:{19 * 39_999 + 18}")
    assert S.redact(frame).first()["text"] == "[assign] " * 40_000
    assert time.perf_counter() - began < 25  # a quadratic walk takes minutes
