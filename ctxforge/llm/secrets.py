"""Secret scan: fixed patterns plus a randomness test battery, in built-in functions only.

Base kinds are assignments, access keys and hexadecimal strings. The battery adds "random" spans. Its candidates
are runs of 16 or more characters of the base-64 alphabets, each alphanumeric part of that length within a run
with separators, and the run as a whole. A candidate's encoding is inferred from its characters: hexadecimal
or base 26, 32, 36, 52 or 64 (one-case candidates lose their separators; numbers are not tested). Its symbols undergo a
chi-squared test of alphabet uniformity, a runs test about the alphabet's middle and a lag-one serial
correlation test; Fisher's method combines the three, and a combined p below REJECT says "not random".

Short strings pass such tests too easily, so passing is not enough: a candidate must also be unlike text. The text
model is the corpus's own: how often a letter or digit follows another within words shorter than candidates, over all
documents, without case.
The p-value of "this is text" is Chernoff's bound on the candidate's summed surprise under that model; it falls with
the length, so it is comparable between lengths. Within a class of lengths, these p-values, counted over the whole
corpus in tenths of a decade, go through the Benjamini-Hochberg step-up at FDR, which bounds the share of text among
the candidates reported. Symbol pairs (at most 1,296 rows) and the counts (a few thousand rows) alone reach the driver.

A run is reported by its accepted parts or, if there are none, as a whole; spans within base spans are left out.

Edge cases: null texts are empty and have no spans; ids may be null or repeated, each row is scanned; empty
tables give no rows; a corpus without words has an even text model, under which nothing is random; other columns
are not read (redact keeps them, whatever their names). Spans are code points, end exclusive. Arrays of matches are
walked in blocks, so the work grows with the power 1.5 of the matches of a text.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ctxforge.llm.common import all_columns, documents, quoted

#: Base patterns: (kind, pattern, group that must have the length, least length).
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]{16,}", 0, 16))
#: Length of the shortest candidate; runs, and parts of a run between separators.
SHORTEST = 16
RUN, PART = rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}", rf"[A-Za-z0-9]{{{SHORTEST},}}"
#: Alphabets by encoding.
ALPHABETS = {
    "hex": string.digits + "abcdef",
    "base26": string.ascii_lowercase,
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "base52": string.ascii_uppercase + string.ascii_lowercase,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
#: Symbols of the text model, and the tilts at which Chernoff's bound is tried.
SYMBOLS = string.ascii_lowercase + string.digits
TILTS = tuple(i / 20 for i in range(1, 20))
#: Lower bounds of the length classes.
LENGTHS = (16, 20, 24, 28, 32, 40, 64, 128)
REJECT, FDR, MOST_BIN = 0.001, 0.01, 600
_SPAN = "struct<start:int,end:int,tok:string>"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(rows: Column, zero: Column, step, row_type: str) -> Column:
    """step(state, row) -> (next state, value) over an array from left to right; the array of values, of row_type, and the
    last state. Values are gathered in blocks of about the root of their number, since an array is copied when it grows."""
    none = F.array().cast(f"array<{row_type}>")
    blocks = F.array().cast(f"array<array<{row_type}>>")

    def one(state, row):
        after, value = step(state["state"], row)
        return F.struct(after.alias("state"), F.array_append(state["out"], value).alias("out"))

    def walk(x):
        rows, size = x["rows"], x["size"]

        def block(state, i):
            inner = F.aggregate(F.slice(rows, i * size + 1, size), F.struct(state["state"].alias("state"), none.alias("out")), one)
            return let(inner, lambda x: F.struct(x["state"].alias("state"), F.array_append(state["out"], x["out"]).alias("out")))

        starts = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int"))
        last = F.aggregate(starts, F.struct(zero.alias("state"), blocks.alias("out")), block)
        return let(last, lambda s: F.struct(s["state"].alias("state"), F.flatten(s["out"]).alias("out")))

    empty = F.struct(zero.alias("state"), none.alias("out"))
    return let(rows, lambda rows: F.when(F.size(rows) > 0, let(F.struct(rows.alias("rows"), F.ceil(F.sqrt(F.size(rows))).cast("int").alias("size")), walk)).otherwise(empty))


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<start,end,tok>> of the matches whose group has the length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    sizes = F.transform(part, lambda p: F.length(p))
    found = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda g: F.length(g)).alias("gap"), whole.alias("tok"), sizes.alias("size"))

    def step(at, row):
        start = at + row["gap"]
        end = start + F.length(row["tok"])
        return end, F.struct(start.alias("start"), end.alias("end"), F.when(row["size"] >= least, row["tok"]).alias("tok"))

    def placed(rows):
        return F.filter(scan(F.filter(rows, lambda r: r["tok"].isNotNull()), F.lit(0), step, _SPAN)["out"], lambda s: s["tok"].isNotNull())

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(f"array<{_SPAN}>"))


def log_upper(z: Column) -> Column:
    """Natural logarithm of the standard normal's upper tail, to a part in a million anywhere."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    # Coefficients of the rational approximation of erfc with fractional error below 1.2e-7.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = F.lit(0.0)
    for term in reversed(terms):
        poly = poly * t + term
    log_half = F.log(t) - x * x + poly - math.log(2)
    return F.when(z >= 0, log_half).otherwise(F.log1p(-F.exp(log_half)))


def _choose(enc: Column, values: dict) -> Column:
    out = F.lit(None)
    for name, value in values.items():
        out = F.when(enc == name, F.lit(value)).otherwise(out)
    return out


class TextModel:
    """Surprise of each symbol after another in ordinary words, and its cumulants for Chernoff's bound."""

    def __init__(self, counts: dict[str, int]):
        k = len(SYMBOLS)
        n = [[counts.get(a + b, 0) + 0.5 for b in SYMBOLS] for a in SYMBOLS]
        total = sum(map(sum, n))
        self.surprise = [-math.log(x / sum(row)) for row in n for x in row]
        joint = [x / total for row in n for x in row]
        self.cumulants = [math.log(sum(p * math.exp(t * s) for p, s in zip(joint, self.surprise))) for t in TILTS]
        self.index = [SYMBOLS.find(chr(c).lower()) if chr(c).lower() in SYMBOLS else 0 for c in range(128)]
        self.k = k

    def log_p(self, tok: Column) -> Column:
        """Bound on the logarithm of the probability that text is as surprising as tok, whose characters are SYMBOLS."""
        codes = F.transform(F.filter(F.split(tok, ""), lambda c: c != ""), lambda c: F.get(F.lit(self.index), F.ascii(c)))

        def bound(x):
            pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.get(F.lit(self.surprise), a * self.k + b))
            total = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
            return let(F.struct(total.alias("s"), (F.size(x) - 1).alias("n")), lambda v: F.least(F.lit(0.0), *(v["n"] * c - v["s"] * t for t, c in zip(TILTS, self.cumulants))))

        return let(codes, bound)


def fit_text(texts: DataFrame, text_col: str = "text") -> TextModel:
    """The text model of all words shorter than a candidate, counted over the whole corpus."""
    words = texts.select(F.explode(F.split(F.lower(F.col(quoted(text_col))), "[^a-z0-9]+")).alias("word"))
    words = words.where(F.length("word").between(2, SHORTEST - 1)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("pair"), "n")
    return TextModel({r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()})


def candidates(run: Column) -> Column:
    """array<struct<start,end,tok,whole>>: a run, and its parts if it has separators."""

    def row(s, at, whole):
        return F.struct((at + s["start"]).alias("start"), (at + s["end"]).alias("end"), s["tok"].alias("tok"), F.lit(whole).alias("whole"))

    parts = F.transform(spans(run["tok"], PART, 0, SHORTEST), lambda s: row(s, run["start"], False))
    whole = F.array(row(run, F.lit(0), True))
    return F.when(run["tok"].rlike("[+/_-]"), F.concat(whole, parts)).otherwise(whole)


def battery(found: Column, model: TextModel) -> Column:
    """array<struct<start,end,whole,class,bin,random>> of the candidates whose encoding can be inferred."""

    def infer(r):
        tok = r["tok"]
        letters, low, high, digit = (tok.rlike(p) for p in ("[A-Za-z]", "[a-z]", "[A-Z]", "[0-9]"))
        plain = F.regexp_replace(tok, "[+/_-]", "")
        single = F.when(plain.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(~digit, "base26").when(plain.rlike("^[A-Z2-7]+$"), "base32").otherwise("base36")
        enc = F.when(~letters, F.lit(None)).when(~(low & high), single).when(digit | tok.rlike("[+/_-]"), "base64").otherwise("base52")
        return F.struct(r["start"], r["end"], r["whole"], tok.alias("tok"), plain.alias("plain"), enc.alias("enc"))

    def read(r):
        enc = r["enc"]
        sym = F.when(enc.isin("hex", "base26", "base36"), F.lower(r["plain"])).when(enc == "base64", F.translate(r["tok"], "-_", "+/")).otherwise(r["plain"])
        halves = {e: "0" * (len(a) // 2) + "1" * (len(a) - len(a) // 2) for e, a in ALPHABETS.items()}
        return F.struct(r["start"], r["end"], r["whole"], r["plain"], enc.alias("enc"), sym.alias("sym"), F.length(sym).cast("double").alias("n"), _choose(enc, ALPHABETS).alias("alphabet"), _choose(enc, halves).alias("halves"), _choose(enc, {e: float(len(a)) for e, a in ALPHABETS.items()}).alias("k"))

    def measure(r):
        equal = F.regexp_extract_all(F.array_join(F.array_sort(F.split(r["sym"], "")), ""), F.lit(r"(.)\1*"), F.lit(0))
        squares = F.aggregate(equal, F.lit(0.0), lambda s, c: s + F.length(c) * F.length(c))
        bits = F.call_function("translate", r["sym"], r["alphabet"], r["halves"])
        values = F.transform(F.filter(F.split(r["sym"], ""), lambda c: c != ""), lambda c: F.call_function("locate", c, r["alphabet"]).cast("double"))
        return F.struct(
            r["start"], r["end"], r["whole"], r["plain"], r["n"], r["k"], values.alias("values"),
            (r["k"] / r["n"] * squares - r["n"]).alias("chi2"),
            F.length(F.replace(bits, F.lit("0"), F.lit(""))).cast("double").alias("ones"),
            F.length(F.regexp_replace(bits, "0+|1+", "x")).cast("double").alias("runs"),
            (F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / r["n"]).alias("mean"),
        )

    def correlate(r):
        square = F.aggregate(r["values"], F.lit(0.0), lambda s, v: s + (v - r["mean"]) * (v - r["mean"]))
        pairs = F.zip_with(F.slice(r["values"], F.lit(1), r["n"].cast("int") - 1), F.slice(r["values"], F.lit(2), r["n"].cast("int") - 1), lambda a, b: (a - r["mean"]) * (b - r["mean"]))
        lag = F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)
        zeros, both = r["n"] - r["ones"], 2 * r["ones"] * (r["n"] - r["ones"])
        mean, spread = both / r["n"] + 1, both * (both - r["n"]) / (r["n"] * r["n"] * (r["n"] - 1))
        d = r["k"] - 1
        wilson = (F.pow(F.greatest(r["chi2"], F.lit(0.0)) / d, F.lit(1 / 3)) - (1 - 2 / (9 * d))) / F.sqrt(2 / (9 * d))
        return F.struct(
            r["start"], r["end"], r["whole"], r["n"],
            wilson.alias("z1"),
            F.when((r["ones"] == 0) | (zeros == 0) | (spread <= 0), 12.0).otherwise(F.abs(r["runs"] - mean) / F.sqrt(spread)).alias("z2"),
            F.when(square == 0, 12.0).otherwise(F.abs(lag / square + 1 / r["n"]) * F.sqrt(r["n"])).alias("z3"),
            model.log_p(r["plain"]).alias("log_p"),
        )

    def combine(r):
        x = -(log_upper(r["z1"]) + log_upper(r["z2"]) + log_upper(r["z3"]) + 2 * math.log(2))  # half of Fisher's sum; two tests are two-sided
        low = F.lit(LENGTHS[0])
        for bound in LENGTHS[1:]:
            low = F.when(r["n"] >= bound, bound).otherwise(low)
        bin_ = F.least(F.lit(MOST_BIN), F.floor(r["log_p"] * (-10 / math.log(10)))).cast("int")
        return F.struct(r["start"], r["end"], r["whole"], low.alias("class"), bin_.alias("bin"), let(F.greatest(x, F.lit(0.0)), lambda v: F.exp(-v) * (1 + v + v * v / 2) >= REJECT).alias("random"))

    found = F.filter(F.transform(F.filter(F.transform(found, infer), lambda r: r["enc"].isNotNull()), read), lambda r: r["n"] >= SHORTEST)
    for stage in (measure, correlate, combine):
        found = F.transform(found, stage)
    return found


def thresholds(texts: DataFrame, text_col: str = "text", model: TextModel | None = None) -> dict[int, int]:
    """Least bin that the step-up accepts for each class of lengths, from all candidates of the corpus."""
    text = F.col(quoted(text_col))
    runs = texts.where(text.rlike(RUN)).select(F.explode(spans(text, RUN, 0, SHORTEST)).alias("run"))
    model = model or fit_text(texts, text_col)
    counted = runs.select(F.explode(battery(candidates(F.col("run")), model)).alias("r")).groupBy("r.class", "r.bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, list] = {}
    for r in counted.collect():  # at most MOST_BIN + 1 rows for each class
        by.setdefault(r["class"], []).append((r["bin"], r["n"]))
    return {low: least for low, bins in by.items() if (least := step_up(bins)) is not None}


def step_up(bins: list[tuple[int, int]]) -> int | None:
    """The least bin (of p-values 10 ** (-bin / 10) at most) that Benjamini and Hochberg's procedure accepts."""
    total, seen, found = sum(n for _, n in bins), 0, None
    for b, n in sorted(bins, reverse=True):
        seen += n
        if 10 ** (-b / 10) <= FDR * seen / total:
            found = b
    return found


def all_spans(text: Column, accept: dict[int, int], model: TextModel) -> Column:
    """array<struct<start,rank,end,kind>> in order: base kinds, then random ones outside of them."""
    kind_of = "struct<start:int,rank:int,end:int,kind:string>"

    def named(found, rank, kind):
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*(named(spans(text, p, g, least), i, kind) for i, (kind, p, g, least) in enumerate(BASE)))
    if not accept:
        return F.array_sort(base)

    def good(r):
        return r["random"] & (r["bin"] >= F.coalesce(_choose(r["class"], accept).cast("int"), F.lit(MOST_BIN + 1)))

    def chosen(found):
        parts = F.filter(found, lambda r: ~r["whole"])
        return F.when(F.size(parts) > 0, parts).otherwise(found)

    runs = F.transform(spans(text, RUN, 0, SHORTEST), lambda run: let(F.filter(battery(candidates(run), model), good), chosen))
    more = F.when(text.rlike(RUN), named(F.flatten(runs), len(BASE), "random")).otherwise(F.array().cast(f"array<{kind_of}>"))

    def step(covered, s):
        """A random span within an earlier base span (their order is by start, then rank) loses its kind."""
        own = s["rank"] < len(BASE)
        kind = F.when(own | (s["end"] > covered), s["kind"])
        return F.when(own, F.greatest(covered, s["end"])).otherwise(covered), F.struct(s["start"], s["rank"], s["end"], kind.alias("kind"))

    def outside(rows):
        return F.filter(scan(rows, F.lit(0), step, kind_of)["out"], lambda s: s["kind"].isNotNull())

    return let(F.array_sort(F.concat(base, more)), outside)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): found is the ordered span array of the row's text."""
    model = fit_text(docs, text_col)
    accept = thresholds(docs, text_col, model)
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), all_spans(F.coalesce(F.col(quoted(text_col)), F.lit("")), accept, model).alias("found"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span (overlapping ones merged) replaced by [kind of the first]."""
    model = fit_text(docs, text_col)
    accept = thresholds(docs, text_col, model)
    piece = "struct<from:int,to:int,kind:string>"

    def step(at, s):
        return F.greatest(at, s["end"]), F.struct(at.alias("from"), s["start"].alias("to"), F.when(s["start"] >= at, s["kind"]).alias("kind"))

    def cut(text, found):
        """Text in front of each span, and the span's mark: blocks of pieces are cut from the text, pieces from blocks."""

        def block(pieces):
            first, last = F.element_at(pieces, 1)["from"], F.element_at(pieces, -1)["to"]
            own = F.substr(text, first + 1, last - first)
            return let(F.struct(own.alias("own"), first.alias("first"), pieces.alias("pieces")), lambda b: F.array_join(F.transform(b["pieces"], lambda p: F.concat(F.substr(b["own"], p["from"] - b["first"] + 1, p["to"] - p["from"]), F.lit("["), p["kind"], F.lit("]"))), ""))

        def joined(pieces):
            size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / size).cast("int")), lambda i: F.slice(pieces, i * size + 1, size))
            return F.array_join(F.transform(blocks, block), "")

        walked = scan(found, F.lit(0), step, piece)
        return let(walked, lambda w: F.concat(let(F.filter(w["out"], lambda p: p["kind"].isNotNull()), joined), F.substr(text, w["state"] + 1)))

    rows = docs.select(F.struct(*all_columns(docs)).alias("row"), F.col(quoted(text_col)).alias("text"))
    rows = rows.withColumn("found", all_spans(F.coalesce("text", F.lit("")), accept, model))
    clean = F.when(F.size("found") > 0, cut(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    return rows.select(*((clean if c == text_col else F.col(f"row.{quoted(c)}")).alias(c) for c in docs.columns))


def digest_columns(found: DataFrame) -> DataFrame:
    def joined(rows):
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["rank"] < len(BASE))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"), count("random"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(find_secrets(documents(spark, sf_dir)))
