"""Language identification by rank-order n-gram profiles.

A language's profile lists its most frequent letter n-grams (one to three characters, words padded
with "_") in order. A document's n-grams are ranked by frequency, ties sharing their mean rank, and the
out-of-place distance to a language sums, over the document's n-grams, how far each is from its place
in the profile, or the profile's length where it is missing. The nearest language wins.

Edge cases: a null text, or one without a letter, is "und" with score 0; equally near languages go to the
smaller name; training rows without language or letters add nothing; with no training row at all every
document is "und"; repeated rows are scored each; ids may be null; other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections import defaultdict
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ctxforge.llm.common import crc_mod, documents, give_back, quoted, small_batches

#: Places in a language's profile and in a document's.
PROFILE, OWN = 400, 300
WORD = re.compile(r"[^\W\d_]+")
#: Characters that are no letters, of one text, that are replaced one by one.
BETWEEN = 64
#: A document that shares less with every profile may be rejected.
REJECT = 0.3
#: Words and n-grams that a worker remembers before it starts anew.
WORDS, GRAMS = 300_000, 1_000_000


class Grams:
    """Numbers n-grams as they appear, after the ones given; words are looked up whole."""

    def __init__(self, first=()):
        self.first = list(first)
        self.reset()

    def reset(self) -> None:
        self.ids: dict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        for g in self.first:
            self.ids[g]  # noqa: B018  numbers it
        self.words: dict[str, bytes] = {}

    def full(self) -> bool:
        return len(self.words) > WORDS or len(self.ids) > GRAMS

    def of(self, words: list[str]) -> np.ndarray:
        known, ids = self.words, self.ids
        for w in set(words).difference(known):
            p = f"_{w}_"
            two = list(map(add, p, p[1:]))
            known[w] = array("I", map(ids.__getitem__, [*w, *two, *map(add, two, p[2:])])).tobytes()
        return np.frombuffer(b"".join(map(known.__getitem__, words)), np.uintc)


def words_of(text: str | None) -> list[str]:
    """Runs of letters (and marks of number that are no digits) of a text that has a letter."""
    if not text or not any(map(str.isalpha, text)):
        return []
    text = text.lower()
    # What is between the words is a few characters in most texts, and cheaper to replace than to match.
    between = WORD.sub("", "".join(set(text)))
    if len(between) > BETWEEN:
        return WORD.findall(text)
    for c in between:
        text = text.replace(c, " ")
    return text.split()


def gram_counts(train: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, gram, n) over all rows: summed within each task, then over tasks."""

    def scan(batches):
        grams, counts = Grams(), {}

        def rows():
            names = list(grams.ids)
            for lang, n in counts.items():
                at = np.flatnonzero(n)
                for i in range(0, len(at), 50_000):
                    some = at[i : i + 50_000]
                    yield pa.record_batch({"lang": pa.array([lang] * len(some), pa.string()), "gram": pa.array([names[k] for k in some.tolist()], pa.string()), "n": pa.array(n[some])})

        for batch in batches:
            by: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by[lang] += words_of(text)
            for lang, words in by.items():
                n = np.bincount(grams.of(words), minlength=len(grams.ids)).astype(np.int64)
                old = counts.get(lang, n[:0])
                n[: len(old)] += old
                counts[lang] = n
            if grams.full():
                yield from rows()
                grams.reset()
                counts = {}
        yield from rows()
        grams.reset()
        give_back()

    own = train.where(F.col(quoted(lang_col)).isNotNull()).select(F.col(quoted(lang_col)).cast("string").alias("lang"), F.col(quoted(text_col)).alias("text"))
    found = own.mapInArrow(scan, "lang string, gram string, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def profiles(train: DataFrame, lang_col: str = "lang", text_col: str = "text", places: int = PROFILE) -> dict[str, list[str]]:
    """Language -> its n-grams by falling frequency, ties in order. As many rows as languages have places."""
    small_batches(train.sparkSession)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(train, lang_col, text_col).withColumn("place", F.row_number().over(order)).where(F.col("place") <= places)
    found: dict[str, list[str]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    return found


def mean_ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each count from 1, the largest first; equal counts share their mean rank."""
    size = np.bincount(counts)[::-1]
    mean = np.cumsum(size) - size + (size + 1) / 2
    return mean[::-1][counts]


def with_language(docs: DataFrame, found: dict[str, list[str]], text_col: str = "text", places: int = PROFILE, added: tuple[str, str, str] = ("lang_pred", "score", "margin")) -> DataFrame:
    """docs with lang_pred, score and margin under the names added: score is 1 for a document whose ranks
    equal the profile's and 0 for one that shares no n-gram with it; margin is the lead over the next
    language. Columns that have these names are replaced."""
    small_batches(docs.sparkSession)
    names = sorted(found)

    def scan(batches):
        known = sorted({g for grams in found.values() for g in grams})
        at = {g: i for i, g in enumerate(known)}
        place = np.full((len(names), len(known) + 1), np.nan)
        for k, name in enumerate(names):
            for r, g in enumerate(found[name]):
                place[k, at[g]] = r + 1
        grams = Grams(known)

        def best(text):
            words = words_of(text) if names else []
            if not words:
                return "und", 0.0, 0.0
            ids, counts = np.unique(grams.of(words), return_counts=True)
            ranks = mean_ranks(counts)
            inside = ranks <= max(OWN, ranks.min())
            own, ids = ranks[inside], np.minimum(ids[inside], len(known))
            off = np.abs(place[:, ids] - own)
            total = np.where(np.isnan(off), places, np.minimum(off, places)).sum(1) / (places * len(own))
            order = np.argsort(total, kind="stable")
            lead = float(total[order[1]] - total[order[0]]) if len(names) > 1 else 1.0
            return names[order[0]], float(1 - total[order[0]]), lead

        for batch in batches:
            rows = [best(t) for t in batch.column(0).field(at_text).to_pylist()]
            if grams.full():
                grams.reset()
            lang, score, lead = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())], ["row", "lang", "score", "lead"])
        grams.reset()
        give_back()

    names_added = {a.lower() for a in added}
    others = [c for c in docs.columns if c.lower() not in names_added or c == text_col]
    at_text = others.index(text_col)
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in others)).alias("row"))  # names within it are free
    kinds = (("lang", T.StringType()), ("score", T.DoubleType()), ("lead", T.DoubleType()))
    found_rows = rows.mapInArrow(scan, T.StructType([rows.schema["row"], *(T.StructField(n, t) for n, t in kinds)]))
    return found_rows.select(*(F.col(f"row.{quoted(c)}").alias(c) for c in others), *(F.col(n).alias(a) for (n, _), a in zip(kinds, added)))


def predict(docs: DataFrame, found: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, margin), see with_language."""
    own = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text"))
    return with_language(own, found).select("doc_id", "lang_pred", "score", "margin")


#: Parts of the range of scores that are counted to find a quantile.
PARTS = 4096


def low_score(scores: DataFrame, share: float = 0.001) -> float | None:
    """The exact quantile (interpolated as percentile() does) of column score, from 0 to 1, over all rows; null scores do not count. Rows are
    counted by parts of the range, then by score within the one or two parts that hold it: no task or driver sees all scores."""
    part = F.least(F.floor(F.col("score") * PARTS), F.lit(PARTS - 1)).alias("part")
    counts = sorted((r["part"], r["count"]) for r in scores.where("score IS NOT NULL").groupBy(part).count().collect())
    total = sum(n for _, n in counts)
    if not total:
        return None
    place = share * (total - 1)
    wanted, before, within = (int(place), min(int(place) + 1, total - 1)), 0, {}
    for at, n in counts:
        within |= {k: (at, k - before) for k in wanted if before <= k < before + n}
        before += n

    def nth(at: int, k: int) -> float:
        run = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
        by = scores.where(part == at).groupBy("score").count().withColumn("upto", F.sum("count").over(run))
        return by.where(F.col("upto") > k).agg(F.min("score")).first()[0]

    low, high = (nth(*within[k]) for k in wanted)
    return low + (place - int(place)) * (high - low)


def least_likeness(judged: DataFrame, found: dict[str, list[str]], lang_col: str = "lang", names: tuple[str, str] = ("lang_pred", "score"), most: float = REJECT) -> float:
    """The score below which a document is in none of the languages: most, or three quarters of the score that all
    but one in a thousand labelled documents reach, if that is less; where no profile has all its places, for want
    of text, in proportion to the longest. judged: all documents with the columns `names` of with_language()."""
    most *= max(map(len, found.values()), default=0) / PROFILE
    own = judged.where(F.col(quoted(lang_col)).isNotNull() & (F.col(quoted(names[0])) != "und"))
    low = low_score(own.select(F.col(quoted(names[1])).alias("score")))
    return most if low is None else min(most, 0.75 * low)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = profiles(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return predict(docs, found).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin")
