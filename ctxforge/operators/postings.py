"""Ranking of files for many queries at once, from a table of postings that is built once.

A posting says where a word stands in a file: words of the content with their counts, and three-letter pieces of paths, of declared
names and of words with a hyphen, since a term may lie anywhere within those and has three letters at least. Queries are joined to the postings
of their terms, so a file without any is not read; what remains of a top-k list comes from the files that rank highest without a term.
Terms with a hyphen are compared with the contents of the files found."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ctxforge.functions.text import basename, js_round, lines_of, word
from ctxforge.operators.relevance import MAX_BYTES, STOP_WORDS
from ctxforge.sources.scratch import written

#: What declares a name that counts; the name follows, and the next match may begin within it.
DECLARING = (r"(?i)export\s+(?:default\s+)?(?:function|class|const|type|interface)(?=\s+(\w+))", r"(?i)def(?=\s+(\w+))", r"(?i)func(?=\s+(\w+))")


@dataclass
class Postings:
    """files (ord, path, low_path, name, names, log, boost), words (word, ord, n), pieces (piece, kind, ord), and the contents for terms with a hyphen."""

    files: DataFrame
    words: DataFrame
    pieces: DataFrame
    contents: DataFrame


#: Files of a task, files with their contents, and points of a query's terms in files; bytes of a table that may be broadcast, and of a row.
FILES, CONTENTS, PAIRS = 20_000, 10_000, 250_000
SENT_BYTES, ROW_BYTES = 16 << 20, 64


def dealt(rows: DataFrame, many: int, size: int = FILES) -> DataFrame:
    """rows by file (ord), in a task for each size of them: the number does not follow from bytes, as far as rows compress."""
    return rows.repartition(max(1, -(-many // size)), "ord")


def _pieces(text: Column) -> Column:
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substr(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def _all_pieces(texts: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, _pieces)))


def build(files: DataFrame) -> Postings:
    """Postings of files (ord, path, content, size_bytes), written; those that are too large are left out."""
    small = files.where(F.col("size_bytes") <= MAX_BYTES)
    content = F.coalesce("content", F.lit(""))
    low = F.lower(content)
    names = F.array_distinct(F.concat(*(F.transform(F.regexp_extract_all(content, F.lit(p), F.lit(1)), F.lower) for p in DECLARING)))
    boost = F.when(F.col("path").rlike(r"index\.(ts|js|py)$"), 5).otherwise(0) + F.when(F.col("path").startswith("src/"), 3).otherwise(0)
    path = F.lower("path")
    # Tables of files are dealt by file in tasks of FILES: what compresses well would be put together by its size on disk.
    about = written(small.select("ord", "path", path.alias("low_path"), basename(path).alias("name"), names.alias("names"), F.log2(F.size(lines_of(low)) + F.lit(2)).alias("log"), boost.alias("boost")), "posted-files")
    tokens = small.select("ord", F.explode(F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))).alias("word"))
    words = written(dealt(tokens, about.count()).groupBy("word", "ord").agg(F.count(F.lit(1)).alias("n")), "posted-words")
    in_path = about.select(F.explode(_pieces(F.col("low_path"))).alias("piece"), F.lit("path").alias("kind"), "ord")
    in_names = about.select(F.explode(_all_pieces(F.col("names"))).alias("piece"), F.lit("name").alias("kind"), "ord")
    # A term with a hyphen lies within a run of letters, digits and marks that has one.
    runs = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z0-9_-]*-[a-z0-9_-]*"), F.lit(0)))
    in_runs = small.select(F.explode(_all_pieces(runs)).alias("piece"), F.lit("run").alias("kind"), "ord")
    return Postings(about, words, written(in_path.union(in_names).union(in_runs), "posted-pieces"), small.select("ord", low.alias("low"), content.alias("content")))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, place, term) of queries (query_id, query), repeats kept."""
    clean = F.regexp_replace(F.lower("query"), r"[^a-z0-9\s_-]", " ")
    kept = F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOP_WORDS)))
    return queries.select("query_id", F.posexplode(kept).alias("place", "term"))


def _hits(postings: Postings, terms: DataFrame, many: int) -> DataFrame:
    """(term, ord, seen, declared) of the files, many in all, that have a term in their content, path or a declared name."""
    plain = terms.where(~F.col("term").contains("-"))
    seen = plain.join(postings.words, plain.term == postings.words.word).select("term", "ord", F.col("n").alias("seen"))
    # A term is looked for by its first three letters; whether it is there, the file's row says.
    near = plain.join(postings.pieces.where("kind IN ('path', 'name')"), F.substring("term", 1, 3) == F.col("piece")).select("term", "ord").withColumn("seen", F.lit(0).cast("long"))
    both = dealt(seen.unionByName(near), many).groupBy("term", "ord").agg(F.max("seen").alias("seen")).join(dealt(postings.files.select("ord", "names"), many), "ord")
    both = both.select("term", "ord", "seen", F.exists("names", lambda x: x.contains(F.col("term"))).alias("declared"))
    joined = terms.where(F.col("term").contains("-"))
    near = joined.join(postings.pieces.where("kind IN ('path', 'run')"), F.substring("term", 1, 3) == F.col("piece")).select("term", "ord")
    candidates = dealt(near, many, CONTENTS).distinct().join(dealt(postings.contents, many, CONTENTS), "ord")
    t = F.col("term")
    pattern = F.concat(F.lit(r"(?<![A-Za-z0-9_])(?:"), t, F.lit(r")(?![A-Za-z0-9_])"))
    declares = F.concat(F.lit(r"(?i)export\s+(?:default\s+)?(?:function|class|const|type|interface)\s+\w*"), t, F.lit(r"\w*|def\s+\w*"), t, F.lit(r"\w*|func\s+\w*"), t, F.lit(r"\w*"))
    rest = candidates.select("term", "ord", F.regexp_count("low", pattern).cast("long").alias("seen"), F.regexp_like("content", declares).alias("declared"))
    return both.unionByName(rest)


def rank(postings: Postings, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, position, ord, path, score, reasons): for each of the queries (query_id, query) the k best files with a positive score, ties
    in the listing's order, as relevance.rank gives them for one query."""
    terms = written(query_terms(queries), "query-terms")
    files = postings.files.select("ord", "path", "low_path", "name", "log", "boost")
    many = files.count()
    hits = dealt(_hits(postings, terms.select("term").distinct(), many), many).join(dealt(files.drop("path"), many), "ord")
    in_path, in_name = F.col("low_path").contains(F.col("term")), F.col("name").contains(F.col("term"))
    often = F.least(js_round(F.col("seen") / F.col("log") * 4), F.lit(20).cast("long"))
    points = F.when(in_path, 10).otherwise(0) + F.when(in_name, 15).otherwise(0) + F.when(F.col("seen") > 0, often).otherwise(0) + F.when(F.col("declared"), 20).otherwise(0)
    scored = written(hits.select("term", "ord", "boost", points.alias("points"), in_path.alias("in_path"), "seen", "declared").where("points > 0"), "scored")
    # Only numbers are summed for all pairs of a query and a file; reasons are made for the files that are listed.
    matches = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(scored.groupBy("term").agg(F.count(F.lit(1)).alias("m")), "term")
    tasks = max(1, -(-(matches.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) // PAIRS))
    asked = terms.select("query_id", "term")
    if asked.count() * ROW_BYTES <= SENT_BYTES:
        found = scored.repartition(tasks, "ord").join(F.broadcast(asked), "term")
    else:
        found = asked.join(scored, "term").repartition(tasks, "ord", "query_id")
    found = found.groupBy("query_id", "ord").agg((F.sum("points") + F.first("boost")).cast("int").alias("score"))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    # A file without a term is among the k best only if it is among the k best without any: k rows for all queries.
    alone = files.where("boost > 0").orderBy(F.desc("boost"), "ord").limit(k).select("ord", F.col("boost").alias("score"))
    extra = queries.select("query_id").join(F.broadcast(alone)).select("query_id", "ord", "score")
    best = found.withColumn("position", position).where(F.col("position") <= k).drop("position").unionByName(extra)
    best = best.groupBy("query_id", "ord").agg(F.max("score").alias("score")).withColumn("position", position).where(F.col("position") <= k)
    best = written(best, "ranked")
    why = terms.join(best.select("query_id", "ord"), "query_id")
    why = scored.join(F.broadcast(why) if why.count() * ROW_BYTES <= SENT_BYTES else why, ["term", "ord"])
    quoted = F.concat(F.lit('"'), F.col("term"), F.lit('"'))
    notes = F.array(
        F.when(F.col("in_path"), F.concat(F.lit("Path contains "), quoted)), F.when(F.col("seen") >= 3, F.concat(quoted, F.lit(" appears "), F.col("seen").cast("string"), F.lit("x"))),
        F.when(F.col("declared"), F.concat(F.lit("Exports symbol matching "), quoted)),
    )
    why = why.groupBy("query_id", "ord").agg(F.sort_array(F.collect_list(F.struct("place", notes.alias("notes")))).alias("notes"))
    reasons = F.array_distinct(F.filter(F.flatten(F.transform("notes", lambda x: x["notes"])), lambda r: r.isNotNull()))
    listed = best.join(why.select("query_id", "ord", reasons.alias("reasons")), ["query_id", "ord"], "left").join(files.select("ord", "path"), "ord")
    return listed.select("query_id", "position", "ord", "path", "score", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
