import re

import corpus_pipeline
from edges import ROWS, documents, empty
from pyspark.sql import functions as F

from ctxforge.llm import catalog
from ctxforge.llm.common import materialize


def test_stages_run_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            counts.append(out.count())
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_edges(spark, sf):
    docs = documents(spark).withColumn("n_chars", F.length("text").cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, sf), "test-edge")
        docs = out if "text" in out.columns else docs
    assert docs.count() and docs.where("n_chars <> length(text)").count() == 0
    assert docs.where("doc_id = 7").first()["text"] == "[assign]'" and docs.where("text LIKE '%ünï%'").count() == 1
    none = empty(spark).withColumn("n_chars", F.lit(0).cast("long"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_first_stage_drops_what_has_no_language(spark, sf):
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, documents(spark), sf).collect()}
    assert kept == {r[0] for r in ROWS} - {2, 3, 4, 9}
    assert {r["score"] for r in corpus_pipeline.identify_language(spark, documents(spark), sf).collect()} == {7}


def test_catalog():
    assert len([n for n in catalog.queries() if n.startswith("op")]) == 13 and set(catalog.oracle_sql()) <= set(catalog.queries())


def test_no_labelled_language(spark, sf):
    rows = [(1, "the cat sat on the mat", None), (2, "another text here", None), (3, "12 34", None), (4, None, None)]
    kept = corpus_pipeline.identify_language(spark, documents(spark, rows), sf)
    assert {r["doc_id"] for r in kept.collect()} == {1, 2}


def test_first_stage_rejects_other_languages_only(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    strange = ["rb zwzj jjgk twjqkkb qfjzf xkcd wrtg ghjk zxcv bnmq wrtp " * 4, "Все люди рождаются свободными и равными", "全ての人間は、生まれながらにして自由である"]
    extra = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(strange)], "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra, allowMissingColumns=True), "").collect()}
    letters = {r["doc_id"] for r in docs.where("text RLIKE '[[:alpha:]]' OR text RLIKE '\\\\p{L}'").collect()}
    assert kept == letters


def test_near_stage_equals_all_pairs(spark):
    """Which documents stay, against all pairs by inverted lists over the real shingle sets."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    lists: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty_sets = [i for i, s in enumerate(sets) if not s]
    for i, s in enumerate(sets):
        both: dict = {}
        for x in s:
            for j in lists[x]:
                both[j] = both.get(j, 0) + 1
        for j in [j for j, n in both.items() if 5 * n >= 4 * (len(s) + len(sets[j]) - n)] + (empty_sets if not s else []):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    first: dict = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min(doc, first.get(find(i), doc))
    kept = {r["doc_id"] for r in corpus_pipeline.dedup_near(spark, docs, "").select("doc_id").collect()}
    assert kept == set(first.values()) and len(kept) < len(rows)


def _tables(spark):
    from pathlib import Path

    return {f.name: f for f in (Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "ctxforge").glob("*") if any(f.rglob("*.parquet"))}


def test_no_stage_leaves_the_texts_beside_its_output(spark, sf):
    """The first stage kept a second copy of all documents on disk while the later ones ran, and none deleted what it had read."""
    before = _tables(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = materialize(corpus_pipeline.identify_language(spark, docs, sf), "test-stage")
    materialize(corpus_pipeline.dedup_lines(spark, out, sf), "test-stage")
    left = {k: v for k, v in _tables(spark).items() if k not in before and not k.startswith("test-stage")}
    assert {"text", "_lines"}.isdisjoint(c for f in left.values() for c in spark.read.parquet(str(f)).columns)
    assert not [k for k in left if k.startswith(("line-windows", "line-repeats", "judged-")) and not k.startswith("judged-odd")]
    before = _tables(spark)
    corpus_pipeline.run(spark, sf)
    assert len([k for k in _tables(spark) if k not in before and k.startswith("stage-")]) == 1


def test_missing_languages_are_named_where_nothing_is_sent(spark, sf, monkeypatch):
    import ctxforge.llm.common as C

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang"))).union(docs.limit(0)).unionByName(docs.limit(20))
    found = corpus_pipeline.language_id.profiles(docs)
    want = corpus_pipeline.language_id.with_language(docs, found, added=("p", "s", "m")).where("p <> 'und' AND s >= 0.3")
    want = sorted((r["doc_id"], r["l"]) for r in want.select("doc_id", F.coalesce("lang", "p").alias("l")).collect())
    for most in (C.SENT_BYTES, -1):
        monkeypatch.setattr(corpus_pipeline, "sent_if_small", lambda table, row_bytes: C.sent_if_small(table, row_bytes, most))
        got = corpus_pipeline.identify_language(spark, docs, sf)
        assert got.columns == docs.columns and sorted((r["doc_id"], r["lang"]) for r in got.select("doc_id", "lang").collect()) == want
