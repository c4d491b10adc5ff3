from collections import Counter

import corpus_pipeline
from helixframe.llm import decontam, quality, substring

from .helpers import empty, odd_documents
from .test_decontam import brute as contaminated
from .test_packing import check
from .test_simhash import brute_survivors
from .test_substring import brute as repeated

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Every stage on its predecessor's rows; the last against the tokenizers library."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES

    kept = first(spark, docs, SF).cache()
    bad = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("rejected").collect()}
    assert kept.columns == names and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad

    alone = second(spark, kept, SF).cache()
    rows = kept.collect()
    assert alone.columns == names and sorted(r["doc_id"] for r in alone.collect()) == brute_survivors([(r["doc_id"], r["text"]) for r in rows])

    cut = third(spark, alone, SF).cache()
    want = {d: n - gone for d, n, gone, _ in repeated([(r["doc_id"], r["text"]) for r in alone.collect()], 50)}
    assert cut.columns == names and {r["doc_id"]: len(r["text"].split()) for r in cut.collect()} == {d: n for d, n in want.items() if n}

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = fourth(spark, cut, SF).cache()
    left = {r["doc_id"]: r["text"] for r in clean.collect()}
    for r in cut.collect():
        n, hit, *_ = contaminated(r["text"], items, 10)
        if hit > n / 2:
            assert r["doc_id"] not in left
        else:
            assert len(decontam.plain_words(left[r["doc_id"]].encode())) == n - hit and (hit or left[r["doc_id"]] == r["text"])
    check([(r["doc_id"], r["text"]) for r in clean.collect()], last(spark, clean, SF).collect())


def test_run_gives_the_stages_rows(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns[:3] == ["doc_id", "start", "length"] and Counter(r["sequence_id"] for r in rows.collect())


def test_stages_take_odd_rows(spark):
    docs = odd_documents(spark, ["some text"]).selectExpr("doc_id", "text", "lang", "source", "cast(fp as long) as n_chars")
    for rows in (docs, empty(docs)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.collect()
    assert substring.remove_repeats(docs).columns == docs.columns
