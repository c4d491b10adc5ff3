from helixframe.llm import quality
from helixframe.llm.queries import op8_quality

from .test_quality import SF


def test_sparse_languages_use_pooled_evidence(spark):
    """Junk is found in a language without rejected labels (de) and one without labels (fr)."""
    fine = lambda g, i: f"{g}fine {g}words of number {g}{i} stand here"
    junk = lambda g, i: f"{g}awful {g}thing %%% number {g}{i}"
    rows = [(i, fine("en", i), "s", "en", 1) for i in range(60)] + [(100 + i, junk("en", i), "s", "en", 0) for i in range(30)]
    rows += [(200 + i, fine("de", i), "s", "de", 1) for i in range(20)] + [(300 + i, junk("de", i), "s", "de", None) for i in range(5)]
    rows += [(400 + i, fine("fr", i), "s", "fr", None) for i in range(5)] + [(500 + i, junk("fr", i), "s", "fr", None) for i in range(5)]
    docs = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(r[0], r[4], 0) for r in rows if r[4] is not None], "doc_id long, quality int, toxic int")
    gone = {r["doc_id"] for r in quality.classify(docs, labels).where("rejected").collect()}
    assert gone == {*range(100, 130), *range(300, 305), *range(500, 505)}


def test_recall_on_the_table(spark):
    bad = {r["doc_id"]: r["quality"] == 0 or r["toxic"] == 1 for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen = [(bad[r["doc_id"]], r["rejected"]) for r in op8_quality(spark, SF).collect() if r["doc_id"] in bad]
    print("recall", sum(b and r for b, r in seen), sum(b for b, _ in seen), "false", sum(r and not b for b, r in seen), sum(not b for b, _ in seen))
    assert sum(b and r for b, r in seen) >= 0.8 * sum(b for b, _ in seen) and sum(r and not b for b, r in seen) <= 0.05 * sum(not b for b, _ in seen)
