from helixframe.llm import decontam


def test_shards_cut_once(spark, monkeypatch):
    """Many shards remove what one does: overlapping spans, coverage by several items, no matches across a cut."""
    a, b, c = "a1 a2 a3 a4 a5", "a4 a5 b1 b2 b3", "l1 l2 r1 r2 r3"
    items = spark.createDataFrame([("a", a), ("b", b), ("c", c), ("d", "d1 d2 d3 d4 d5")], "item_id string, text string").coalesce(1)
    texts = ["x1 x2 x3 x4 x5 x6 x7 a1 a2 a3 a4 a5 b1 b2 b3 x8", "x1 x2 l1 l2 a1 a2 a3 a4 a5 r1 r2 r3 x3 x4 x5", "d1 d2 d3 d4 d5 x1 x2 x3 x4 l1 l2 r1 r2 r3 x5", "nothing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {0: "x1 x2 x3 x4 x5 x6 x7 x8", 1: "x1 x2 l1 l2 r1 r2 r3 x3 x4 x5", 3: "nothing here", 4: None}
    for words in (decontam.SHARD_WORDS, 8):
        monkeypatch.setattr(decontam, "SHARD_WORDS", words)
        assert len(list(decontam.shards(items, 5))) == (1 if words > 8 else 4)
        assert {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, items, 5, 0.5).collect()} == want
