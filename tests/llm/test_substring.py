import hashlib
import random

from helixframe.llm import substring
from helixframe.llm.queries import op9_substring_dedup

from .helpers import SF, WORDS, empty, odd_documents


def brute(docs, window):
    """docs: (id, text); (id, words, removed, hash of the kept words), as the rule says it."""
    words = [(d, WORDS.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i : i + window])
            first[k] = min(d, first.get(k, d))
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = brute(docs, 50)
    assert sorted(map(tuple, op9_substring_dedup(spark, SF).collect()), key=str) == want and sum(x[2] for x in want) > 0


def test_few_words_and_odd_rows(spark):
    rng = random.Random(3)
    passages = [" ".join(rng.choice(["a", "b", "é", "dd"]) for _ in range(rng.randint(8, 30))) for _ in range(12)]
    texts = ["  ".join(rng.choice(passages) for _ in range(rng.randint(0, 4))) for _ in range(50)]
    docs = odd_documents(spark, texts).repartition(5)
    docs = docs.union(docs.where("doc_id = 20")).union(docs.where("doc_id = 21").selectExpr("30L", "text", "lang", "source", "fp", "key", "part"))
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for window, phrase in ((8, 3), (12, 6)):
        got = sorted(map(tuple, substring.digest(docs, window, phrase).collect()), key=str)
        assert got == brute(pairs, window)
    kept = substring.remove_repeats(docs, 8, 3)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {None, 1, 2, 3, 4}
    assert substring.repeats(empty(docs), 8, 3).count() == 0
