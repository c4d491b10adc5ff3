import hashlib
import random

from helixframe.llm import decontam
from helixframe.llm.queries import op2_decontamination

from .helpers import PLAIN, SF, empty, lower, odd_documents


def brute(text, items, window):
    words = PLAIN.findall(lower(text or ""))
    hit, names = [False] * len(words), set()
    for name, item in items:
        own = PLAIN.findall(lower(item or ""))
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if own else ():
            if tuple(words[i : i + size]) in windows:
                hit[i : i + size] = [True] * size
                names.add(str(name))
    return len(words), sum(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), any(hit)


def test_matches_brute_force_on_the_tables(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {r["doc_id"]: brute(r["text"], items, 10) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in op2_decontamination(spark, SF).collect()}
    assert got == want and any(x[4] for x in want.values())


def test_matches_brute_force_on_few_words(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice("ab c É".split()) for _ in range(n))
    items = [(i, say(rng.randint(0, 14))) for i in range(12)] + [(3, None), (5, "zz Zz"), (5, "zz,zz;q")]
    texts = [say(rng.randint(0, 60)) for _ in range(60)] + ["x zz-ZZ q", "zz zz"]
    docs = odd_documents(spark, texts)
    table = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.SHARD_WORDS, 25):  # one shard, and many
        decontam.SHARD_WORDS, kept = limit, decontam.SHARD_WORDS
        got = [tuple(r) for r in decontam.digest(decontam.matches(docs, table, 4)).collect()]
        decontam.SHARD_WORDS = kept
        want = [(r["doc_id"], *brute(r["text"], items, 4)) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_removes_spans_and_keeps_the_rest(spark):
    items = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    docs = odd_documents(spark, ["Before, it. One two three FOUR five! And after", "clean   text\n stays", "one two three four five"])
    got = {r["doc_id"]: r["text"] for r in decontam.remove_spans(docs, items, 4, 0.8).collect()}
    assert got[10] == "Before, it. ! And after" and got[11] == "clean   text\n stays" and 12 not in got and 1 in got
    assert decontam.remove_spans(docs, items, 4).columns == docs.columns
    assert decontam.matches(empty(docs), items).count() == 0
    assert not any(r["contaminated"] for r in decontam.digest(decontam.matches(docs, empty(items))).collect())
