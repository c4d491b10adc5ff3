import math
from collections import Counter

import numpy as np
import pytest

from helixframe.llm import lm_scoring as lm
from helixframe.llm.queries import op3_lm_scoring

from .helpers import PLAIN, SF, empty, lower, odd_documents


def brute(docs, target, alpha=0.1, mu=50.0):
    """Over the words themselves."""
    texts = [(d, PLAIN.findall(lower(t or ""))) for d, t in docs]
    size = len({x for _, w in texts for x in w})
    models = []
    for chosen in ([w for d, w in texts if d in target], [w for _, w in texts]):
        words, before, pairs = Counter(), Counter(), Counter()
        for w in chosen:
            words.update(w)
            before.update([None, *w[:-1]] if w else [])
            pairs.update(zip([None, *w], w))
        models.append((words, before, pairs, sum(words.values())))
    scale = [1.0, models[0][3] / max(models[1][3], 1)]
    out = []
    for d, w in texts:
        loss = []
        for (words, before, pairs, n), k in zip(models, scale):
            p = lambda x: (words[x] * k + alpha) / (n * k + alpha * size)  # noqa: B023, E731
            loss.append(-sum(math.log((pairs[a, b] * k + mu * p(b)) / (before[a] * k + mu)) for a, b in zip([None, *w], w)) / len(w) if w else None)
        out.append((d, len(w), *loss, loss[0] - loss[1] if w else None))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[2] or 0, 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:2] == w[:2] and all(a is b is None or a == pytest.approx(b, abs=1e-6) for a, b in zip(g[2:], w[2:]))


@pytest.mark.parametrize("run", [1_000_000, 500])
def test_table(spark, monkeypatch, run):
    monkeypatch.setattr(lm, "RUN_TOKENS", run)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = op3_lm_scoring(spark, SF).collect()
    assert all(r["target_loss"] is None or r["target_loss"] > 0 and r["background_loss"] > 0 for r in got)
    same(got, brute(docs, good))


@pytest.mark.parametrize("run", [1_000_000, 3])
def test_odd_rows(spark, monkeypatch, run):
    monkeypatch.setattr(lm, "RUN_TOKENS", run)
    docs = odd_documents(spark, ["a b a b c", "c c a", "É é e"])
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = spark.createDataFrame([(10,), (10,), (4,), (None,), (999,)], "doc_id long")
    same(lm.score(docs, ids).collect(), brute(pairs, {10, 4}))
    monkeypatch.setattr(lm, "BROADCAST_ROWS", 0)
    same(lm.score(docs, ids).collect(), brute(pairs, {10, 4}))
    same(lm.score(docs, empty(ids)).collect(), brute(pairs, set()))
    assert lm.score(empty(docs), ids).count() == 0


def test_a_block_sends_a_key_once(spark, monkeypatch):
    """However often words come, requests are the blocks' distinct keys: they follow the input."""
    docs = spark.createDataFrame([(i, "the same words again " * 50, False) for i in range(64)], "doc_id long, text string, target boolean").repartition(4)
    held = lm.blocks(docs)
    rows = lm.asked(held, 8).collect()
    per_block = {b: sum(len(lm.keys_of(r["keys"])) for r in rows if r["block"] == b) for b in {r["block"] for r in rows}}
    assert len(per_block) == held.count() and set(per_block.values()) == {5 + 4 + 5}


def test_numbers_come_back():
    for x in ([], [0], [255, 0, 3], [256, 1, 70_000], [2**40, 5]):
        assert lm.numbers_of(lm.written(np.array(x, np.int64))).tolist() == x
    keys = np.array([0, 5, 2**63, 2**64 - 1], np.uint64)
    assert lm.keys_of(lm.written_keys(keys)).tolist() == keys.tolist() and not len(lm.keys_of(lm.written_keys(keys[:0])))
