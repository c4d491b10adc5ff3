import math
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from helixframe.llm import langid
from helixframe.llm.queries import op10_language_id

from .helpers import empty, odd_documents

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_language_id(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert sum(r["rejected"] for r in held) <= 0.03 * len(held)


def test_counts_are_those_of_a_plain_loop():
    text = "Été 12 the THE\n" * 3
    flat, want = b" " + b" ".join(text.encode().translate(langid.LETTERS).split()) + b" ", {}
    for n in langid.SIZES:
        for i in range(len(flat) - n + 1):
            want[flat[i : i + n]] = want.get(flat[i : i + n], 0) + 1
    found = langid.counts(text.encode())
    assert found.sum() == sum(want.values()) and sorted(found[found > 0])[-3:] == sorted(want.values())[-3:]
    langid.RUN, kept = 7, langid.RUN
    assert (langid.counts(text.encode()) == found).all()
    langid.RUN = kept


def test_odd_rows(spark):
    docs = odd_documents(spark, ["the cat and the dog", "12 + 34!", "le chat et le chien"] * 4)
    rows = {r["doc_id"]: r for r in langid.cross_fitted(docs).collect()}
    assert len(rows) == docs.select("doc_id").distinct().count() and not rows[None]["held_out"]
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 11)) and rows[10]["lang_pred"] == "en"
    assert langid.cross_fitted(empty(docs)).count() == 0
    unknown = langid.cross_fitted(docs.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def test_foreign_text_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert model.predict("Zażółć gęślą jaźń, przyszłość źdźbła".encode())[2]


def grams(text):
    """Bucket to count, by a plain loop."""
    flat, found = b" " + b" ".join(text.encode().translate(langid.LETTERS).split()) + b" ", Counter()
    for n in (2, 3):
        for i in range(len(flat) - n + 1):
            code = n
            for b in flat[i : i + n]:
                code = code * 0x01000193 % 2**32 ^ b
            code = (code ^ code >> 15) * 0x85EBCA6B % 2**32
            found[code >> 18] += 1
    return found


def brute(docs, per=400, k=3, rounds=12, quantile=0.01, slack=0.1):
    """docs: (id, text, lang); (id, prediction, score, rejected), with dictionaries instead of arrays."""
    teach = [(d, t, g) for d, t, g in docs if None not in (d, t, g) and zlib.crc32(str(d).encode()) % 3 != 1]
    seen = Counter(b for _, t, _ in teach for b in grams(t))
    idf = lambda b: math.log((1 + len(teach)) / (1 + seen[b])) + 1 if seen[b] else math.log1p(len(teach))

    def unit(x):
        size = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / max(size, 1e-12) for b, v in x.items()}

    vector = lambda text: unit({b: math.log1p(n) * idf(b) for b, n in grams(text).items()})
    dot = lambda x, y: sum(v * y[b] for b, v in x.items() if b in y)

    def mean(xs):
        total = defaultdict(float)
        for x in xs:
            for b, v in x.items():
                total[b] += v
        return unit(total)

    by = defaultdict(dict)
    for d, t, g in teach:
        by[g][xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) >> 1] = t
    centres = []
    for g in sorted(by):
        xs = [vector(t) for _, t in sorted(by[g].items())[:per]]
        own = [mean(xs)]
        while len(own) < min(k, len(xs)):
            own.append(min(xs, key=lambda x: max(dot(x, c) for c in own)))  # noqa: B023
        for _ in range(rounds):
            near = [max(range(len(own)), key=lambda i: dot(x, own[i])) for x in xs]  # noqa: B023
            own = [mean([x for x, n in zip(xs, near) if n == i]) if i in near else c for i, c in enumerate(own)]
        floor = max(0.0, float(np.quantile([max(dot(x, c) for c in own) for x in xs], quantile)) - slack)
        centres += [(c, g, floor) for c in own]
    out = []
    for d, t, _ in docs:
        if t is None or not any(map(str.isalpha, t)):
            out.append((d, "und", 0.0, True))
            continue
        x = vector(t)
        score, g, floor = max(((dot(x, c), g, f) for c, g, f in centres), key=lambda r: r[0])
        out.append((d, g, score, score < floor))
    return out


def test_table_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    want = {d: (g, s, r) for d, g, s, r in brute(docs)}
    rows = op10_language_id(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(want)
    for r in rows:
        g, score, rejected = want[r["doc_id"]]
        assert r["score"] == pytest.approx(score, abs=1e-4) and (r["lang_pred"] == g) and r["rejected"] == rejected


def test_sample_holds_the_smallest_hashes(spark):
    rows = [(i, f"text {i % 700}", "en") for i in range(3000)] + [(5000, "one row", "fr")] * 3000 + [(6000 + i, f"le {i}", "fr") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    key = lambda d, t: xxhash.xxh64_intdigest(t.encode(), xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) >> 1
    for per in (20, 400):
        got = defaultdict(list)
        for r in langid.sampled(docs, per).collect():
            got[r["lang"]].append(r["h"])
        for g in ("en", "fr"):
            assert sorted(got[g]) == sorted({key(d, t) for d, t, x in rows if x == g})[:per]
