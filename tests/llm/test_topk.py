import math
import random

from pyspark.sql import functions as F

from helixframe.llm import topk
from helixframe.llm.queries import op6_top_k

from .helpers import SF, empty


def brute(rows, k, every):
    """rows: (id, vector); the rule, row by row: all rows but the query's own are candidates."""
    fits = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if fits(v)]
    out = []
    for at, (q, a) in enumerate(rows):
        if q is None or q % every:
            continue
        found = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i or 0) for n, (i, b) in enumerate(rows) if n != at and len(a) == len(b)))[:k]
        out += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(found)]
    return sorted(out, key=str)


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op6_top_k(spark, SF).collect()), key=str) == brute(rows, 5, 50)


def test_odd_rows(spark, monkeypatch):
    rng = random.Random(2)
    vector = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    same = vector()
    rows = [(i, vector()) for i in range(60)] + [(100 + i, same) for i in range(40)] + [(7, vector()), (None, vector()), (None, None), (200, None), (201, [0.5, None] + vector(4)), (202, [float("nan")] + vector(5)), (203, [float("inf")] + vector(5)), (210, []), (211, [])]
    rows += [(300 + i, vector(3)) for i in range(12)] + rows[:5] + [(10, vector()), (20, rows[20][1]), (20, rows[20][1]), (400, same)] + [(401, same)] * 9
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, v string, rid int").repartition(4)
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    for block in (topk.QUERY_BLOCK, 3):
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        for k, lists in ((5, 2), (3, 4)):
            got = topk.top_k(df, F.col("vec_id") % 10 == 0, k, lists)
            # with three components to four lists, one list is empty
            assert sorted(map(tuple, got.collect()), key=str) == brute(exact, k, 10)
    assert topk.top_k(empty(df), F.col("vec_id") % 10 == 0).count() == 0
