import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from helixframe.llm import centroids
from helixframe.llm.queries import ORACLE_SQL, op11_centroids

from .helpers import SF, empty


def brute(rows, k, rounds, dims):
    """rows: (id, vector); plain loops over all centroids and dimensions."""
    fits = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if fits(v)]
    ranked = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    means = [v for _, v in ranked[:k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in enumerate(means))
    for _ in range(rounds):
        of = [best(v)[1] for _, v in rows]
        means = [[sum(x) // len(x) for x in zip(*held)] if (held := [v for (_, v), o in zip(rows, of) if o == c]) else m for c, m in enumerate(means)]
    found = [(i, *best(v)) for i, v in rows]
    inertia = [sum(d for _, d, o in found if o == c) for c in range(len(means))]
    shas = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in means]
    return sorted(((i, c, d, inertia[c], sum(inertia), shas[c]) for i, d, c in found), key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert rows_of(op11_centroids(spark, SF)) == brute(rows, 40, 5, 64)


def test_sql(spark):
    with duckdb.connect() as db:
        db.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
        found = db.sql(ORACLE_SQL["op11_centroids"])
        query = op11_centroids(spark, SF)
        assert found.columns == query.columns
        assert sorted(found.fetchall(), key=str) == rows_of(query)


def test_odd_rows(spark):
    rng = random.Random(4)
    vector = lambda n=6: [rng.uniform(-1, 1) for _ in range(n)]
    same = vector()
    rows = [(i, vector()) for i in range(50)] + [(100 + i, same) for i in range(60)] + [(7, vector()), (7, same), (None, vector()), (None, None), (200, None), (201, [0.5, None] + vector(4))]
    rows += [(202, [float("nan")] + vector(5)), (203, [float("inf")] + vector(5)), (204, []), (205, vector(7)), (206, [5e4] * 6), *[(i, vector()) for i in (3, 3)]] + [(4, same)] * 3
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, n int").repartition(5)
    for k, rounds in ((9, 3), (1, 1), (500, 2), (12, 0)):
        assert rows_of(centroids.summary(spark, *centroids.clustered(df, k, rounds, dims=6))) == brute(rows, k, rounds, 6)
    assert centroids.summary(spark, *centroids.clustered(empty(df), dims=6)).count() == 0
    wide = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="63 bits"):
        centroids.clustered(wide, dims=6)


def test_ties_and_pruning():
    """Nearest by pruning equals the full search on coarse vectors, where ties abound, for every order of dimensions."""
    rng = np.random.default_rng(1)
    x, c = rng.integers(-2, 3, (500, 20)), rng.integers(-2, 3, (30, 20))
    c[17] = c[3]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for order in (np.arange(20), rng.permutation(20)):
        for group in (1, 3, 8, 20, 32):
            cluster, distance = centroids.nearest(x, c, order, group)
            assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
