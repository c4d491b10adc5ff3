"""Centroid clustering in whole numbers, nearest centroids by partial-distance search.

Vectors are quantised to floor(scale * x). The dimensions are ordered by their variance over all
vectors, highest first, and every distance accumulates in that order, a group of dimensions at a time.
The centroid that is nearest after the first group gives each vector a complete distance, its current
best. Of the other centroids those whose partial sum is strictly above the best are abandoned after
each group; survivors finish all dimensions, so ties are seen and the result is that of a full search.

A round is one pass over the vectors where they are: no vector is shuffled, so a hot source or one
very common vector costs nothing extra. A task hands on one row for each of its clusters, the sums by
dimension and the count; they are added in two levels, and what reaches the driver is one row for each
centroid. The last pass writes (vec_id, cluster, distance) once, from which the inertias are summed.

Defined cases: vectors that are null, of another length or hold null or non-finite components take no
part; a null id ranks behind all ids when the first centroids are drawn; equal ids rank by their
vectors; repeated rows count as often as they come; with fewer vectors than centroids all are
centroids; an empty table gives no rows; other columns are ignored. A component beyond 2^27 is an
error, as its distances need not fit in 63 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, columns_as, map_batches, saved

#: Components stay below this, so that squared distances of up to 128 dimensions fit in 63 bits.
LARGEST = 1 << 27
#: Vectors that are searched at once: their partial sums to all centroids are what a task holds.
TILE_ROWS = 1024
#: Tasks that share the sums of one cluster.
SALTS = 64


def whole_vectors(batch: pa.RecordBatch, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the batch that take part, and their quantised vectors."""
    vectors = column(batch, "x")
    rows = np.flatnonzero(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dims)
    flat = vectors.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(rows), dims)
    fits = np.isfinite(x).all(axis=1)
    x = np.floor(x[fits] * scale)
    if (np.abs(x) >= LARGEST).any():
        raise ValueError("a component is too large: squared distances would not fit in 63 bits")
    return rows[fits], x.astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray, order: np.ndarray, group: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance) of each row; ties go to the smaller number."""
    n, k = len(x), len(centroids)
    x, centroids = x[:, order], centroids[:, order]
    head = slice(0, group)
    first = ((x[:, None, head] - centroids[None, :, head]) ** 2).sum(axis=2)
    guess = first.argmin(axis=1)
    best = ((x - centroids[guess]) ** 2).sum(axis=1)
    row, cand = np.nonzero(first <= best[:, None])
    total = first[row, cand]
    for at in range(group, x.shape[1], group):
        total += ((x[row, at : at + group] - centroids[cand, at : at + group]) ** 2).sum(axis=1)
        stays = total <= best[row]
        row, cand, total = row[stays], cand[stays], total[stays]
    # what is left is complete and at most the guess's distance; the guess itself is always left
    ranked = np.lexsort((cand, total, row))
    lead = ranked[np.flatnonzero(np.diff(row[ranked], prepend=-1))]
    return cand[lead], total[lead]


def _tiles(n: int) -> Iterator[slice]:
    return (slice(i, i + TILE_ROWS) for i in range(0, n, TILE_ROWS))


def _sums(rows: DataFrame, dims: int, scale: float, clusters: Callable[[np.ndarray], np.ndarray], squares: bool = False) -> list:
    """Sums by dimension, counts and, if asked for, sums of squares of each cluster, as Python's whole numbers: at most one row a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            _, x = whole_vectors(batch, dims, scale)
            for tile in _tiles(len(x)):
                part = x[tile]
                of = clusters(part)
                order = np.argsort(of, kind="stable")
                found, start = np.unique(of[order], return_index=True)
                sums, more = np.add.reduceat(part[order], start), np.add.reduceat(part[order].astype(float) ** 2, start)
                for c, n, s, q in zip(found.tolist(), np.diff(np.append(start, len(order))).tolist(), sums, more):
                    kept = held.setdefault(c, [0, np.zeros(dims, np.int64), np.zeros(dims)])
                    kept[0] += n
                    kept[1] += s
                    kept[2] += q
        salt = TaskContext.get().partitionId() % SALTS
        values = [(c, salt, n, s.tolist(), q.tolist()) for c, (n, s, q) in held.items()]
        names = ["cluster", "salt", "n", "total", "square"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in values], t) for i, t in enumerate(kinds)], names=names)

    each = rows.mapInArrow(run, "cluster int, salt int, n long, total array<long>, square array<double>")
    wide = [F.col("total")[d].alias(f"s{d}") for d in range(dims)] + [F.col("square")[d].alias(f"q{d}") for d in range(dims if squares else 0)]
    names = ["n", *(f"s{d}" for d in range(dims)), *(f"q{d}" for d in range(dims if squares else 0))]
    added = [F.sum(c).alias(c) for c in names]
    return each.select("cluster", "salt", "n", *wide).groupBy("cluster", "salt").agg(*added).groupBy("cluster").agg(*added).collect()


def first_centroids(rows: DataFrame, k: int, dims: int, scale: float, seed: str) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest SHA-256: sorted partly in each task, ``k`` rows reach the driver."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            at, x = whole_vectors(batch, dims, scale)
            yield {"id": column(batch, "id").take(pa.array(at)), "v": pa.array(x.tolist(), pa.list_(pa.int64()))}

        return step

    whole = map_batches(rows, make, "id long, v array<long>")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return np.array([r["v"] for r in whole.orderBy(rank.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64).reshape(-1, dims)


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: float = 256.0, seed: str = "2", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each vector, saved; the final centroids) after ``rounds`` of assignment and exact means."""
    spark = vectors.sparkSession
    rows = columns_as(vectors, id=id_col, x=vector_col)
    centroids = first_centroids(rows, k, dims, scale, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    order = _by_variance(_sums(rows, dims, scale, lambda x: np.zeros(len(x), int), squares=True)[0], dims)
    for _ in range(rounds):
        current = centroids  # a few numbers a dimension, sent with the tasks' code
        for row in _sums(rows, dims, scale, lambda x, c=current: nearest(x, c, order)[0]):
            centroids = centroids.copy()
            centroids[row["cluster"]] = [row[f"s{d}"] // row["n"] for d in range(dims)]
    final = centroids

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            at, x = whole_vectors(batch, dims, scale)
            found = [nearest(x[tile], final, order) for tile in _tiles(len(x))]
            cluster, distance = (np.concatenate(f) for f in zip(*found)) if found else ([], [])
            yield {"vec_id": column(batch, "id").take(pa.array(at)), "cluster": cluster, "distance": distance}

        return step

    return saved(map_batches(rows, make, "vec_id long, cluster int, distance long"), "clusters"), final


def _by_variance(row, dims: int) -> np.ndarray:
    n = row["n"]
    return np.argsort([-(row[f"q{d}"] / n - (row[f"s{d}"] / n) ** 2) for d in range(dims)], kind="stable")


def summary(spark: SparkSession, found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256: one row for each centroid is broadcast."""
    # a partial sum a task; the second level has a row a cluster
    inertia = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    rows = [(c, inertia.get(c, 0), sum(inertia.values()), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
