"""Exact top-k by inner product with three-phase uniform thresholds.

The lists of the method are slices of the dimensions: list j holds, for a query, every candidate's
partial score over slice j. Partial scores are shifted by the list's minimum, so all are 0 or more.

1. Each task gives, of each list, its k highest partial scores and its minimum. A task holds all
   lists of its rows, so it completes the scores of what it gives; the k-th highest of these is a
   safe cutoff.
2. The cutoff is broadcast. Each list gives all entries of at least cutoff / lists: a candidate that
   no list gives has a lower total than the cutoff, so it cannot be among the k highest.
3. The partial scores that the other lists did not give are looked up where the candidate's vector is,
   and its score is complete. A task hands on what reaches the k-th highest of the cutoff and the
   scores it has completed so far; the complete scores are ranked.

Queries are a stated set, taken in blocks of QUERY_BLOCK vectors: what is broadcast, the thresholds
and query vectors of one block, has that bound. A block is one pass over the candidates, whose result
is added to one folder; so plans are as large for a thousand blocks as for one. Equal vectors tie, so
of each distinct vector only the smallest ids, up to k + 1 rows, can be ranked (one may be the query
itself); the rest is left out before the search, which keeps a very common vector cheap and exact.

Candidates of a query are all rows but its own. Rows with equal id and vector are one row with a
number through the search and count as often as they come in the ranks; each is a query of its own
then, for which the others are candidates, and so are rows that have its id and another vector.

Defined cases: vectors that are null or hold null or non-finite components take no part; a null id
is no query and ranks behind all ids of its score; only vectors of the query's length answer it; the
empty vector scores zero; an empty table gives no rows; other columns are ignored. Scores have to fit
in 63 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, columns_as, forget, map_batches, new_path, saved

#: Query vectors of one pass.
QUERY_BLOCK = 8192
#: Scores held at once by a task, 8 bytes each.
TILE = 1 << 21


def quantised(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, v array<long>, n) of (vec_id, x): floor(scale * x) without unusable vectors, and how often the row comes."""
    usable = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    each = rows.where("x is not null").where(usable).select("vec_id", F.transform("x", lambda x: F.floor(x.cast("double") * scale)).alias("v"))
    return each.groupBy("vec_id", "v").agg(F.count("*").alias("n"))


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """(rid, vec_id, v, n): of equal vectors the smallest ids, up to k + 1 rows; saved."""
    order = W.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)  # each task drops the rest before the shuffle
    before = F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1))
    kept = few.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= k)
    return saved(kept.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", "n"), "vectors")


class Block:
    """The query vectors of one pass, by their length."""

    def __init__(self, ids: np.ndarray, rows: list[int], by_length: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.ids, self.rows, self.by_length = ids, rows, by_length

    @classmethod
    def of(cls, rows: list) -> Block:
        by = defaultdict(list)
        for q, r in enumerate(rows):
            by[len(r["v"])].append(q)
        vectors = {n: (np.array(qs), np.array([rows[q]["v"] for q in qs], np.int64).reshape(len(qs), n)) for n, qs in by.items()}
        return cls(np.array([r["vec_id"] for r in rows], np.int64), [r["n"] for r in rows], vectors)

    def tiles(self, batch: pa.RecordBatch, lists: int) -> Iterator[tuple]:
        """(queries, rids, partial scores by list, query and row, own): own marks a query's only row."""
        values, rid, alone = column(batch, "v"), column(batch, "rid").to_numpy(), column(batch, "n").to_numpy() == 1
        ids = column(batch, "vec_id")
        vec_id, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        length = values.value_lengths().to_numpy()
        flat, starts = values.values.to_numpy(), values.offsets.to_numpy()[:-1]
        for n, (queries, vectors) in self.by_length.items():
            rows, step = np.flatnonzero(length == n), max(1, TILE // (len(queries) * lists))
            for i in range(0, len(rows), step):
                at = rows[i : i + step]
                block = flat[starts[at][:, None] + np.arange(n)].reshape(len(at), n)
                q, c = np.nonzero((self.ids[queries][:, None] == vec_id[at]) & known[at] & alone[at])
                own = np.zeros((len(queries), len(at)), bool)
                own[q, c] = (vectors[q] == block[c]).all(axis=1)
                yield queries, rid[at], np.stack([product(vectors[:, d], block[:, d]) for d in np.array_split(np.arange(n), lists)]), own


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b' in whole numbers; in doubles where those are exact."""
    top = lambda x: int(np.abs(x).max(initial=0))
    if a.shape[1] * top(a) * top(b) < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, lists: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products for each row where ``is_query`` (of column ``vec_id``)."""
    rows = quantised(columns_as(vectors, vec_id=id_col, x=vector_col), scale)
    kept = candidates(rows, k)
    folder, held = new_path(vectors.sparkSession, "ranks"), []
    for row in rows.where(is_query & F.col("vec_id").isNotNull()).toLocalIterator():
        held.append(row)
        if len(held) == QUERY_BLOCK:
            _search(kept, Block.of(held), k, lists, folder)
            held = []
    _search(kept, Block.of(held), k, lists, folder)
    forget(kept)
    return vectors.sparkSession.read.schema("query_id long, rank int, vec_id long, score long").parquet(folder)


def _search(rows: DataFrame, block: Block, k: int, lists: int, folder: str) -> None:
    """Adds the ranks of one block's queries to ``folder``."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(vars(block))
    n = len(block.ids)

    # Phase 1: (q, list, rid, low) of each task's k highest of each list, with their complete scores; rid is null for a list's minimum
    def local_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lowest = Block(**sent.value), np.iinfo(np.int64).min
        least = np.full((lists, n), np.iinfo(np.int64).max)
        best = np.full((lists, 3, n, 0), lowest)  # partial score, complete score, rid
        for batch in batches:
            for queries, rid, parts, own in known.tiles(batch, lists):
                least[:, queries] = np.minimum(least[:, queries], parts.min(axis=2))
                total = parts.sum(axis=0)
                top = min(k, len(rid))
                more = np.full((lists, 3, n, top), lowest)
                for j in range(lists):
                    part = np.where(own, lowest, parts[j])
                    at = np.argpartition(part, len(rid) - top, axis=1)[:, -top:]
                    more[j][:, queries] = [np.take_along_axis(part, at, 1), np.take_along_axis(total, at, 1), rid[at]]
                best = np.concatenate([best, more], axis=3)
                at = np.argsort(-best[:, :1], axis=3, kind="stable")[..., :k]
                best = np.take_along_axis(best, at, 3)
        for j in range(lists):
            q, c = np.nonzero(best[j, 0] > lowest)
            seen = np.flatnonzero(least[j] < np.iinfo(np.int64).max)
            yield _rows([q, seen], j, [best[j, 2][q, c], [None] * len(seen)], [best[j, 1][q, c], least[j][seen]])

    first = saved(rows.mapInArrow(local_lists, "q int, list int, rid long, low long"), "lists")
    least = first.where("rid is null").groupBy("q", "list").agg(F.min("low").alias("least"))
    cutoff = _kth(first.where("rid is not null").select("q", "rid", "low").distinct(), k)
    found = least.join(cutoff, "q", "left").select("q", "list", "least", "cutoff").toArrow()
    q, floor, safe = found["q"].to_numpy(), np.zeros((lists, n), np.int64), np.zeros(n, np.int64)
    floor[found["list"].to_numpy(), q] = found["least"].to_numpy()
    some = found["cutoff"].is_valid().to_numpy()
    safe[q[some]] = found["cutoff"].drop_null().to_numpy()
    safe = np.where(np.isin(np.arange(n), q[some]), safe - floor.sum(axis=0), 0)  # shifted; 0 where fewer than k are known
    limits = spark.sparkContext.broadcast((floor, safe))

    # Phases 2 and 3: entries of at least cutoff / lists in some list, and their complete scores
    def sufficient(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (floor, safe) = Block(**sent.value), limits.value
        best = np.repeat(safe[:, None], k, axis=1)  # the k highest so far, rising
        shift = floor.sum(axis=0)
        for batch in batches:
            for queries, rid, parts, own in known.tiles(batch, lists):
                parts -= floor[:, queries, None]
                q, c = np.nonzero(((lists * parts >= safe[queries][:, None]) & ~own).any(axis=0))
                if not len(q):
                    continue
                score, of = parts[:, q, c].sum(axis=0), queries[q]
                order = np.lexsort((-score, of))
                first = np.flatnonzero(np.diff(of[order], prepend=-1))
                place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
                top, place = order[place < k], place[place < k]
                more = np.full((n, k), np.iinfo(np.int64).min)
                more[of[top], place] = score[top]
                best = np.sort(np.concatenate([best, more], axis=1), axis=1)[:, -k:]
                keep = score >= best[of, 0]
                yield pa.RecordBatch.from_arrays([pa.array(of[keep].astype(np.int32)), pa.array(rid[c[keep]]), pa.array(score[keep] + shift[of[keep]])], names=["q", "rid", "score"])

    entries = saved(rows.mapInArrow(sufficient, "q int, rid long, score long"), "entries")

    def own_row(batch: pa.RecordBatch) -> Iterator[dict]:
        vector = {q: v for queries, vectors in sent.value["by_length"].values() for q, v in zip(queries.tolist(), vectors.tolist())}
        same = pa.array([vector[q] == v for q, v in zip(column(batch, "q").to_pylist(), column(batch, "v").to_pylist())], pa.bool_())
        yield {c: column(batch, c).filter(same) for c in ("q", "rid")}

    scored = entries.join(rows.select("rid", "vec_id", "n"), "rid")
    named = F.broadcast(spark.createDataFrame([(q, int(x), int(m)) for q, (x, m) in enumerate(zip(block.ids, block.rows))], "q int, query_id long, own_rows long"))
    own = rows.join(named, F.col("vec_id") == F.col("query_id")).select("rid", "q", "v")  # rows of a query's id, of which one may be its own
    mine = map_batches(own, lambda: own_row, "q int, rid long").withColumn("own", F.lit(1))
    best = scored.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))).where(F.col("place") <= k)
    each = best.join(F.broadcast(mine), ["q", "rid"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n") - F.coalesce("own", F.lit(0)), F.lit(k)))))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())))
    found = ranked.where(F.col("rank") <= k).join(named, "q")
    found = found.withColumn("query", F.explode(F.sequence(F.lit(1).cast("long"), "own_rows")))
    found.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
    forget(first, entries)


def _kth(bounds: DataFrame, k: int) -> DataFrame:
    """(q, cutoff): the k-th highest lower bound; no row where there are fewer than k."""
    return bounds.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("low")))).where(F.col("n") == k).select("q", F.col("low").alias("cutoff"))


def _rows(q: list, j: int, rid: list, part: list) -> pa.RecordBatch:
    q, rid, part = (pa.concat_arrays([pa.array(x, t) for x in xs]) for xs, t in ((q, pa.int32()), (rid, pa.int64()), (part, pa.int64())))
    return pa.RecordBatch.from_arrays([q, pa.array(np.full(len(q), j, np.int32)), rid, part], names=["q", "list", "rid", "low"])
