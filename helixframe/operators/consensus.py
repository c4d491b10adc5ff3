"""Insertion consensus by k-mer anchors, and the k-mer anchors themselves."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

K, SKIP, SKIP_PER, LEAST_OTHERS = 6, 3, 500, 4


def anchors(df: DataFrame, key: str, seq: str, k: int = K, skip: int | None = None) -> DataFrame:
    """(key, kmer, at): k-mers at every ``skip``-th place (3 + length / 500 without one) that occur there once in the sequence; the very last place is not one."""
    step = F.lit(skip) if skip else (F.lit(SKIP) + F.floor(F.length(seq) / SKIP_PER)).cast("int")
    long = df.where(F.length(seq) > k)
    at = long.select(key, F.col(seq), F.explode(F.sequence(F.lit(0), F.length(seq) - k - 1, step)).alias("at"))
    kmers = at.select(key, "at", F.substring(F.col(seq), F.col("at") + 1, F.lit(k)).alias("kmer"))
    return kmers.groupBy(key, "kmer").agg(F.count("*").alias("n"), F.min("at").alias("at")).where("n = 1").select(key, "kmer", "at")


def aligned(best: str, other: str, unique: dict[str, int], k: int, skip: int) -> str | None:
    """``other`` laid along ``best`` between shared anchors, with dashes where it says nothing; null if too little is left.

    Anchors are at most k apart and rise in both. Between two of them ``other`` is taken where both moved
    alike and half of the bases agree; else dashes stand for what ``other`` moved. What follows the last
    anchor says nothing. Then runs go that do not mostly agree, or in five places at most.
    """
    met, at = [], -1
    for j in range(0, len(other) - k, skip):
        i = unique.get(other[j : j + k])
        if i is not None and abs(i - j) <= k and i > at:
            met.append((i, j))
            at = i
    if not met:
        return None
    out, covered = "-" * met[0][0] if met[0][1] else "", 0
    for (i0, j0), (i1, j1) in zip(met, met[1:]):
        moved = j1 - j0
        room = min(moved, len(best) - len(out))
        piece = "-" * room
        if i1 - i0 == room > 0:
            covered += moved
            if sum(other[j0 + d] == best[i0 + d] for d in range(1, moved + 1)) >= 0.5 * moved:
                piece = other[j0 : j0 + room]
        out += piece
    out = out.ljust(len(best), "-")
    kept = []
    for told, run in groupby(range(len(best)), key=lambda h: out[h] != "-"):
        where = list(run)
        same = sum(out[h] == best[h] for h in where)
        kept.append(out[where[0] : where[-1] + 1] if told and same > 5 and same > 0.5 * len(where) else "-" * len(where))
    return "".join(kept) if covered > 0.2 * len(best) else None


def consensus(best: str, others: list[str], k: int = K) -> str:
    """``best`` with the bases that most of the aligned others agree on."""
    skip = SKIP + len(best) // SKIP_PER
    seen = Counter(best[i : i + k] for i in range(0, len(best) - k, skip))
    unique = {best[i : i + k]: i for i in range(0, len(best) - k, skip) if seen[best[i : i + k]] == 1}
    rows = [x for x in (aligned(best, o, unique, k, skip) for o in others) if x]
    out = []
    for i, base in enumerate(best):
        voters = [r[i] for r in rows if r[i] != "-"]
        if len(voters) >= 2 and len(voters) / (1 + len(rows)) >= 0.25:
            top = sorted(Counter([base, *voters]).items(), key=lambda x: (-x[1], x[0]))
            if len(top) > 1 and top[0][1] - top[1][1] >= 3:
                base = top[0][0]
        out.append(base)
    return "".join(out)


def with_consensus(calls: DataFrame) -> DataFrame:
    """``alt`` for calls with ``best`` and ``others`` (array of the bin's kept sequences, which O-18 bounds); few others leave ``best``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows["alt"] = [b if b is None or len(o) < LEAST_OTHERS else consensus(b, list(o)) for b, o in zip(rows["best"], rows["others"])]
            yield rows

    return calls.mapInPandas(run, StructType([*calls.schema.fields, StructField("alt", StringType())]))
