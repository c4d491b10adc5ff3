"""Prefix sums, islands, interval coverage and binned joins that stay parallel within a contig.

Windows are partitioned by a tile of the axis, never by a whole contig. What has to cross a tile is
carried by a second window over one summary row for each tile.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tasks import tasks

#: Width of a tile of the axis.
TILE = 1_000_000


def islands(df: DataFrame, keys: list[str], pos: str, width: int, gap: Column, tile: int = TILE) -> DataFrame:
    """``island``: the first position of the row's run of positions whose distance, less ``width``, is ``gap`` (of the keys) at most. Positions may repeat.

    Rows are dealt by tile once and sorted once; a ``df`` that has ``_tile`` is dealt by it (and by keys) already.
    """
    at = [*keys, "_tile"]
    within = W.partitionBy(*at).orderBy(pos)
    x = df if "_tile" in df.columns else df.withColumn("_tile", F.floor(F.col(pos) / tile))
    x = x.withColumn("_prev", F.lag(pos).over(within)).withColumn("_start", F.when(F.col(pos) - F.col("_prev") - width > gap, F.col(pos))).drop("_prev")
    x = x.withColumn("_own", F.max("_start").over(within.rowsBetween(W.unboundedPreceding, 0)))
    ends = x.groupBy(*at).agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.max("_start").alias("_inner"))
    over = W.partitionBy(*keys).orderBy("_tile")
    ends = ends.withColumn("_before", F.lag("_last").over(over))
    ends = ends.withColumn("_head", F.when(F.col("_before").isNull() | (F.col("_first") - F.col("_before") - width > gap), F.col("_first")))
    ends = ends.withColumn("_carried", F.max(F.coalesce("_inner", "_head")).over(over.rowsBetween(W.unboundedPreceding, -1)))
    ends = ends.select(*at, F.coalesce("_head", "_carried").alias("_begun"))
    return x.join(ends, at).withColumn("island", F.coalesce("_own", "_begun")).select(*(c for c in df.columns if c != "_tile"), "island")


def runs(df: DataFrame, keys: list[str], pos: str, starts: Column, tile: int = TILE) -> DataFrame:
    """``island``: the last position up to the row's where ``starts`` holds; it has to hold for the first of each key."""
    marked = df.withColumns({"_tile": F.floor(F.col(pos) / tile), "_start": F.when(starts, F.col(pos))})
    last = marked.groupBy(*keys, "_tile").agg(F.max("_start").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    last = last.select(*keys, "_tile", F.max("_last").over(before).alias("_carried"))
    within = W.partitionBy(*keys, "_tile").orderBy(pos).rowsBetween(W.unboundedPreceding, 0)
    marked = marked.withColumn("_own", F.max("_start").over(within)).join(last, [*keys, "_tile"])
    return marked.withColumn("island", F.coalesce("_own", "_carried")).drop("_tile", "_start", "_own", "_carried")


def depth_steps(intervals: DataFrame, keys: list[str], start: str, end: str, tile: int = TILE, counts: dict[str, Column] | None = None) -> DataFrame:
    """(keys, start, end, depth): the runs of equal depth above 0 of half-open intervals, by an event sweep.

    With ``counts`` (name to a number from 0 up that an interval adds) such a sum each instead of ``depth``.
    Events are dealt by tile once, to tasks by the number of intervals (``tasks``: a table or stored); sums and
    next positions come from one sort there, and what crosses a tile from one row for each tile, which is broadcast: as many as the axis has Mb.
    """
    counts = counts or {"depth": F.lit(1)}
    at = [*keys, "_tile"]
    begun = F.struct(F.col(start).alias("pos"), *(c.alias(n) for n, c in counts.items()))
    ended = F.struct(F.col(end).alias("pos"), *((-c).alias(n) for n, c in counts.items()))
    ends = intervals.where(F.col(start) < F.col(end)).select(*keys, F.explode(F.array(begun, ended)).alias("e"))
    dealt = ends.select(*keys, F.floor(F.col("e.pos") / tile).alias("_tile"), "e.*").repartition(tasks(intervals), *at)
    changed = reduce(Column.__or__, (F.col(n) != 0 for n in counts))
    events = dealt.groupBy(*at, "pos").agg(*(F.sum(n).alias(n) for n in counts)).where(changed)
    within = W.partitionBy(*at).orderBy("pos")
    swept = events.withColumns({**{f"_own_{n}": F.sum(n).over(within.rowsBetween(W.unboundedPreceding, 0)) for n in counts}, "_next": F.lead("pos").over(within)}).drop(*counts)
    over = W.partitionBy(*keys).orderBy("_tile")
    before = over.rowsBetween(W.unboundedPreceding, -1)
    tiles = events.groupBy(*at).agg(*(F.sum(n).alias(n) for n in counts), F.min("pos").alias("_first"))
    tiles = tiles.select(*at, *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_base_{n}") for n in counts), F.lead("_first").over(over).alias("_after"))
    summed = swept.join(F.broadcast(tiles), at).withColumns({n: (F.col(f"_own_{n}") + F.col(f"_base_{n}")).cast("long") for n in counts})
    covered = reduce(Column.__or__, (F.col(n) > 0 for n in counts))
    return summed.where(covered).select(*keys, F.col("pos").alias("start"), F.coalesce("_next", "_after").alias("end"), *counts)


def binned(df: DataFrame, first: Column, last: Column, size: int, name: str = "_bin") -> DataFrame:
    """A row for each bin of ``size`` that [first, last] touches."""
    return df.withColumn(name, F.explode(F.sequence(F.floor(first / size), F.floor(F.greatest(first, last) / size))))


def depth_at(points: DataFrame, steps: DataFrame, keys: list[str], pos: str, size: int = 1_000) -> DataFrame:
    """``points`` (a row for each point) with ``depth``: that of the step that holds ``pos``, else 0."""
    cut = binned(steps, F.col("start"), F.col("end") - 1, size).select(*keys, "_bin", "start", "end", "depth")
    at = points.withColumn("_bin", F.floor(F.col(pos) / size))
    on = [at[k] == cut[k] for k in [*keys, "_bin"]] + [at[pos] >= cut["start"], at[pos] < cut["end"]]
    return at.join(cut, on, "left").select(*(at[c] for c in points.columns), F.coalesce(cut["depth"], F.lit(0)).cast("long").alias("depth"))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], pos: str, start: str, end: str, size: int = 10_000, how: str = "inner", strict: bool = False) -> DataFrame:
    """``left`` joined with the ``right`` intervals that hold its ``pos``, as an equi-join on bins. ``how``: inner, left, left_semi or left_anti.

    ``strict``: start < pos < end, else start <= pos < end. ``right``'s keys are dropped.
    """
    cut = binned(right, F.col(start), F.col(end), size)
    at = left.withColumn("_bin", F.floor(F.col(pos) / size))
    low = at[pos] > cut[start] if strict else at[pos] >= cut[start]
    joined = at.join(cut, [*(at[k] == cut[k] for k in [*keys, "_bin"]), low, at[pos] < cut[end]], how)
    kept = [at[c] for c in left.columns]
    if how in ("inner", "left"):
        kept += [cut[c] for c in right.columns if c not in keys]
    return joined.select(*kept)
