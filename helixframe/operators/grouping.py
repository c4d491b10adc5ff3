"""Grouping of calls across samples: exact, in parts that cannot meet.

Calls of a contig and type are taken in buffers of bins, by falling support; each joins the nearest group near
enough or founds one; at a buffer's end groups that lie far behind it are closed. Two facts make this parallel:

* Buffers end at a block's end, so where they end is a fold over the counts of the at most
  block_size / bin_size bins of each block, an aggregate of one row a block.
* A call joins no group further away than the largest distance of its type, and a group lies within its
  members. So where the gap between neighbouring calls is wider, what comes after never meets what was before:
  each part between such gaps is grouped on its own, with the buffers of the whole. Breakends of different mate
  contigs never meet either.

Parts are hash-partitioned and sorted; a task streams them and holds the open groups of one part, which are those
within half a buffer or ``combine_overlap`` of the last bin. A part without such gaps is one chain by the rules.
"""

from __future__ import annotations

import math
from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import islands
from ..functions.tasks import tasks
from .edits import distance_within


class Group:
    """Calls of several samples taken for one."""

    __slots__ = ("name", "n", "pos", "size", "mate", "mate_contig", "samples", "alt")

    def __init__(self, row):
        self.name, self.n, self.pos, self.size, self.mate = row.call_id, 0, 0.0, 0.0, 0.0
        self.mate_contig, self.samples, self.alt = row.mate_contig, set(), getattr(row, "alt", None)
        self.add(row)

    def resembles(self, row, p: Params) -> bool:
        """Whether the edit distance to the first member's sequence leaves more than a share of the mean length; true without sequences."""
        other = getattr(row, "alt", None)
        if not p.combine_sequence_share or self.alt is None or other is None or not self.size:
            return True
        limit = int(self.size * (1 - p.combine_sequence_share)) + 1  # the test below decides; this only bounds the search
        found = distance_within(self.alt, other, limit)
        return found is not None and (self.size - found) / self.size > p.combine_sequence_share

    def add(self, row) -> None:
        self.n += 1
        self.pos += (row.pos - self.pos) / self.n
        self.size += (abs(row.svlen) - self.size) / self.n
        self.mate += ((row.mate_pos or 0) - self.mate) / self.n
        self.samples.add(row.sample_id)

    def distance(self, row, p: Params) -> float:
        """Infinite where too far."""
        if row.svtype == "BND":
            d = abs(self.pos - row.pos) + abs(self.mate - (row.mate_pos or 0))
            return d if d <= p.combine_bnd and self.mate_contig == row.mate_contig else math.inf
        d, least = abs(self.pos - row.pos) + abs(self.size - abs(row.svlen)), min(self.size, abs(row.svlen))
        return d if least > 0 and d <= min(p.combine_match * math.sqrt(least), p.combine_match_max) else math.inf


class Open:
    """The open groups of a part."""

    def __init__(self):
        self.groups: list[Group] = []

    def take(self, row, p: Params, one_per_sample: bool) -> str:
        best, near = None, math.inf
        for g in self.groups:
            if (d := g.distance(row, p)) < near and not (one_per_sample and row.sample_id in g.samples) and (row.svtype == "BND" or g.resembles(row, p)):
                best, near = g, d
        if best is None:
            best = Group(row)
            self.groups.append(best)
        else:
            best.add(row)
        return best.name

    def close(self, last_bin: int, filled: int, p: Params) -> None:
        self.groups = [g for g in self.groups if abs(g.pos - last_bin) < max(p.bin_size * filled / 2, p.combine_overlap)]


def grouped_rows(rows: list, n_samples: int, p: Params = DEFAULTS, one_per_sample: bool = False) -> list:
    """The founding call of each row's group, of rows by (pos, call_id) of one contig and type: the rule as a plain loop."""
    least, out, bins = max(25, n_samples // 2), {}, {}
    for i, r in enumerate(rows):
        bins.setdefault(r.pos // p.bin_size * p.bin_size, []).append(i)
    keys, held, filled, kept = sorted(bins), [], 0, Open()
    for at, b in enumerate(keys):
        held += bins[b]
        filled += 1
        if len(held) < least and at + 1 < len(keys) and keys[at + 1] // p.block_size == b // p.block_size:
            continue
        for i in sorted(held, key=lambda i: -rows[i].support):
            out[i] = kept.take(rows[i], p, one_per_sample)
        kept.close(b, filled, p)
        held, filled = [], 0
    return [out[i] for i in range(len(rows))]


def dealt(candidates: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``candidates`` with ``block`` and ``mates``, dealt by contig, type and block. Stored or a table (``tasks``)."""
    # buffers of other mates close no group that a breakend could still reach, unless groups close early
    apart = F.lit(p.combine_overlap >= p.combine_bnd) & (F.col("svtype") == "BND")
    x = candidates.withColumns({"mates": F.when(apart, F.coalesce("mate_contig", F.lit(""))).otherwise(""), "block": F.floor(F.col("pos") / p.block_size)})
    return x.repartition(tasks(candidates), "contig", "svtype", "block")


def buffers(candidates: DataFrame, n_samples: int, p: Params = DEFAULTS) -> DataFrame:
    """(contig, svtype, block, bin, last_bin, filled) of every bin with calls: the last bin of its buffer, and how many of the buffer's have calls."""
    least = max(25, n_samples // 2)
    keys = ["contig", "svtype", "block"]
    x = candidates if "block" in candidates.columns else dealt(candidates, p)
    bins = x.groupBy(*keys, (F.floor(F.col("pos") / p.bin_size) * p.bin_size).cast("long").alias("bin")).agg(F.count("mates").alias("n"))  # never null; so it reads what ``parts`` reads
    # a block's bins are at most block_size / bin_size
    listed = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

    def step(a, x):
        full = a["held"] >= least
        return F.struct(
            (F.when(full, 0).otherwise(a["held"]) + x["n"]).cast("long").alias("held"),
            F.array_append(a["out"], F.struct(x["bin"].alias("bin"), (F.when(F.size(a["out"]) == 0, 0).otherwise(F.get(a["out"], F.size(a["out"]) - 1)["no"]) + full.cast("int")).alias("no"))).alias("out"),
        )

    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<struct<bin:bigint,no:int>>").alias("out"))
    each = listed.select(*keys, F.explode(F.aggregate("bins", start, step)["out"]).alias("b")).select(*keys, "b.bin", "b.no")
    ends = each.groupBy(*keys, "no").agg(F.max("bin").alias("last_bin"), F.count("*").alias("filled"), F.collect_list("bin").alias("bins"))
    return ends.select(*keys, F.explode("bins").alias("bin"), "last_bin", "filled")


def parts(candidates: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``candidates`` with ``block``, ``mates`` and ``part``: the first position of a run without a gap wider than what calls of its type can bridge."""
    widest = F.when(F.col("svtype") == "BND", p.combine_bnd).otherwise(p.combine_match_max)
    x = candidates if "block" in candidates.columns else dealt(candidates, p)
    found = islands(x.withColumn("_tile", F.col("block")), ["contig", "svtype", "mates"], "pos", 0, widest)
    return found.withColumnRenamed("island", "part")


def combined(candidates: DataFrame, n_samples: int, p: Params = DEFAULTS, one_per_sample: bool = False) -> DataFrame:
    """``candidates`` (call_id, sample_id, contig, svtype, pos, svlen, support, mate_contig, mate_pos; alt if known; a table or stored) with ``group_id``, which names the group's first call."""
    names = candidates.columns
    at_bin = (F.floor(F.col("pos") / p.bin_size) * p.bin_size).cast("long")
    x = dealt(candidates, p)
    placed = parts(x, p).withColumn("bin", at_bin).join(buffers(x, n_samples, p), ["contig", "svtype", "block", "bin"])
    by = ["contig", "svtype", "mates", "part"]
    used = [*by, "last_bin", "filled", *(c for c in names if c not in by)]
    schema = candidates.withColumn("group_id", F.lit("").cast("string")).schema
    asked = [c for c in used if c in {*by, "last_bin", "filled", "call_id", "sample_id", "pos", "svlen", "support", "mate_contig", "mate_pos", "alt"}]

    def plain(values: pd.Series) -> list:
        """Python's own numbers and strings; None for null."""
        return [None if x != x else x for x in values.tolist()] if values.hasnans else values.tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Row = namedtuple("Row", asked)
        part, buffer, kept = None, None, Open()
        for rows in batches:
            found = []
            for r in map(Row._make, zip(*(plain(rows[c]) for c in asked))):
                key = r[:4]
                if key != part:
                    part, buffer, kept = key, None, Open()
                if buffer is not None and r.last_bin != buffer[0]:
                    kept.close(*buffer, p)
                buffer = (r.last_bin, r.filled)
                found.append(f"{r.contig}:{r.svtype}:{kept.take(r, p, one_per_sample)}")
            yield rows.assign(group_id=found)[schema.names]

    sent = placed.select(*used).repartition(*by)
    return sent.sortWithinPartitions(*by, "last_bin", F.desc("support"), "pos", "call_id").mapInPandas(run, schema)
