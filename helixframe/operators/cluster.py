"""Clusters of leads: islands, the exact greedy merge, and the splits that follow it."""

from __future__ import annotations

import math
from array import array
from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import TILE, islands, runs
from ..functions.storage import forget, stored
from ..functions.tasks import tasks
from .grid import bin_of, in_repeats


def island_clusters(leads: DataFrame, gap: int = 0, p: Params = DEFAULTS) -> DataFrame:
    """``leads`` in bins of enough leads, with ``cluster``: the seed of the first bin of the run of neighbouring bins. Leads are dealt by tile once; bins are counted and joined to runs there."""
    keys = ["contig", "svtype"]
    known = leads.where("svlen is not null").withColumn("seed", bin_of("ref_start", p.bin_size))
    dealt = known.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, "seed")))).withColumn("_tile", F.floor(F.col("seed") / TILE)).repartition(*keys, "_tile")
    held = dealt.withColumn("_n", F.count("*").over(W.partitionBy(*keys, "_tile", "seed"))).where(F.col("_n") >= p.min_leads).drop("_n")
    return islands(held, keys, "seed", p.bin_size, F.lit(gap)).select(*keys, "seed", *(c for c in leads.columns if c not in {*keys, "seed"}), F.col("island").alias("cluster"))


def reach(leads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(contig, svtype, seed, part) of the bins with enough leads: parts that no merge can join, so each is clustered on its own.

    A cut lies where the gap is wider than every fixed distance of the rules and than merge_r times
    any deviation of starts on its narrower side. A run of more than one bin has four leads or more,
    whose deviation is at most its span by the root of 3. Where a cut does not hold, its sides become
    one part, and the wider parts are looked at again until all cuts hold.
    """
    keys = ["contig", "svtype"]
    known = leads.where("svlen is not null").groupBy(*keys, bin_of("ref_start", p.bin_size).alias("seed")).agg(F.count("*").alias("n"))
    known = stored(known.where(F.col("n") >= p.min_leads).drop("n"))  # islands reads it twice; leads are counted once
    seeds = stored(islands(known, keys, "seed", p.bin_size, F.lit(max(p.repeat_h_max, p.merge_bnd))))
    forget(known)
    named = seeds.withColumnRenamed("island", "part")
    parts = stored(named.groupBy(*keys, "part").agg((F.max("seed") + p.bin_size).alias("end")))
    over = W.partitionBy(*keys).orderBy("part")  # a row for each part, not for each lead
    while True:
        span = F.col("end") - F.col("part")
        near = parts.withColumns({"_end": F.lag("end").over(over), "_span": F.lag(span).over(over)})
        joined = F.coalesce(F.col("part") - F.col("_end") <= p.merge_r * F.least(span, "_span") / math.sqrt(3), F.lit(False))
        near = stored(near.withColumn("_joined", joined))
        if near.where("_joined").isEmpty():
            forget(parts, near)
            return named.select(*keys, "seed", "part")
        moved = runs(near, keys, "part", ~F.col("_joined")).select(*keys, "part", "end", "island")
        before, named = named, stored(named.join(moved.select(*keys, "part", "island"), [*keys, "part"]).select(*keys, "seed", F.col("island").alias("part")))
        old, parts = parts, stored(moved.groupBy(*keys, F.col("island").alias("part")).agg(F.max("end").alias("end")))
        forget(before, old, near)


class Leads:
    """Leads of known length, sorted, of the bins that have enough of them: starts and lengths as 8 bytes each, and what is known of each bin."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, repeat: np.ndarray, part: np.ndarray, p: Params):
        """``part``: a number for each lead that changes from one part to the next."""
        seeds = starts // p.bin_size * p.bin_size
        first = np.flatnonzero(np.concatenate([[True], (seeds[1:] != seeds[:-1]) | (part[1:] != part[:-1])]))
        n = np.diff(np.append(first, len(starts)))
        kept = n >= p.min_leads
        self.seeds, self.parts, self.repeat = seeds[first][kept], part[first][kept], np.logical_or.reduceat(repeat, first)[kept]
        self.edges = np.concatenate([[0], np.cumsum(n[kept])])
        self.starts, self.sizes = (array("q", x[np.repeat(kept, n)].astype(np.int64).tobytes()) for x in (starts, sizes))


class Run:
    """A run of bins being merged; ``rows`` are places in ``leads``."""

    __slots__ = ("start", "end", "rows", "bins", "repeat", "mean", "deviation")

    def __init__(self, leads: Leads, at: int, p: Params):
        self.start = int(leads.seeds[at])
        self.end, self.bins, self.repeat = self.start + p.bin_size, range(at, at + 1), bool(leads.repeat[at])
        self.rows = range(int(leads.edges[at]), int(leads.edges[at + 1]))
        self.measure(leads)

    def measure(self, leads: Leads) -> None:
        """Mean length and deviation of starts over every step-th lead; the mean's divisor is at most 100."""
        n = min(len(self.rows), 100)
        taken = slice(self.rows.start, self.rows.stop, len(self.rows) // n)
        starts = leads.starts[taken]
        self.mean = sum(leads.sizes[taken]) / n
        mean = sum(starts) / len(starts)
        self.deviation = math.sqrt(sum((x - mean) ** 2 for x in starts) / (len(starts) - 1)) if len(starts) > 1 else 0.0

    def joins(self, other: Run, svtype: str, p: Params) -> bool:
        inner, outer = other.start - self.end, other.end - self.start
        by_repeat = (self.repeat or other.repeat) and outer <= min(p.repeat_h_max, (abs(self.mean) + abs(other.mean)) * p.repeat_h)
        return inner <= min(self.deviation, other.deviation) * p.merge_r or by_repeat or svtype == "BND" and inner <= p.merge_bnd

    def take(self, other: Run, leads: Leads) -> None:
        self.end, self.repeat = other.end, self.repeat or other.repeat
        self.rows, self.bins = range(self.rows.start, other.rows.stop), range(self.bins.start, other.bins.stop)
        self.measure(leads)


def merged_bins(leads: Leads, bins: range, svtype: str, p: Params, first_part: bool) -> list[Run]:
    """The runs of some bins after all merges, in order.

    A merge looks again at the pair before it, but never at the first pair of a contig: its first run
    absorbs one neighbour at most. Later parts of a contig have runs before them, so all pairs count.
    """
    floor, at, runs, built = int(first_part), 0, [], bins.start
    while True:
        while len(runs) < at + 2 and built < bins.stop:  # what lies ahead is one bin each
            runs.append(Run(leads, built, p))
            built += 1
        if at + 1 >= len(runs):
            return runs
        if runs[at].joins(runs[at + 1], svtype, p):
            runs[at].take(runs.pop(at + 1), leads)
            at = max(at - 1, floor)
        else:
            at += 1


def merged_runs(rows: list[tuple], svtype: str, p: Params, first_part: bool = True) -> list[Run]:
    """``merged_bins`` of rows: (ref_start, svlen or None, repeat, index) by ref_start."""
    known = [r for r in rows if r[1] is not None]
    if not known:
        return []
    leads = Leads(*(np.array([r[i] for r in known]) for i in range(3)), np.zeros(len(known), int), p)
    return merged_bins(leads, range(len(leads.seeds)), svtype, p, first_part)


def greedy_clusters(leads: DataFrame, order: list[str], p: Params = DEFAULTS, split: bool = True, repeats: DataFrame | None = None) -> DataFrame:
    """``leads`` (with a boolean ``repeat``; a table or stored) of all clusters of the greedy merge, with ``cluster`` (its first seed) and ``cluster_end``.

    With ``repeats`` (contig, start, end) a lead's ``repeat`` is that of its bin, and leads need none: bins alone
    meet the repeats, and leads get it with their cluster.

    Exact: its order matters, so it runs in Python, part by part (``reach``), or contig by contig. Parts
    arrive sorted, with starts and lengths alone, and a task holds one part at a time, 16 bytes a lead. It
    tells the cluster of each bin, and leads meet that in a join.
    """
    keys = ["contig", "svtype"]
    found = leads.withColumn("seed", bin_of("ref_start", p.bin_size))
    parts = reach(found, p) if split else found.select(*keys, "seed", F.lit(0).cast("long").alias("part")).distinct()
    first = parts.groupBy(*keys).agg(F.min("part").alias("first_part"))
    own = ["repeat"] if repeats is None else []
    if repeats is not None:
        hit = in_repeats(parts.select("contig", "seed").distinct(), repeats).withColumn("hit", F.lit(True))
        parts = stored(parts.join(hit, ["contig", "seed"], "left").withColumn("repeat", F.coalesce("hit", F.lit(False))).drop("hit"))
    known = found.where("svlen is not null").select(*dict.fromkeys([*keys, "seed", "ref_start", "svlen", *own, *order]))
    known = known.join(parts.join(F.broadcast(first), keys), [*keys, "seed"])

    def clustered(pieces: list[tuple]) -> pa.RecordBatch:
        """(contig, svtype, seed, cluster, cluster_end, bin_repeat) of whole parts."""
        starts, sizes, repeat, new = (np.concatenate([x[i] for x in pieces]) for i in range(4))
        named = [k for x in pieces for k in x[4]]
        held = Leads(starts, sizes, repeat, np.cumsum(new) - 1, p)
        del starts, sizes, repeat, new
        cluster, end = held.seeds.copy(), held.seeds + p.bin_size
        edges = np.flatnonzero(np.diff(held.parts, prepend=-1, append=-1)) if len(held.seeds) else np.zeros(1, int)
        several = np.flatnonzero(np.diff(edges) > 1)
        for a, b in zip(edges[several].tolist(), edges[several + 1].tolist()):
            _, svtype, is_first = named[held.parts[a]]
            for r in merged_bins(held, range(a, b), svtype, p, is_first):
                if len(r.bins) > 1:
                    cluster[r.bins.start : r.bins.stop], end[r.bins.start : r.bins.stop] = r.start, r.end
        contig, svtype = (pa.array([named[i][k] for i in held.parts.tolist()], pa.string()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([contig, svtype, *(pa.array(x, pa.int64()) for x in (held.seeds, cluster, end)), pa.array(held.repeat.astype(bool), pa.bool_())], ["contig", "svtype", "seed", "cluster", "cluster_end", "bin_repeat"])

    def run(batches):
        last, pieces = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            contig, svtype, part, head, starts, sizes, repeat = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            new = np.concatenate([[(contig[0], svtype[0], part[0]) != last], (part[1:] != part[:-1]) | (contig[1:] != contig[:-1]) | (svtype[1:] != svtype[:-1])])
            last = contig[-1], svtype[-1], part[-1]
            begun = np.flatnonzero(new)
            named = [(contig[i], svtype[i], bool(part[i] == head[i])) for i in begun.tolist()]
            if len(begun):
                cut = begun[-1]
                if pieces or cut:
                    yield clustered([*pieces, (starts[:cut], sizes[:cut], repeat[:cut], new[:cut], named[:-1])])
                pieces = [(starts[cut:], sizes[cut:], repeat[cut:], new[cut:], named[-1:])]
            else:
                pieces.append((starts, sizes, repeat, new, []))
        if pieces:
            yield clustered(pieces)

    dealt = known.repartition(tasks(leads), *keys, "part").sortWithinPartitions(*keys, "part", "ref_start", *(F.col(c).asc_nulls_last() for c in order))
    sent = dealt.select(*keys, "part", "first_part", F.col("ref_start").cast("long"), F.col("svlen").cast("long"), F.coalesce("repeat", F.lit(False)).alias("repeat"))
    named = sent.mapInArrow(run, "contig string, svtype string, seed long, cluster long, cluster_end long, bin_repeat boolean")
    more = [] if repeats is None else [F.col("bin_repeat").alias("repeat")]
    return found.join(named, [*keys, "seed"]).select(*leads.columns, *more, "cluster", "cluster_end")


def merged_fragments(leads: DataFrame, keys: list[str], p: Params = DEFAULTS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Pieces of one event on one read as one lead: (keys, read_qname, ref_start, svlen, seq, n_fragments), and the ``carried`` columns of its first piece.

    Neighbours (by ref_start) are one event if both their reference and read distances, to the start
    or the end of the one before, are below the limit, on one strand; within repeats always.
    """
    # what decides comes last, so that pieces at one place do not depend on the order of rows
    over = W.partitionBy(*keys, "read_qname").orderBy("ref_start", "qry_start", "qry_end", "svlen", "strand", "ref_end", "repeat")
    x = leads.withColumns({f"_{c}": F.lag(c).over(over) for c in ("ref_start", "ref_end", "qry_start", "qry_end", "strand")})
    close = lambda c: (F.abs(F.col(f"{c}_start") - F.col(f"_{c}_end")) < p.merge_inner) | (F.abs(F.col(f"{c}_start") - F.col(f"_{c}_start")) < p.merge_inner)
    same = F.col("repeat") | (close("ref") & close("qry") & (F.col("strand") == F.col("_strand")))
    first = F.when(F.col("_ref_start").isNull() | ~same, 1).otherwise(0)
    x = x.withColumn("_island", F.sum(first).over(over.rowsBetween(W.unboundedPreceding, 0)))
    piece = F.struct("ref_start", "qry_start", "qry_end", "svlen", "seq")
    seqs = F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["seq"])
    seq = F.when(F.count("seq") == F.count("*"), F.array_join(seqs, ""))
    first = F.min(F.struct("ref_start", "qry_start", "qry_end", "svlen", *(F.col(c).alias(f"c_{c}") for c in carried))).alias("_first")
    out = x.groupBy(*keys, "read_qname", "_island").agg(F.min("ref_start").alias("ref_start"), F.sum("svlen").alias("svlen"), seq.alias("seq"), F.count("*").alias("n_fragments"), first)
    return out.select(*keys, "read_qname", "ref_start", "svlen", "seq", "n_fragments", *(F.col(f"_first.c_{c}").alias(c) for c in carried))


def bnd_parts(leads: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``part``: within a cluster and mate contig and side, the first mate bin of a chain of bins at most one bin apart."""
    size = p.merge_bnd
    x = leads.withColumn("_mate", F.floor(F.col("mate_ref_start") / size) * size)
    over = W.partitionBy(*keys, "mate_contig", "is_first").orderBy("_mate")
    start = F.when(F.coalesce(F.col("_mate") - F.lag("_mate").over(over) > size, F.lit(True)), F.col("_mate"))
    x = x.withColumn("_start", start).withColumn("part", F.max("_start").over(over.rangeBetween(W.unboundedPreceding, 0)))
    return x.drop("_mate", "_start")


def length_parts(lengths: list[int], p: Params = DEFAULTS) -> list[int]:
    """For each length, the key of its group: bins of lengths, joined upwards while near enough.

    After a join the walk steps back two; from the first place it then compares with the last one.
    """
    size = p.resplit_bin
    groups: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(lengths):
        groups[abs(x) // size * size].append(i)
    keys, at = sorted(groups), 1
    while len(keys) > 1 and at < len(keys):
        a, b = keys[at - 1], keys[at]
        if abs(b - a) <= max(p.resplit_min, min(a, b) * p.merge_len):
            groups[b] += groups.pop(a) if a != b else []
            keys.remove(a)
            at = max(0, at - 2)
        else:
            at += 1
    out = [0] * len(lengths)
    for k in keys:
        for i in groups[k]:
            out[i] = k
    return out


def split_by_length(leads: DataFrame, keys: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``length_key`` for the leads of each cluster, as ``length_parts`` gives it, by windows over the cluster alone: no exchange where leads are dealt by it.

    What joins are chains of bins, each near enough to the one before; a chain is named by its last bin. Only
    where a cluster is one chain does the walk's comparison with the last bin join early: the name is
    then the first bin but the lowest that is near enough to the last.
    """
    size, own = p.resplit_bin, W.partitionBy(*keys)
    over = own.orderBy("_bin")
    limit = lambda x: F.greatest(F.lit(float(p.resplit_min)), F.col(x) * p.merge_len)
    known = leads.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in (*keys, "svlen"))))
    x = known.withColumn("_bin", (F.floor(F.abs("svlen") / size) * size).cast("long")).withColumn("_before", F.lag("_bin").over(over))
    begun = F.when(F.col("_before").isNull() | (F.col("_bin") - F.col("_before") > limit("_before")), F.col("_bin"))
    x = x.withColumn("_chain", F.max(begun).over(over.rowsBetween(W.unboundedPreceding, 0)))
    x = x.withColumns({"_low": F.min("_bin").over(own), "_high": F.max("_bin").over(own), "_top": F.max("_chain").over(own)})
    x = x.withColumn("_name", F.min(F.when((F.col("_bin") > F.col("_low")) & (F.col("_high") - F.col("_bin") <= limit("_bin")), F.col("_bin"))).over(own))
    x = x.withColumn("_last", F.max("_bin").over(W.partitionBy(*keys, "_chain")))
    named = F.when(F.col("_top") == F.col("_low"), F.coalesce("_name", "_low")).otherwise(F.col("_last"))
    return x.select(*leads.columns, named.alias("length_key"))


def cluster_metrics(leads: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(n, mean_svlen, stdev_start) over every step-th lead in order; step = n / min(n, 100), and the mean's divisor is at most 100."""
    own = W.partitionBy(*keys)
    x = leads.withColumns({"_n": F.count("*").over(own), "_r": F.row_number().over(own.orderBy(*order)) - 1})
    x = x.withColumn("_cap", F.least("_n", F.lit(100))).where(F.col("_r") % F.floor(F.col("_n") / F.col("_cap")) == 0)
    return x.groupBy(*keys).agg(F.max("_n").alias("n"), (F.sum("svlen") / F.max("_cap")).alias("mean_svlen"), F.coalesce(F.stddev_samp("ref_start"), F.lit(0.0)).alias("stdev_start"))


def sa_share(leads: DataFrame, keys: list[str]) -> DataFrame:
    """Leads from supplementary records, long ones too: count and share."""
    return leads.groupBy(*keys).agg(F.count_if("is_sa").alias("sa_count"), F.avg(F.col("is_sa").cast("int")).alias("sa_share"))


def single_breaks(long_leads: DataFrame, keys: list[str], least: int = 3, distance: int = 50) -> DataFrame:
    """``break_pos``: the median start of at least ``least`` long leads if it is near their mean, else null."""
    x = long_leads.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile("ref_start", F.lit(0.5)).cast("long").alias("_m"), F.avg("ref_start").cast("long").alias("_a"))
    return x.select(*keys, F.when((F.col("_n") >= least) & (F.abs(F.col("_m") - F.col("_a")) < distance), F.col("_m")).alias("break_pos"))
