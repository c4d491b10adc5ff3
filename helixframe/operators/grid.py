"""Grids over contigs: lead bins, haplotype counts, depth and lookups of depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import binned, depth_at, depth_steps, range_join


def bin_of(pos: Column | str, size: int = DEFAULTS.bin_size) -> Column:
    return (F.floor((F.col(pos) if isinstance(pos, str) else pos) / size) * size).cast("long")


def hap_counts() -> list[Column]:
    """Counts by haplotype; anything but 1 and 2 counts as 0."""
    hap = F.when(F.col("hap").isin(1, 2), F.col("hap")).otherwise(0)
    return [F.count_if(hap == k).alias(f"hap{k}") for k in (0, 1, 2)]


def lead_bins(leads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(contig, svtype, bin, n, hap0, hap1, hap2)."""
    return leads.groupBy("contig", "svtype", bin_of("ref_start", p.bin_size).alias("bin")).agg(F.count("*").alias("n"), *hap_counts())


def hap_steps(alignments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(contig, hap, start, end, depth): runs of bins over which as many reads of a haplotype (0, 1, 2) span, the bin of their end left out; by a sweep."""
    hap = F.when(F.col("hap").isin(1, 2), F.col("hap")).otherwise(0)
    return depth_steps(alignments.select("contig", hap.alias("hap"), bin_of("ref_start", p.bin_size).alias("a"), bin_of("ref_end", p.bin_size).alias("z")), ["contig", "hap"], "a", "z")


def hap_reference(alignments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(contig, bin, hap0, hap1, hap2): reads over every bin they span, the bin of their end left out. One sweep counts all haplotypes; runs become bins only after it."""
    hap = F.when(F.col("hap").isin(1, 2), F.col("hap")).otherwise(0)
    spans = alignments.select("contig", hap.alias("hap"), bin_of("ref_start", p.bin_size).alias("a"), bin_of("ref_end", p.bin_size).alias("z"))
    steps = depth_steps(spans, ["contig"], "a", "z", counts={f"hap{k}": (F.col("hap") == k).cast("int") for k in (0, 1, 2)})
    return steps.select("contig", F.explode(F.sequence("start", F.col("end") - p.bin_size, F.lit(p.bin_size).cast("long"))).alias("bin"), "hap0", "hap1", "hap2")


def coverage(alignments: DataFrame) -> DataFrame:
    """(contig, start, end, depth): runs of equal depth over [ref_start, ref_end)."""
    return depth_steps(alignments, ["contig"], "ref_start", "ref_end")


def masked(steps: DataFrame, n_runs: DataFrame) -> DataFrame:
    """Depth runs with the parts that ``n_runs`` (contig, start, end: runs of N, apart from one another) cover cut out."""
    size = 10_000
    a, b = binned(steps, F.col("start"), F.col("end") - 1, size).alias("a"), binned(n_runs.withColumnsRenamed({"start": "ns", "end": "ne"}), F.col("ns"), F.col("ne") - 1, size).alias("b")
    hit = a.join(b, (F.col("a.contig") == F.col("b.contig")) & (F.col("a._bin") == F.col("b._bin")) & (F.col("ns") < F.col("end")) & (F.col("ne") > F.col("start")))
    cuts = hit.select("a.contig", "start", "end", "depth", F.struct("ns", "ne").alias("run")).distinct()
    runs = cuts.groupBy("contig", "start", "end", "depth").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    edges = F.concat(F.array(F.struct(F.col("start").alias("ns"), F.col("start").alias("ne"))), F.col("runs"), F.array(F.struct(F.col("end").alias("ns"), F.col("end").alias("ne"))))
    parts = runs.withColumn("edges", edges).withColumn("part", F.explode(F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.struct(F.get("edges", i)["ne"].alias("s"), F.get("edges", i + 1)["ns"].alias("e")))))
    parts = parts.where("part.s < part.e").select("contig", F.col("part.s").alias("start"), F.col("part.e").alias("end"), "depth")
    return steps.join(runs.select("contig", "start"), ["contig", "start"], "left_anti").select("contig", "start", "end", "depth").unionByName(parts)


def n_runs(reference: DataFrame, chunk: int) -> DataFrame:
    """(contig, start, end) of the runs of N in ``reference`` (contig, chunk_no, seq); runs end at chunks."""
    runs = reference.select("contig", "chunk_no", "seq")
    pieces = F.split(F.regexp_replace("seq", "(?<=N)(?=[^N])|(?<=[^N])(?=N)", "\n"), "\n")
    walked = F.aggregate(pieces, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<s:bigint,e:bigint>>").alias("runs")), lambda a, x: F.struct((a["at"] + F.length(x)).cast("long").alias("at"), F.when(x.startswith("N"), F.array_append(a["runs"], F.struct(a["at"].alias("s"), (a["at"] + F.length(x)).cast("long").alias("e")))).otherwise(a["runs"]).alias("runs")))
    at = F.col("chunk_no").cast("long") * chunk
    return runs.withColumn("run", F.explode(walked["runs"])).select("contig", (at + F.col("run.s")).alias("start"), (at + F.col("run.e")).alias("end"))


def coverage_bins(steps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(contig, cov_bin, depth): mean depth of every touched bin, rounded half to even."""
    size = p.coverage_bin
    each = binned(steps, F.col("start"), F.col("end") - 1, size)
    overlap = F.least("end", (F.col("_bin") + 1) * size) - F.greatest("start", F.col("_bin") * size)
    return each.groupBy("contig", (F.col("_bin") * size).cast("long").alias("cov_bin")).agg(F.bround(F.sum(F.col("depth") * overlap) / size).cast("long").alias("depth"))


def contig_mean_coverage(steps: DataFrame, contigs: DataFrame) -> DataFrame:
    """(contig, mean_coverage) over the contig's whole length."""
    sums = steps.groupBy("contig").agg(F.sum(F.col("depth") * (F.col("end") - F.col("start"))).alias("bases"))
    return contigs.join(sums, "contig", "left").select("contig", (F.coalesce("bases", F.lit(0)) / F.col("length")).alias("mean_coverage"))


def coverage_offsets(p: Params = DEFAULTS) -> Column:
    """The five points of a call: upstream, start, center, end, downstream. A breakend ends where it starts."""
    end = F.when(F.col("svtype") == "BND", F.col("pos")).otherwise(F.col("end"))
    point = F.col("svtype").isin("INS", "BND")
    return F.array(
        F.struct(F.lit("upstream").alias("at"), (F.col("pos") - p.coverage_flank).alias("x")),
        F.struct(F.lit("start").alias("at"), F.when(point, F.col("pos") - p.coverage_shift).otherwise(F.col("pos")).alias("x")),
        F.struct(F.lit("center").alias("at"), F.when(point, F.col("pos")).otherwise(F.floor((F.col("pos") + end) / 2)).alias("x")),
        F.struct(F.lit("end").alias("at"), F.when(point, end + p.coverage_shift).otherwise(end - p.coverage_shift).alias("x")),
        F.struct(F.lit("downstream").alias("at"), (end + p.coverage_flank).alias("x")),
    )


def with_coverage(calls: DataFrame, steps: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``calls`` (call_id, contig, svtype, pos, end, ...) with cov_upstream ... cov_downstream; 0 off the covered parts."""
    points = calls.select("call_id", "contig", F.explode(coverage_offsets(p)).alias("o")).select("call_id", "contig", F.col("o.at").alias("at"), F.col("o.x").cast("long").alias("x"))
    found = depth_at(points, steps, ["contig"], "x")
    names = ("upstream", "start", "center", "end", "downstream")
    wide = found.groupBy("call_id").agg(*(F.max(F.when(F.col("at") == n, F.col("depth"))).alias(f"cov_{n}") for n in names))
    return calls.join(wide, "call_id")


def in_repeats(seeds: DataFrame, repeats: DataFrame) -> DataFrame:
    """The rows of ``seeds`` (contig, seed, ...) strictly inside a repeat (contig, start, end)."""
    return range_join(seeds, repeats.select("contig", "start", "end").distinct(), ["contig"], "seed", "start", "end", how="left_semi", strict=True)


def cap_sequences(leads: DataFrame, order: list[str], p: Params = DEFAULTS) -> DataFrame:
    """``seq`` of the first leads of a bin only: a bound of memory that belongs to the results."""
    seed = F.col("seed") if "seed" in leads.columns else bin_of("ref_start", p.bin_size)  # leads that were joined by their seed are dealt by it
    over = W.partitionBy("contig", "svtype", seed).orderBy(*order)
    return leads.withColumn("_r", F.row_number().over(over)).withColumn("seq", F.when(F.col("_r") <= p.seqs_per_bin, F.col("seq"))).drop("_r")
