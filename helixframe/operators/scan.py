"""Alignment filters, contig choice and per-read signal rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import range_join

SECONDARY, SUPPLEMENTARY = 256, 2048


def usable(p: Params = DEFAULTS, qc: bool = True) -> Column:
    """Mapping quality, flags and aligned length; plain comparisons, so that scans can push them down."""
    mapq, length = (p.min_mapq, p.min_alignment_length) if qc else (0, 0)
    return (F.col("mapq") >= mapq) & (F.col("flag").bitwiseAND(SECONDARY) == 0) & (F.col("flag").bitwiseAND(p.exclude_flags) == 0) & (F.col("qry_end") - F.col("qry_start") >= length)


def scan(alignments: DataFrame, regions: DataFrame | None = None, p: Params = DEFAULTS, qc: bool = True) -> DataFrame:
    """Usable alignments; with ``regions`` (contig, start, end) those that start in one, so each read has one owner."""
    kept = alignments.where(usable(p, qc))
    return kept if regions is None else range_join(kept, regions.distinct(), ["contig"], "ref_start", "start", "end", how="left_semi")


def contigs_to_process(contigs: DataFrame, requested: list[str] | None = None, region_contigs: list[str] | None = None, every: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """Named contigs, or contigs of named regions, or those of at least the least length."""
    if requested:
        return contigs.where(F.col("contig").isin(requested))
    if region_contigs:
        return contigs.where(F.col("contig").isin(region_contigs))
    return contigs if every else contigs.where(F.col("length") >= p.min_contig_length)


def contig_catalog(alignments: DataFrame) -> DataFrame:
    """(contig, mapped, length): mapped reads, and the last position covered where no header gives a length."""
    return alignments.groupBy("contig").agg(F.count("*").alias("mapped"), F.max("ref_end").alias("length"))


def cigar_ops(cigar: Column) -> Column:
    """array<struct<len, op>> of a CIGAR string; null where it holds anything else."""
    found = F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), F.lit(1))
    op = lambda x: F.struct(F.substring(x, 1, F.length(x) - 1).cast("long").alias("len"), F.right(x, F.lit(1)).alias("op"))
    once = F.transform(F.array(found), lambda f: F.when(F.array_join(f, "") == cigar, F.transform(f, op)))  # the pattern runs once for both uses
    return F.get(once, F.lit(0))


def total(ops: Column, codes: str, least: int = 0) -> Column:
    """Summed length of the operations in ``codes`` of more than ``least``."""
    return F.aggregate(ops, F.lit(0).cast("long"), lambda n, x: n + F.when(x["op"].isin(*codes) & (x["len"] > least), x["len"]).otherwise(0))


def mismatch_rate(alignments: DataFrame, ops: Column | None = None) -> DataFrame:
    """``nm_rate``: (NM - insertions - deletions of more than 10) / (aligned part of the read + 1); -1 without NM. ``ops``: a column of ``cigar_ops``, where there is one."""
    ops = cigar_ops(F.col("cigar")) if ops is None else ops
    rate = (F.col("nm") - total(ops, "I", 10) - total(ops, "D", 10)) / (F.col("qry_end") - F.col("qry_start") + 1)
    return alignments.withColumns({"insertions": total(ops, "I"), "deletions": total(ops, "D"), "nm_rate": F.coalesce(rate, F.lit(-1.0))})


def regional_rate(alignments: DataFrame) -> DataFrame:
    """(contig, regional_nm): the mean ``nm_rate`` (made where it is not there) of the reads that have NM; 0 where none has."""
    rated = alignments if "nm_rate" in alignments.columns else mismatch_rate(alignments)
    return rated.groupBy("contig").agg(F.coalesce(F.avg(F.when(F.col("nm").isNotNull(), F.col("nm_rate"))), F.lit(0.0)).alias("regional_nm"))
