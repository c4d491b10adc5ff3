"""Candidates of clusters, and what is derived from their leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions import stats

KEYS = ["contig", "svtype", "cluster"]


def bounds(svtype: Column, start: Column, svlen: Column) -> tuple[Column, Column]:
    """Position and end: insertions are points; deletions start their length (negative) before the lead."""
    pos = F.when(svtype == "DEL", start + svlen).otherwise(start)
    end = F.when(svtype == "INS", start).when(svtype == "DEL", start).otherwise(start + F.abs(svlen))
    return pos, end


def candidates(leads: DataFrame, keys: list[str] = KEYS, p: Params = DEFAULTS, parts: int | None = None) -> DataFrame:
    """One row for each cluster of ``leads`` (keys, ref_start, svlen, read_id, strand, mapq). Windows and sums over the keys share one exchange, to ``parts`` tasks, and a sort for lengths and one for starts."""
    dealt = leads.repartition(parts, *keys) if parts else leads
    x, dev_len = stats.with_trimmed(dealt, keys, "svlen", "stdev_len")  # first, so that the exchange is by the keys alone
    x, length = stats.with_center(x, keys, "svlen", "center_len")
    x, dev_pos = stats.with_trimmed(x, keys, "ref_start", "stdev_pos")
    x, start = stats.with_center(x, keys, "ref_start", "center_start")
    base = x.groupBy(*keys).agg(
        length,
        start,
        dev_len,
        dev_pos,
        F.count_distinct("read_id").alias("support"),
        F.avg("mapq").cast("int").alias("qual"),
        F.count_if(F.col("strand") == "+").alias("fwd"),
        F.count_if(F.col("strand") == "-").alias("rev"),
    ).withColumnRenamed("center_len", "svlen")
    svtype = F.col("svtype")
    pos, end = bounds(svtype, F.col("center_start"), F.col("svlen"))
    base = base.withColumn("stdev_len", F.when(svtype != "BND", F.col("stdev_len")))
    base = base.withColumns({"pos": pos, "end": end, "precise": F.col("stdev_pos") + F.coalesce("stdev_len", F.lit(0.0)) < p.precise_stdev})
    keep = (F.abs("svlen") >= p.screen) | svtype.isin("BND", "SINGLE_LEFT", "SINGLE_RIGHT")
    return base.where(keep).select(*keys, "pos", "end", "svlen", "support", "qual", "precise", "fwd", "rev", "stdev_pos", "stdev_len")


def lead_counts(leads: DataFrame, long_leads: DataFrame, keys: list[str], own: list[str], p: Params = DEFAULTS, edge: int = 500) -> DataFrame:
    """(keys, support_all, support_long, support_split, n_leads, sa_count, sa_share, nm, edge_reads): what a call takes from its leads besides ``candidates``.

    ``leads``: is_sa, nm, source, read_qname, qry_start, read_len too. ``long_leads`` (``own`` keys: those of the
    cluster before it was split) belong to each part of their cluster.
    """
    near = (F.col("qry_start") <= edge) | (F.abs(F.col("read_len") - F.col("qry_start")) <= edge)
    each = leads.select(*keys, "read_qname", "is_sa", F.lit(False).alias("long"), (F.col("source") != "INLINE").alias("split"), "nm", near.alias("near"))
    parts = leads.select(*keys).distinct()
    more = long_leads.select(*own, "read_qname", "is_sa").join(parts, own).select(*keys, "read_qname", "is_sa", F.lit(True).alias("long"))
    known = ~F.col("long")
    # a row a read first: distinct reads would copy every lead once for each such count
    reads = each.unionByName(more, allowMissingColumns=True).groupBy(*keys, "read_qname").agg(
        F.max("long").alias("_long"),
        F.count_if(known & F.col("split")).alias("_split"),
        F.count_if(known).alias("_n"),
        F.count_if("is_sa").alias("_sa"),
        F.count("is_sa").alias("_told"),
        F.sum("nm").alias("_nm"),
        F.count("nm").alias("_rated"),
        F.count_if(known & F.coalesce("near", F.lit(False))).alias("_near"),
    )
    return reads.groupBy(*keys).agg(
        F.count("read_qname").alias("support_all"),
        F.count_if(F.col("_long") & F.col("read_qname").isNotNull()).alias("support_long"),
        F.sum("_split").alias("support_split"),
        F.sum("_n").alias("n_leads"),
        F.sum("_sa").alias("sa_count"),
        F.try_divide(F.sum("_sa"), F.sum("_told")).alias("sa_share"),
        F.try_divide(F.sum("_nm"), F.sum("_rated")).alias("nm"),
        F.sum("_near").alias("edge_reads"),
    )


def call_ids(calls: DataFrame, order: list[str], prefix: str = "") -> DataFrame:
    """``id``: TYPE.nStask with n and the contig's number in capital hex digits, numbered by position within (contig, svtype)."""
    over = W.partitionBy("contig", "svtype").orderBy(*order)
    return calls.withColumn("id", F.concat(F.lit(prefix), "svtype", F.lit("."), F.hex(F.row_number().over(over) - 1), F.lit("S"), F.hex(F.col("contig_idx"))))


def bnd_alt(mate_contig: Column, mate_pos: Column, is_first: Column, is_reverse: Column) -> Column:
    """ALT of a breakend."""
    mark = F.when(is_reverse, F.lit("]")).otherwise(F.lit("["))
    mate = F.concat(mark, mate_contig, F.lit(":"), mate_pos.cast("string"), mark)
    return F.when(is_first, F.concat(F.lit("N"), mate)).otherwise(F.concat(mate, F.lit("N")))


def bnd_orientation(is_first: Column, is_reverse: Column) -> Column:
    return F.concat(F.when(is_first, "+").otherwise("-"), F.when(is_reverse, "+").otherwise("-"))


def resolve_bnd(leads: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mate_contig, mate_pos, is_first, is_reverse, support, alt): the majority mate contig, and of its leads the center and majority flags."""
    top = stats.most_common(leads, keys, "mate_contig", "mate_contig").drop("count")
    kept = leads.join(top, [*keys, "mate_contig"])
    out = top.join(stats.center(kept, keys, "mate_ref_start", "mate_pos"), keys)
    for flag in ("is_first", "is_reverse"):
        out = out.join(stats.most_common(kept, keys, flag, flag).drop("count"), keys)
    out = out.join(kept.groupBy(*keys).agg(F.count_distinct("read_id").alias("support")), keys)
    return out.withColumn("alt", bnd_alt(F.col("mate_contig"), F.col("mate_pos"), F.col("is_first"), F.col("is_reverse")))


def ins_representative(leads: DataFrame, calls: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each call the lead with a sequence whose length and position are nearest: abs(len(seq) - svlen) + 1.5 * abs(position difference)."""
    near = calls.select(*keys, F.col("svlen").alias("_l"), F.col("pos").alias("_p"))
    x = leads.where("seq is not null").join(near, keys)
    cost = F.abs(F.length("seq") - F.col("_l")) + 1.5 * F.abs(F.col("ref_start") - F.col("_p"))
    best = F.min(F.struct(cost.cast("double").alias("cost"), F.col(order).alias("lead"), F.col("seq").alias("seq"))).alias("best")
    return x.groupBy(*keys).agg(best).select(*keys, "best.lead", "best.cost", "best.seq")


def in_order(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    """By the header's order of contigs, then position, then id."""
    return calls.join(F.broadcast(contigs.select("contig", "contig_idx").distinct()), "contig").orderBy("contig_idx", "pos", "id") if "contig_idx" not in calls.columns else calls.orderBy("contig_idx", "pos", "id")
