"""Signals (leads) of alignments: events within a CIGAR, split reads and breakends, all as column expressions.

A read's own parts are walked inside its row; the segments of a split read are compared by a window
over that read alone. Nothing is shuffled by contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from .scan import SECONDARY, SUPPLEMENTARY, cigar_ops, total

# The operations that move along the read and along the reference.
READ_OPS, REF_OPS = "MI=XS", "MD=XN"


def walked(least: int, ops: Column | None = None) -> Column:
    """The I, D and S of at least ``least`` of ``cigar`` (or of its ``ops``): array of op, len, pos_read and pos_ref where each begins."""

    def walk(acc, x):
        event = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["read"].alias("pos_read"), acc["ref"].alias("pos_ref"))
        wanted = x["op"].isin("I", "D", "S") & (x["len"] >= least)
        return F.struct(
            (acc["read"] + F.when(x["op"].isin(*READ_OPS), x["len"]).otherwise(0)).alias("read"),
            (acc["ref"] + F.when(x["op"].isin(*REF_OPS), x["len"]).otherwise(0)).alias("ref"),
            F.when(wanted, F.array_append(acc["events"], event)).otherwise(acc["events"]).alias("events"),
        )

    start = F.struct(F.lit(0).cast("long").alias("read"), F.col("ref_start").cast("long").alias("ref"), F.array().cast("array<struct<op:string,len:bigint,pos_read:bigint,pos_ref:bigint>>").alias("events"))
    return F.aggregate(cigar_ops(F.col("cigar")) if ops is None else ops, start, walk)["events"]


def cigar_events(alignments: DataFrame, least: int) -> DataFrame:
    """A row for each I, D or S of at least ``least``: op, len, pos_read and pos_ref where it begins."""
    return alignments.withColumn("event", F.explode(walked(least))).select(*alignments.columns, "event.*")


def _inline_fields(e: Column, p: Params, detect_large_ins: bool) -> list[Column]:
    """What an event ``e`` of ``walked`` is as a lead."""
    primary = (F.col("flag").bitwiseAND(SECONDARY + SUPPLEMENTARY) == 0) & F.col("sa").isNull()
    long_clip = (e["op"] == "S") & (e["len"] >= p.long_ins_length / 2) & primary & F.lit(detect_large_ins)
    svtype = F.when(e["op"].eqNullSafe("I") | long_clip, "INS").when(e["op"] == "D", "DEL").when(e["pos_ref"] == F.col("ref_start"), "SINGLE_LEFT").otherwise("SINGLE_RIGHT")
    svlen = F.when(e["op"] == "I", e["len"]).when(e["op"] == "D", -e["len"]).when(~long_clip, F.lit(0))
    return [
        F.when(e["op"] == "D", e["pos_ref"] + e["len"]).otherwise(e["pos_ref"]).alias("lead_start"),
        e["pos_ref"].alias("lead_end"),
        e["pos_read"].alias("lead_qry_start"),
        F.when(e["op"] == "D", e["pos_read"]).otherwise(e["pos_read"] + e["len"]).alias("lead_qry_end"),
        svtype.alias("svtype"),
        svlen.cast("long").alias("svlen"),
        F.when((e["op"] == "I") & (e["len"] <= p.max_seq_length), F.substring("seq", e["pos_read"] + 1, e["len"])).alias("seq"),
    ]


def inline_events(alignments: DataFrame, p: Params = DEFAULTS, detect_large_ins: bool = True, ops: Column | None = None) -> DataFrame:
    """``alignments`` with ``inline``: the leads within the CIGAR as an array, so that later steps need neither CIGAR nor bases."""
    return alignments.withColumn("inline", F.transform(walked(p.screen, ops), lambda e: F.struct(*_inline_fields(e, p, detect_large_ins))))


def inline_leads(alignments: DataFrame, p: Params = DEFAULTS, detect_large_ins: bool = True, carried: tuple[str, ...] = ()) -> DataFrame:
    """Leads of insertions, deletions and clips within a CIGAR, or of ``inline`` where that is known. A null svlen is a long insertion of unknown length."""
    known = "inline" in alignments.columns
    # events are exploded first: fields of an array that is made in the same plan would each make it again
    x = alignments.withColumn("_e", F.explode("inline" if known else walked(p.screen)))
    fields = [F.col(f"_e.{c}") for c in ("lead_start", "lead_end", "lead_qry_start", "lead_qry_end", "svtype", "svlen", "seq")] if known else _inline_fields(F.col("_e"), p, detect_large_ins)
    strand = F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-").alias("strand")
    return x.select("aln_idx", "read_qname", "contig", *fields[:4], strand, "mapq", F.lit("INLINE").alias("source"), *fields[4:], *carried)


def sa_entries(alignments: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """A row for each well-formed entry of the SA tag: contig, position (from 0), strand, CIGAR numbers, mapq, nm; and what is ``carried`` of the read."""
    each = alignments.select("aln_idx", *carried, F.posexplode(F.filter(F.split("sa", ";"), lambda x: F.size(F.split(x, ",")) == 6)).alias("sa_no", "entry"))
    # fields and operations are columns of their own: what is told from them would split and parse each time
    f = F.col("_f")
    fields = each.withColumn("_f", F.split("entry", ",")).withColumn("_ops", cigar_ops(f[3]))
    told = fields.select("aln_idx", *carried, "sa_no", f[0].alias("contig"), (F.expr("try_cast(_f[1] as bigint)") - 1).alias("pos"), f[2].alias("strand"), F.expr("try_cast(_f[4] as int)").alias("mapq"), F.expr("try_cast(_f[5] as int)").alias("nm"), *clip_spans(F.col("_ops")))
    return told.where("ref_span is not null and pos is not null")


def clip_spans(ops: Column) -> list[Column]:
    """Clips at either end (S or H), and spans on reference and read, of ``cigar_ops``; null for a CIGAR with other operations."""
    clip = lambda x: F.when(x["op"].isin("S", "H"), x["len"]).otherwise(0)
    return [clip(F.get(ops, F.lit(0))).alias("clip_start"), F.when(F.size(ops) > 1, clip(F.element_at(ops, -1))).otherwise(0).alias("clip_end"), total(ops, "MDX=N").alias("ref_span"), total(ops, "MIX=").alias("read_span")]


def segments(alignments: DataFrame, p: Params = DEFAULTS, carried: tuple[str, ...] = ()) -> DataFrame:
    """The parts of split reads in read coordinates: the primary's own and one for each SA entry; reads with too many are left out."""
    split = alignments.where((F.col("flag").bitwiseAND(SUPPLEMENTARY) == 0) & F.col("sa").isNotNull())
    n = F.size(F.filter(F.split("sa", ";"), lambda x: x != ""))
    split = split.where(n <= p.max_splits_base + p.max_splits_kb * F.col("query_length") / 1000)
    reverse = F.col("flag").bitwiseAND(16) != 0
    start = F.when(reverse, F.col("query_length") - F.col("qry_end")).otherwise(F.col("qry_start"))
    own = split.select("aln_idx", F.lit(-1).alias("sa_no"), "contig", "ref_start", "ref_end", start.cast("long").alias("qry_start"), (start + F.col("qry_end") - F.col("qry_start")).cast("long").alias("qry_end"), F.when(reverse, "-").otherwise("+").alias("strand"), "mapq", *carried)
    first = F.when(F.col("strand") == "-", F.col("clip_end")).otherwise(F.col("clip_start"))
    other = sa_entries(split, carried).select("aln_idx", "sa_no", "contig", F.col("pos").alias("ref_start"), (F.col("pos") + F.col("ref_span")).alias("ref_end"), first.alias("qry_start"), (first + F.col("read_span")).alias("qry_end"), "strand", "mapq", *carried)
    return own.unionByName(other)


def _pairs(parts: DataFrame, p: Params) -> DataFrame:
    """Every part with the one before it on the read, and the kind of event between them."""
    over = W.partitionBy("aln_idx").orderBy("qry_start", "sa_no")
    names = ("contig", "ref_start", "ref_end", "qry_start", "qry_end", "strand", "mapq")
    b = parts.withColumns({f"a_{c}": F.lag(c).over(over) for c in names})
    s, c, a = p.screen, F.col, lambda x: F.col(f"a_{x}")
    same, plus = c("strand") == a("strand"), c("strand") == "+"
    dq, forward, backward = c("qry_start") - a("qry_end"), c("ref_start") - a("ref_end"), a("ref_start") - c("ref_end")
    dr = F.when(plus, forward).otherwise(backward)
    kind = lambda t, start, length: F.struct(F.lit(t).alias("svtype"), start.cast("long").alias("start"), length.cast("long").alias("svlen"))
    near = F.when(plus, c("ref_start")).otherwise(a("ref_start"))
    starts, ends = F.abs(c("ref_start") - a("ref_start")), F.abs(c("ref_end") - a("ref_end"))
    flip, span = F.when(plus, F.least(c("ref_start"), a("ref_start"))).otherwise(F.least(c("ref_end"), a("ref_end"))), F.when(plus, starts).otherwise(ends)
    event = (
        F.when(same & (dq >= s) & (dq - dr >= s), kind("INS", near, dq))
        .when(same & (dr >= s) & (dr - dq >= s), kind("DEL", near, -dr))
        .when(same & (dr <= 0) & (-dr >= s), kind("DUP", near, -dr))
        .when(~same & (span >= s), kind("INV", flip, span))
    )
    leading = F.when(a("contig").isNull() & (c("qry_start") >= p.long_ins_length / 2), F.struct(F.lit("INS").alias("svtype"), c("ref_start").cast("long").alias("start"), F.lit(None).cast("long").alias("svlen")))
    return b.withColumns({"event": F.when(c("contig") == a("contig"), event), "leading": leading})


def split_leads(alignments: DataFrame, p: Params = DEFAULTS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Leads between neighbouring parts of a read; a long clip before the first part is an insertion of unknown length.

    If no pair of a read with more than two parts shows an event, only its parts on the first part's
    contig and strand are taken; if those are two, they are compared anew.
    """
    parts = segments(alignments, p, carried)
    pairs = _pairs(parts, p)
    read = W.partitionBy("aln_idx")
    over = read.orderBy("qry_start", "sa_no")
    marked = pairs.withColumns({"hits": F.count("event").over(read), "n": F.count("*").over(read), "k": F.row_number().over(over)})
    ranked = marked.where("hits = 0 and n > 2").withColumns({"c0": F.first("contig").over(over), "s0": F.first("strand").over(over)})
    again = ranked.where("contig = c0 and strand = s0").withColumn("left", F.count("*").over(read)).where("left = 2").select(*parts.columns)
    out = marked.select(*parts.columns, "a_mapq", F.explode(F.array_compact(F.array("event", "leading"))).alias("e"))
    out = out.unionByName(_pairs(again, p).where("event is not null").select(*parts.columns, "a_mapq", F.col("event").alias("e")))
    end = F.when(F.col("e.svtype") == "INS", F.col("e.start")).otherwise(F.col("e.start") + F.col("e.svlen"))
    out = out.where(F.least("mapq", F.coalesce("a_mapq", "mapq")) >= p.min_mapq)
    source = F.when(F.col("sa_no") < 0, "SPLIT_PRIM").otherwise("SPLIT_SUP")
    return out.select("aln_idx", "contig", F.col("e.svtype").alias("svtype"), F.col("e.start").alias("lead_start"), end.alias("lead_end"), F.col("e.svlen").alias("svlen"), "strand", "mapq", source.alias("source"), F.col("qry_start").alias("lead_qry_start"), F.col("qry_end").alias("lead_qry_end"), *carried)


def breakends(alignments: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """(aln_idx, contig, ref_start, mate_contig, mate_ref_start, is_first, is_reverse) from the first SA entry, if its strand differs."""
    strand = F.when(F.col("flag").bitwiseAND(16) != 0, "-").otherwise("+")
    here = F.struct("contig", "ref_start", "ref_end", strand.alias("strand"), *clip_spans(F.col("_ops"))[:2])
    alignments = alignments.where("sa is not null").withColumn("_ops", cigar_ops(F.col("cigar")))
    sa = sa_entries(alignments.withColumn("_own", here), ("_own", *carried)).where("sa_no = 0")
    own = [F.col(f"_own.{c}").alias(c) for c in ("contig", "ref_start", "ref_end", "strand", "clip_start", "clip_end")]
    both = sa.select("aln_idx", *carried, *own, *(F.col(c).alias(f"m_{c}") for c in ("contig", "pos", "strand", "clip_start", "clip_end", "ref_span"))).where("strand <> m_strand")
    both = both.withColumns({"is_first": F.col("clip_start") <= F.col("clip_end"), "is_reverse": F.col("m_clip_end") > F.col("m_clip_start")})
    mate = F.col("m_pos") + F.when(F.col("is_reverse"), F.col("m_ref_span")).when(F.col("is_first"), 1).otherwise(2)
    return both.select("aln_idx", "contig", F.when(F.col("is_first"), F.col("ref_end")).otherwise(F.col("ref_start") + 1).alias("ref_start"), F.col("m_contig").alias("mate_contig"), mate.alias("mate_ref_start"), "is_first", "is_reverse", *carried)


def owned(leads: DataFrame, regions: DataFrame) -> DataFrame:
    """The leads that start within a region (contig, start, end); others belong to other regions or none."""
    from ..functions.intervals import range_join

    return range_join(leads, regions.distinct(), ["contig"], "ref_start", "start", "end", how="left_semi")
