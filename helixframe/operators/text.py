"""Text of calls: VCF records and headers, rewritten records, CSV of candidates, BED of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from .call import bnd_orientation

# Names and descriptions that a header lists.
FILTERS = (
    "PASS GT GT_FAILED SUPPORT_MIN STDEV_POS STDEV_LEN SINGLE_BREAK SVLEN_MIN STRAND_BND COV_CHANGE_DEL COV_CHANGE_DUP COV_CHANGE_INS INLINE_SA COV_VAR "
    "COV_CHANGE_FRAC_US COV_CHANGE_FRAC_SC COV_CHANGE_FRAC_CE COV_CHANGE_FRAC_ED COV_MIN COV_MIN_GT ALN_NM MOSAIC_VAF NOT_MOSAIC_VAF SVLEN_MAX_MOSAIC SVLEN_MIN_MOSAIC "
    "STRAND STRAND_MOSAIC MOSAIC_SV_CLOSE_EDGE"
).split()
FORMATS = (("GT", "String"), ("GQ", "Integer"), ("DR", "Integer"), ("DV", "Integer"))
AMBIGUOUS = "RYSWKMBDHV"
CSV_HEADER = "svtype,orientation_start,contig_start,pos_start,orientation_end,contig_end,pos_end,filter,support_inline,support_split,support_ref"


# The INFO keys of records, their number and type.
INFOS = (
    ("PRECISE", "0", "Flag"),
    ("IMPRECISE", "0", "Flag"),
    ("MOSAIC", "0", "Flag"),
    ("SVLEN", "1", "Integer"),
    ("SVTYPE", "1", "String"),
    ("CHR2", "1", "String"),
    ("SUPPORT", "1", "Integer"),
    ("SUPPORT_INLINE", "1", "Integer"),
    ("SUPPORT_SA", "1", "Integer"),
    ("SUPPORT_LONG", "1", "Integer"),
    ("END", "1", "Integer"),
    ("STDEV_POS", "1", "Float"),
    ("STDEV_LEN", "1", "Float"),
    ("COVERAGE", ".", "Float"),
    ("STRAND", "1", "String"),
    ("AC", ".", "Integer"),
    ("SUPP_VEC", "1", "String"),
    ("CONSENSUS_SUPPORT", "1", "Integer"),
    ("RNAMES", ".", "String"),
    ("VAF", "1", "Float"),
    ("COVERAGE_VAR", "1", "Float"),
    ("NM", ".", "Float"),
    ("PHASE", ".", "String"),
    ("LASM", "0", "Flag"),
)
POPULATION_INFOS = (("POPULATION_AF", "1", "Float"), ("POPULATION_SIZE", "1", "Integer"))


def header(contigs: list[tuple[str, int]], samples: list[str], phased: bool = True, with_id: bool = False, population: bool = False) -> list[str]:
    """The lines of a VCF header; contigs are a small dimension."""
    lines = ["##fileformat=VCFv4.2"] + [f"##contig=<ID={c},length={n}>" for c, n in contigs]
    lines += [f'##ALT=<ID={t},Description="{t}">' for t in ("INS", "DEL", "DUP", "INV", "BND")]
    extra = ([("PS", "String")] if phased else []) + ([("ID", "String")] if with_id else [])
    lines += [f'##FORMAT=<ID={n},Number=1,Type={t},Description="{n}">' for n, t in (*FORMATS, *extra)]
    lines += [f'##FILTER=<ID={f},Description="{f}">' for f in FILTERS]
    lines += [f'##INFO=<ID={n},Number={k},Type={t},Description="{n}">' for n, k, t in INFOS + POPULATION_INFOS * population]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]


def info_value(c: Column, kind: str) -> Column:
    """Doubles with three digits, arrays joined by commas, true as a flag."""
    if kind == "double":
        return F.format_string("%.3f", c)
    return F.array_join(c, ",") if kind.startswith("array") else c.cast("string")


def info(fields: list[tuple[str, Column, str]], flags: list[Column]) -> Column:
    """INFO: flags, then key=value of the fields in their order, null ones left out."""
    items = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}="), info_value(v, kind))) for k, v, kind in fields]
    return F.array_join(F.array_compact(F.array(*flags, *items)), ";")


def resolved(calls: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """ref and alt of calls by the bases before them. ``calls``: pos, svlen, svtype, alt, anchor (base before pos, from reference), deleted (bases of a deletion with the base before)."""
    plain = lambda c: F.translate(F.upper(c), AMBIGUOUS, "N" * len(AMBIGUOUS))
    anchor = F.coalesce(plain(F.col("anchor")), F.lit("N"))
    deletion = (F.col("svtype") == "DEL") & (F.abs("svlen") <= p.long_del_length) & F.col("deleted").isNotNull()
    ref = F.when(deletion, plain(F.col("deleted"))).otherwise(anchor)
    sequence = (F.col("svtype") == "INS") & ~F.coalesce(F.col("alt").startswith("<"), F.lit(True))
    alt = (
        F.when(deletion, F.substring(ref, 1, 1))
        .when(sequence, F.concat(anchor, F.col("alt")))
        .when(F.col("svtype") == "BND", F.when(F.col("alt").startswith("N"), F.concat(anchor, F.substring("alt", F.lit(2), F.length("alt")))).otherwise(F.concat(F.substring("alt", F.lit(1), F.length("alt") - 1), anchor)))
        .otherwise(F.concat(F.lit("<"), "svtype", F.lit(">")))
    )
    size = F.when(sequence, F.length("alt")).otherwise(F.col("svlen"))
    return calls.withColumns({"svlen": size.cast("long"), "ref": ref, "alt": alt})


def vcf_lines(calls: DataFrame, genotypes: Column, prefix: str = "", phased: bool = False, mosaic: bool = False, measure_nm: bool = False, with_id: bool = False, p: Params = DEFAULTS) -> DataFrame:
    """(contig, pos, id, line). ``calls`` with id, contig, pos, end, ref, alt, qual, filter, svtype, svlen, support, precise, fwd, rev, cov_*, stdev_pos, stdev_len, vaf.

    Also written where ``calls`` has them: rnames, ac, mate_contig, phase, population_af, population_size, support_long, support_sa, supp_vec.
    """
    c = F.col
    more = lambda key, name, kind: [(key, c(name), kind)] * (name in calls.columns)
    pos = F.greatest(c("pos"), F.lit(1))
    end = F.when(c("precise") & (c("svtype") == "DEL"), pos + F.abs("svlen")).otherwise(c("end"))
    typed = c("svtype") != "BND"
    depth = F.concat_ws(",", *(c(f"cov_{x}").cast("string") for x in ("upstream", "start", "center", "end", "downstream")))
    strand = F.concat(F.when(c("fwd") > 0, "+").otherwise(""), F.when(c("rev") > 0, "-").otherwise(""))
    fields = [
        ("SVTYPE", c("svtype"), "string"),
        ("SVLEN", F.when(typed, c("svlen")), "long"),
        ("END", F.when(typed, end), "long"),
        ("SUPPORT", c("support"), "long"),
        *more("RNAMES", "rnames", "array"),
        ("COVERAGE", depth, "string"),
        ("STRAND", strand, "string"),
        *(more("NM", "nm", "double") if measure_nm else []),
        # by their keys
        *more("AC", "ac", "long"),
        *more("CHR2", "mate_contig", "string"),
        *more("PHASE", "phase", "string"),
        *more("POPULATION_AF", "population_af", "double"),
        *more("POPULATION_SIZE", "population_size", "long"),
        ("STDEV_LEN", c("stdev_len"), "double"),
        ("STDEV_POS", c("stdev_pos"), "double"),
        *more("SUPPORT_LONG", "support_long", "long"),
        *more("SUPPORT_SA", "support_sa", "long"),
        *more("SUPP_VEC", "supp_vec", "string"),
        ("VAF", c("vaf"), "double"),
    ]
    flags = [F.when(c("precise"), "PRECISE").otherwise("IMPRECISE"), F.when(F.lit(mosaic) & (F.coalesce("vaf", F.lit(0.0)) <= p.mosaic_af_max), "MOSAIC")]
    quality = F.coalesce(F.least(F.greatest("qual", F.lit(0)), F.lit(60)).cast("string"), F.lit("."))
    formats = F.lit("GT:GQ:DR:DV" + ":PS" * phased + ":ID" * with_id)
    line = F.concat_ws("\t", "contig", pos.cast("string"), F.concat(F.lit(prefix), "id"), "ref", "alt", quality, "filter", info(fields, flags), formats, genotypes)
    return calls.select("contig", "pos", "id", line.alias("line"))


def rewritten(lines: DataFrame, genotypes: DataFrame, phased: bool = True) -> DataFrame:
    """(line_index, line): the first eight columns of each input record with the new genotype (line_index, genotype), in input order."""
    formats = "GT:GQ:DR:DV" + ":PS" * phased
    kept = F.array_join(F.slice(F.split("line", "\t"), 1, 8), "\t")
    empty = "./.:0:0:0" + ":." * phased
    return lines.join(genotypes, "line_index", "left").select("line_index", F.concat_ws("\t", kept, F.lit(formats), F.coalesce("genotype", F.lit(empty))).alias("line")).orderBy("line_index")


def candidates_csv(calls: DataFrame) -> DataFrame:
    """(contig, pos, id, line) under CSV_HEADER: breakends with their orientations, others from start to end."""
    c = F.col
    orient = bnd_orientation(c("is_first"), c("is_reverse"))
    bnd = c("svtype") == "BND"
    columns = [
        c("svtype"),
        F.when(bnd, F.substring(orient, 1, 1)).otherwise("+"),
        c("contig"),
        c("pos"),
        F.when(bnd, F.substring(orient, 2, 1)).otherwise("-"),
        F.when(bnd, c("mate_contig")).otherwise(c("contig")),
        F.when(bnd, c("mate_pos")).otherwise(c("end")),
        c("filter"),
        c("support_inline"),
        c("support_split"),
        c("support_ref"),
    ]
    return calls.select("contig", "pos", "id", F.concat_ws(",", *(F.coalesce(x.cast("string"), F.lit("")) for x in columns)).alias("line"))


def clusters_bed(clusters: DataFrame) -> DataFrame:
    """(contig, start, end, name): one row for each cluster."""
    return clusters.groupBy("contig", "svtype", "cluster").agg(F.max("cluster_end").alias("end"), F.count("*").alias("n")).select("contig", F.col("cluster").alias("start"), "end", F.concat("svtype", F.lit(":"), F.col("n").cast("string")).alias("name"))
