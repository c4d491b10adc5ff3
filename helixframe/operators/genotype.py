"""Genotype likelihoods, phasing and phase rescue as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from .qc import rescaled


def mean_of(*values: Column) -> Column:
    """Mean of the values that are not 0, rounded half to even; null if all are 0."""
    kept = F.filter(F.array(*(v.cast("double") for v in values)), lambda x: x != 0)
    return F.when(F.size(kept) > 0, F.bround(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)))


def observed(p: Params = DEFAULTS) -> tuple[Column, Column]:
    """Support and depth that the genotype is told from, by type."""
    c, svtype = F.col, F.col("svtype")
    long_ins = (svtype == "INS") & (c("svlen") >= p.long_ins_length)
    k = F.when(long_ins, rescaled(c("support"), c("svlen"), p)).otherwise(c("support"))
    start, mid, end, up, down = (c(f"cov_{x}") for x in ("start", "center", "end", "upstream", "downstream"))
    n = (
        F.when(svtype == "INS", mean_of(mid))
        .when(svtype == "DUP", mean_of(start, end) + F.bround(k * 0.75))
        .when(svtype == "INV", mean_of(up, down) + F.bround(k * 0.5))
        .when(svtype == "DEL", mean_of(*(x + F.coalesce("support_sa", F.lit(0)) for x in (start, mid, end))))
        .otherwise(mean_of(start, mid, end))
    )
    return k, n


def genotyped(calls: DataFrame, k: Column, n: Column, p: Params = DEFAULTS, mosaic: bool = False) -> DataFrame:
    """gt_a, gt_b, gq, z, dr, dv, vaf and gt_filter from ``k`` reads of ``n``; null where there is no depth."""
    names = [x for x in calls.columns]
    x = calls.withColumns({"_k": k.cast("double"), "_n": F.greatest(n, k).cast("double")}).withColumn("_n", F.when(n.isNotNull(), F.col("_n")))
    scale = p.genotype_max_depth / F.col("_n")
    deep = F.col("_n") > p.genotype_max_depth
    x = x.withColumns({"_ks": F.when(deep, F.bround(F.col("_k") * scale)).otherwise(F.col("_k")), "_ns": F.when(deep, F.bround(F.col("_n") * scale)).otherwise(F.col("_n"))})
    chance = lambda q: F.pow(F.lit(q), F.col("_ks")) * F.pow(F.lit(1 - q), F.col("_ns") - F.col("_ks"))
    error = p.genotype_error
    options = F.array(*(F.struct((-chance(q)).alias("m"), F.lit(i).alias("rank"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (q, a, b) in enumerate([(error, 0, 0), (0.5, 0, 1), (1 - error, 1, 1)])))
    x = x.withColumns({"_o": F.array_sort(options), "_ref": chance(error)})
    best = lambda i: -F.get("_o", F.lit(i))["m"]
    total = best(0) + best(1) + best(2)

    def phred(a: Column) -> Column:
        ratio = F.try_divide(F.try_divide(a, total), F.try_divide(best(0), total))
        return F.least(F.lit(60), (-10 * F.when(ratio > 0, F.log10(ratio)).otherwise(0.0)).cast("int"))

    known = F.col("_n").isNotNull() & (F.col("_n") > 0)
    x = x.withColumns({"gq": F.when(known, phred(best(1))), "z": F.when(known, phred(F.col("_ref"))), "_a": F.when(known, F.get("_o", F.lit(0))["a"]), "_b": F.when(known, F.get("_o", F.lit(0))["b"])})
    vaf = F.when(known, F.try_divide(F.col("_k"), F.col("_n")))
    dup = (F.col("svtype") == "DUP") & (vaf >= p.dup_min_vaf)
    long_ins = (F.col("svtype") == "INS") & (F.col("svlen") >= p.long_ins_length)
    weak = (F.col("z") < p.genotype_min_z) & ~long_ins & ~dup & F.lit(not mosaic)
    return x.select(
        *names,
        F.col("_a").cast("int").alias("gt_a"),
        F.when(dup & (F.col("_a") == 0) & (F.col("_b") == 0), 1).otherwise(F.col("_b")).cast("int").alias("gt_b"),
        F.col("gq").cast("int").alias("gq"),
        F.col("z").cast("int").alias("z"),
        F.when(known, F.col("_n") - F.col("_k")).cast("long").alias("dr"),
        F.when(known, F.col("_k")).cast("long").alias("dv"),
        vaf.alias("vaf"),
        F.when(~known | F.col("_n").isNull(), "GT_FAILED").when(weak, "GT").otherwise("PASS").alias("gt_filter"),
    )


def phase_votes(leads: DataFrame, keys: list[str], order: str, p: Params = DEFAULTS, parts: int | None = None) -> DataFrame:
    """(keys, hp, hp_support, hp_filter, ps, ps_support, ps_filter, phase, haplotype): one vote for each read, that of its last lead. Leads are dealt by ``keys`` once, to ``parts`` tasks; all else is done there."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NULL"))
    mine = leads.select(*keys, "read_id", F.struct(F.col(order), told("hap").alias("hp"), told("phase_set").alias("ps")).alias("v"))
    dealt = mine.repartition(parts, *keys) if parts else mine.repartition(*keys)
    votes = dealt.groupBy(*keys, "read_id").agg(F.max("v").alias("v"))
    cast = F.array(*(F.struct(F.lit(c).alias("of"), F.col(f"v.{c}").alias("name")) for c in ("hp", "ps")))
    counted = votes.select(*keys, F.explode(cast).alias("c")).groupBy(*keys, "c.of", "c.name").agg(F.count("*").alias("n"))
    own = W.partitionBy(*keys, "of")
    ranked = counted.withColumns({"r": F.row_number().over(own.orderBy(F.desc("n"), F.desc("name"))), "known": F.sum(F.when(F.col("name") != "NULL", F.col("n")).otherwise(0)).over(own)})
    other = F.col("known") - F.when(F.col("name") != "NULL", F.col("n")).otherwise(0)
    good = (F.col("name") != "NULL") & (F.try_divide(other, F.col("n") + other) < p.phase_conflict)
    top = ranked.where("r = 1").select(*keys, "of", F.struct("name", F.col("n").alias("support"), F.when(good, "PASS").otherwise("FAIL").alias("filter")).alias("top"))
    x = top.groupBy(*keys).agg(*(F.max(F.when(F.col("of") == c, F.col("top"))).alias(f"_{c}") for c in ("hp", "ps")))
    x = x.select(*keys, *(F.col(f"_{c}.{f}").alias(n) for c in ("hp", "ps") for f, n in (("name", c), ("support", f"{c}_support"), ("filter", f"{c}_filter"))))
    return x.withColumns({"phase": phase_text(F.col("hp_filter")), "haplotype": F.when((F.col("hp_filter") == "PASS") & F.col("hp").isin("1", "2"), F.col("hp"))})


def phase_rescued(calls: DataFrame, share: float = 0.75, least: int = 3, longest: int = 10_000, max_nm: float = 0.05) -> DataFrame:
    """A MOSAIC_VAF call that most reads of its haplotype carry passes, and is heterozygous. hap_reads: all reads of the haplotype there; hap_support: those that carry it."""
    carried = (F.col("filter") == "MOSAIC_VAF") & (F.col("support") >= least) & (F.abs("svlen") <= longest) & (F.col("nm") <= max_nm) & (F.col("n_leads") > 3) & (F.try_divide(F.col("hap_support"), F.col("hap_reads")) >= share)
    hit = F.coalesce(carried, F.lit(False))
    return calls.withColumns({"filter": F.when(hit, "PASS").otherwise(F.col("filter")), "gt_b": F.when(hit, 1).otherwise(F.col("gt_b"))})


def hom_alt_phased(calls: DataFrame) -> DataFrame:
    """``calls`` with hp, ps and the phase columns: conflicting haplotypes do not fail a homozygous call, unless its reads are unphased."""
    hom = F.coalesce((F.col("gt_a") == 1) & (F.col("gt_b") == 1) & F.col("hp").isNotNull() & (F.col("hp") != "0"), F.lit(False))
    good = F.when(hom, "PASS").otherwise(F.col("hp_filter"))
    return calls.withColumns({
        "haplotype": F.when(hom & (F.col("hp") != "NULL"), F.col("hp")).otherwise(F.col("haplotype")),
        "phase_set": F.when((hom | (F.col("ps_filter") == "PASS")) & (F.col("ps") != "NULL"), F.col("ps")),
        "phase": phase_text(good),
        "hp_filter": good,
    })


def phase_text(hp_filter: Column) -> Column:
    return F.concat_ws(",", "hp", "ps", F.col("hp_support").cast("string"), F.col("ps_support").cast("string"), hp_filter, "ps_filter")


def genotype_string(phased: bool = True, with_id: bool = False) -> Column:
    """GT:GQ:DR:DV[:PS][:ID]; heterozygous calls on haplotype 1 are written 1|0. Calls without the variant are not phased."""
    c = F.col
    text = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    bar = F.when(F.lit(phased) & c("haplotype").isNotNull() & c("gt_a").isin(0, 1) & (c("gt_b") == 1), "|").otherwise("/")
    swap = c("haplotype").eqNullSafe("1") & (c("gt_a") == 0) & (c("gt_b") == 1)
    a, b = F.when(swap, c("gt_b")).otherwise(c("gt_a")), F.when(swap, c("gt_a")).otherwise(c("gt_b"))
    parts = [F.concat(text(a), bar, text(b)), F.coalesce(c("gq"), F.lit(0)).cast("string"), F.coalesce(c("dr"), F.lit(0)).cast("string"), F.coalesce(c("dv"), F.lit(0)).cast("string")]
    parts += [text(c("phase_set"))] if phased else []
    parts += [F.coalesce("id", F.lit("NULL"))] if with_id else []
    return F.concat_ws(":", *parts)
