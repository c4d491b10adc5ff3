"""Matching of calls: forced genotyping, population lookups, grouping across samples and what follows from groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import binned
from ..functions.storage import stored
from . import edits
from .grouping import combined  # noqa: F401

#: Samples whose depths of a bin are one array.
PACK = 64


def match_limit(size: Column, p: Params = DEFAULTS) -> Column:
    """Largest sum of position and length difference for calls of this length."""
    return F.least(p.combine_match * F.sqrt(size), F.lit(float(p.combine_match_max)))


def nearest(targets: DataFrame, calls: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``targets`` (target_id, contig, svtype, pos, svlen) with the nearest call (call_id, ...) of their type: distance and call_id, null if none is near enough.

    The difference of positions is at most the limit, so both sides meet in bins of that size: the
    targets in the bins around them, the calls in their own. Ties go to the smaller call_id.
    """
    reach = max(p.combine_match_max, p.genotype_match_bnd)
    at = binned(targets, F.col("pos") - reach, F.col("pos") + reach, 5 * reach)
    own = calls.select("contig", "svtype", F.floor(F.col("pos") / (5 * reach)).alias("_bin"), "call_id", F.col("pos").alias("_pos"), F.col("svlen").alias("_len"), *([F.col("mate_contig").alias("_mate")] if "mate_contig" in calls.columns else []))
    apart = F.abs(F.col("pos") - F.col("_pos"))
    sizes = F.abs(F.abs("svlen") - F.abs("_len"))
    limit = match_limit(F.least(F.abs("svlen"), F.abs("_len")), p)
    mate = (F.col("mate_contig") == F.col("_mate")) if "mate_contig" in calls.columns else F.lit(True)
    near = F.when(F.col("svtype") == "BND", (apart <= p.genotype_match_bnd) & mate).otherwise(apart + sizes <= limit)
    distance = F.when(F.col("svtype") == "BND", apart).otherwise(apart + sizes)
    met = at.join(own, ["contig", "svtype", "_bin"]).where(near)
    best = met.groupBy("target_id").agg(F.min(F.struct(distance.alias("distance"), "call_id")).alias("best"))
    return targets.join(best, "target_id", "left").select(*targets.columns, F.col("best.distance").alias("distance"), F.col("best.call_id").alias("call_id"))


def alike(a: Column, b: Column, share: float = DEFAULTS.combine_sequence_share) -> Column:
    """Whether the edit distance leaves more than ``share`` of the mean length. It is searched no further than that."""
    mean = (F.length(a) + F.length(b)) / 2
    found = edits.within(a, b, F.ceil(mean * (1 - share)))
    return F.coalesce(F.try_divide(mean - found, mean) > share, F.lit(False))


def population_annotated(calls: DataFrame, population: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """population_af and population_size of the nearest variant of the call's block and type; 0 where there is none.

    Where both sides have ``alt``, insertions have to be alike too: their edit distance leaves more than a share of the variant's length.
    """
    block = lambda c: F.floor(F.col(c) / p.block_size)
    sequences = "alt" in calls.columns and "alt" in population.columns
    near = population.select("contig", "svtype", block("pos").alias("_block"), F.col("pos").alias("_pos"), F.col("svlen").alias("_len"), "af", "genotyped_n", F.col("id").alias("_id"), *([F.col("alt").alias("_alt")] if sequences else []))
    met = calls.withColumn("_block", block("pos")).join(near, ["contig", "svtype", "_block"])
    distance = F.abs(F.col("pos") - F.col("_pos")) + F.abs(F.abs("svlen") - F.abs("_len"))
    met = met.where(distance <= match_limit(F.least(F.abs("svlen"), F.abs("_len")), p))
    if sequences:
        found = edits.within(F.col("alt"), F.col("_alt"), F.ceil(F.col("_len") * (1 - p.combine_sequence_share)))
        left = F.coalesce(F.try_divide(F.col("_len") - found, F.col("_len")) > p.combine_sequence_share, F.lit(False))
        met = met.where(F.when((F.col("svtype") == "INS") & F.col("alt").isNotNull() & F.col("_alt").isNotNull(), left).otherwise(True))
    best = met.groupBy("call_id").agg(F.min(F.struct(distance.alias("d"), F.col("_id").alias("id"), "af", "genotyped_n")).alias("b"))
    return calls.join(best, "call_id", "left").select(*calls.columns, F.coalesce(F.round("b.af", 5), F.lit(0.0)).alias("population_af"), F.coalesce("b.genotyped_n", F.lit(0)).cast("long").alias("population_size"))


def population_frequencies(genotypes: DataFrame, n_samples: int, p: Params = DEFAULTS) -> DataFrame:
    """(variant_id, af, genotyped_n, variant_n) of variants that enough samples are genotyped for."""
    known = F.col("gt_a").isNotNull() & F.col("gt_b").isNotNull()
    alleles = F.when(known, F.col("gt_a") + F.col("gt_b")).otherwise(0)
    x = genotypes.groupBy("variant_id").agg(F.sum(alleles).alias("alleles"), F.count_if(known).alias("genotyped_n"), F.count_if(alleles > 0).alias("variant_n"))
    return x.where(F.col("genotyped_n") / n_samples >= p.population_min_share).select("variant_id", F.try_divide(F.col("alleles"), 2 * F.col("genotyped_n")).alias("af"), "genotyped_n", "variant_n")


def absent_coverage(groups: DataFrame, members: DataFrame, samples: DataFrame, block_coverage: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(group_id, sample_id, depth): binned depth at the group's mean for every sample without a member, a row for each.

    ``samples`` is a small dimension, one array as a scalar subquery; a group's own ids are at most as many. Only missing samples become rows.
    """
    every = samples.agg(F.array_sort(F.collect_set("sample_id")).alias("_every")).scalar()
    own = members.groupBy("group_id").agg(F.collect_set("sample_id").alias("_own"))
    at = groups.select("group_id", "contig", coverage_key(p).alias("cov_bin"), every.alias("_every"))
    missing = at.join(own, "group_id", "left").withColumn("sample_id", F.explode(F.array_except("_every", F.coalesce("_own", F.array().cast(own.schema["_own"].dataType))))).drop("_own", "_every")
    depth = block_coverage.groupBy("sample_id", "contig", "cov_bin").agg(F.max("depth").alias("depth"))
    return missing.join(depth, ["sample_id", "contig", "cov_bin"], "left").select("group_id", "sample_id", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def sample_index(samples: DataFrame) -> DataFrame:
    """(sample_id, idx): samples numbered by id, a row each."""
    return samples.select("sample_id").distinct().withColumn("idx", F.row_number().over(W.orderBy("sample_id")) - 1)


def packed_depths(depth: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """(keys, depths array<array<int>>) of ``depth`` (keys, sample_id, depth): by a sample's number / PACK and its rest; null where a pack has none. One row a key, whatever the samples are."""
    packs = -(-index.count() // PACK)
    at = depth.join(F.broadcast(index), "sample_id").groupBy(*keys, F.floor(F.col("idx") / PACK).cast("int").alias("_pack"), (F.col("idx") % PACK).alias("_at")).agg(F.max("depth").cast("int").alias("_depth"))
    rows = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    spread = lambda name, n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(name, i))
    packed = at.groupBy(*keys, "_pack").agg(rows("_at", "_depth").alias("_m")).select(*keys, "_pack", spread(F.col("_m"), PACK).alias("_d"))
    return packed.groupBy(*keys).agg(rows("_pack", "_d").alias("_m")).select(*keys, spread(F.col("_m"), max(packs, 1)).alias("depths"))


def deep_samples(depth: DataFrame, keys: list[str], index: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(keys, deep array<long>): a bitmap of the samples that are deep enough to be genotyped as without the variant."""
    words = -(-index.count() // 64)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("idx") % 64).cast("int"))
    at = depth.where(F.col("depth") >= p.combine_null_depth).join(F.broadcast(index), "sample_id")
    held = at.groupBy(*keys, F.floor(F.col("idx") / 64).cast("int").alias("_word")).agg(F.bit_or(bit).alias("_bits")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(max(words, 1) - 1)), lambda w: F.coalesce(F.try_element_at(F.col("_m"), w), F.lit(0).cast("long")))
    return held.select(*keys, every.alias("deep"))


def coverage_key(p: Params = DEFAULTS) -> Column:
    """The bin of depth of a group's mean position."""
    return (F.floor(F.col("pos_mean") / p.coverage_bin) * p.coverage_bin).cast("long")


def every_cell(own: Column, n: int, absent) -> Column:
    """``own`` (array of structs that begin with idx) and ``absent(idx)`` for all other samples, by number."""
    missing = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.transform(own, lambda c: c["idx"]))
    return F.array_sort(F.concat(own, F.transform(missing, absent)))


def group_calls(members: DataFrame, block_coverage: DataFrame, samples: DataFrame, p: Params = DEFAULTS, min_share: float = 0.2, high_share: float = 0.0) -> DataFrame:
    """One call for each group that enough samples support: position, length and end of its best member, means, deviations and supp_vec.

    ``members``: call_id, sample_id, group_id, contig, svtype, pos, end, svlen, support, fwd, rev, precise, gt_a, gt_b, passed.
    Samples without a member are 0/0 if deep enough there, else unknown: a bit of the bin's bitmap, of the
    bins that have a group; a group is one row all along.
    """
    index = stored(sample_index(samples))
    n = index.count()
    alt = ["alt"] * ("alt" in members.columns)
    first = F.min(F.struct((-F.col("support")).alias("s"), "call_id", "pos", "end", "svlen", *alt)).alias("first")
    order = F.struct((F.col("gt_a") + F.col("gt_b")).alias("alleles"), "gt_a", "gt_b")
    # members are dealt and sorted once; the first of a sample's speaks for the sample
    keys = ["group_id", "contig", "svtype"]
    own, at = W.partitionBy(*keys, "idx"), ["support", "fwd", "rev", "precise"]
    dealt = members.join(F.broadcast(index), "sample_id", "left").select(*keys, "idx", "call_id", "pos", "end", "svlen", *alt, *at, "gt_a", "gt_b", "passed").repartition(*keys)
    told = dealt.withColumns({"_g": F.max(order).over(own), "_passed": F.max(F.coalesce("passed", F.lit(False))).over(own), "_nth": F.row_number().over(own.orderBy("idx"))})
    one = (F.col("_nth") == 1) & F.col("idx").isNotNull()
    x = told.groupBy(*keys).agg(
        first,
        F.count_if(one).alias("samples"),
        F.count_if(one & F.col("_passed")).alias("passing"),
        F.bround(F.avg("support")).cast("long").alias("support"),
        F.sum("fwd").alias("fwd"),
        F.sum("rev").alias("rev"),
        (F.avg(F.col("precise").cast("int")) > 0.5).alias("precise"),
        F.coalesce(F.stddev_samp("pos"), F.lit(0.0)).alias("stdev_pos"),
        F.coalesce(F.stddev_samp(F.abs("svlen")), F.lit(0.0)).alias("stdev_len"),
        F.avg("pos").alias("pos_mean"),
        F.collect_list(F.when(one, F.struct("idx", F.col("_g.gt_a").cast("int").alias("gt_a"), F.col("_g.gt_b").cast("int").alias("gt_b")))).alias("own"),
    )
    x = x.where((F.col("passing") > 0) & (F.col("passing") / n >= high_share) | (F.col("samples") / n >= min_share) & (F.col("samples") >= 2))
    x = stored(x.where((F.col("passing") > 0) & ((F.abs("first.svlen") >= p.screen) | (F.col("svtype") == "BND"))).withColumn("cov_bin", coverage_key(p)))
    deep = deep_samples(block_coverage.join(x.select("contig", "cov_bin").distinct(), ["contig", "cov_bin"], "left_semi"), ["contig", "cov_bin"], index, p)

    def absent(i: Column) -> Column:
        bit = F.call_function("shiftright", F.get("deep", F.floor(i / 64).cast("int")), (i % 64).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
        zero = F.when(bit, 0).cast("int")
        return F.struct(i.alias("idx"), zero.alias("gt_a"), zero.alias("gt_b"))

    out = x.join(deep, ["contig", "cov_bin"], "left").withColumn("cells", every_cell(F.col("own"), n, absent))
    has = lambda c: F.coalesce((c["gt_a"] + c["gt_b"]) > 0, F.lit(False))
    ac = F.aggregate("cells", F.lit(0).cast("long"), lambda k, c: k + F.when(has(c), c["gt_a"] + c["gt_b"]).otherwise(0))
    gt = lambda c: F.concat(F.coalesce(c["gt_a"].cast("string"), F.lit(".")), F.lit("/"), F.coalesce(c["gt_b"].cast("string"), F.lit(".")))
    out = out.withColumn("ac", ac)
    return out.select("group_id", "contig", "svtype", "first.pos", "first.end", "first.svlen", "samples", "support", "fwd", "rev", "precise", "stdev_pos", "stdev_len", F.array_join(F.transform("cells", lambda c: F.when(has(c), "1").otherwise("0")), "").alias("supp_vec"), F.array_join(F.transform("cells", gt), "\t").alias("genotypes"), "ac", F.when(F.col("ac") == 0, "GT").otherwise("PASS").alias("filter"), *(f"first.{c}" for c in alt))


def population_of(calls: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(id, contig, svtype, pos, end, svlen, af, genotyped_n, variant_n; alt if known) of combined calls that enough samples are genotyped for: what ``write_population`` stores."""
    cells = F.transform(F.split("genotypes", "\t"), lambda g: F.split(g, "/"))
    known = F.filter(cells, lambda g: (g[0] != ".") & (g[1] != "."))
    alleles = F.transform(known, lambda g: g[0].cast("int") + g[1].cast("int"))
    x = calls.withColumns({"_n": F.size(F.split("genotypes", "\t")), "_alleles": alleles}).withColumns({
        "genotyped_n": F.size("_alleles").cast("long"),
        "variant_n": F.size(F.filter("_alleles", lambda k: k > 0)).cast("long"),
        "af": F.try_divide(F.aggregate("_alleles", F.lit(0), lambda a, k: a + k), 2 * F.size("_alleles")),
    })
    kept = x.where(F.col("genotyped_n") / F.col("_n") >= p.population_min_share)
    return kept.select(F.col("group_id").alias("id"), "contig", "svtype", "pos", "end", "svlen", "af", "genotyped_n", "variant_n", *["alt"] * ("alt" in calls.columns))


def group_genotypes(members: DataFrame, depths: DataFrame, samples: DataFrame, p: Params = DEFAULTS, relabel: int | None = None, phased: bool = True) -> DataFrame:
    """(group_id, columns, supp_vec, ac): the sample columns GT:GQ:DR:DV[:PS]:ID of each group, by sample id.

    Of several members of a sample the highest genotype counts, and all are named. ``members``: group_id,
    sample_id, call_id, gt_a, gt_b, gq, dr, dv; ``depths`` (group_id, depths): ``packed_depths`` of the samples.
    With ``relabel``, genotypes of a lower quality become the highest one that a better quality has in the group.
    """
    index = sample_index(samples)
    n = index.count()
    rank = F.struct(F.coalesce("gt_a", F.lit(-1)).alias("ra"), F.coalesce("gt_b", F.lit(-1)).alias("rb"), "call_id", "gt_a", "gt_b", F.coalesce("gq", F.lit(0)).cast("long").alias("gq"), F.coalesce("dr", F.lit(0)).cast("long").alias("dr"), F.coalesce("dv", F.lit(0)).cast("long").alias("dv"))
    own = members.groupBy("group_id", "sample_id").agg(F.max(rank).alias("g"), F.array_join(F.array_sort(F.collect_set(F.col("call_id").cast("string"))), ",").alias("id"))
    own = own.join(F.broadcast(index), "sample_id").select("group_id", "idx", *(F.col(f"g.{c}").cast("int").alias(c) for c in ("gt_a", "gt_b")), *(F.col(f"g.{c}").alias(c) for c in ("gq", "dr", "dv")), "id")
    own = own.groupBy("group_id").agg(F.collect_list(F.struct("idx", "gt_a", "gt_b", "gq", "dr", "dv", "id")).alias("own"))

    def absent(i: Column) -> Column:
        depth = F.coalesce(F.get(F.get("depths", F.floor(i / PACK).cast("int")), (i % PACK).cast("int")), F.lit(0)).cast("long")
        zero, none = F.when(depth >= p.combine_null_depth, 0).cast("int"), F.lit(0).cast("long")
        return F.struct(i.alias("idx"), zero.alias("gt_a"), zero.alias("gt_b"), none.alias("gq"), depth.alias("dr"), none.alias("dv"), F.lit("NULL").alias("id"))

    each = own.join(depths, "group_id", "left").select("group_id", every_cell(F.col("own"), n, absent).alias("cells"))
    cells = F.col("cells")
    if relabel is not None:
        known = F.filter(cells, lambda c: (c["gq"] > relabel) & c["gt_a"].isNotNull())
        each = each.withColumn("_top", F.array_max(F.transform(known, lambda c: F.struct(c["gt_a"].alias("a"), c["gt_b"].alias("b")))))
        better = F.coalesce((F.col("_top.a") > 0) | (F.col("_top.b") > 0), F.lit(False))
        moved = lambda c: better & (c["gq"] < relabel) & c["gt_a"].isNotNull()
        cells = F.transform(cells, lambda c: c.withField("gt_a", F.when(moved(c), F.col("_top.a")).otherwise(c["gt_a"])).withField("gt_b", F.when(moved(c), F.col("_top.b")).otherwise(c["gt_b"])))
    said = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    text = lambda c: F.concat_ws(":", F.concat(said(c["gt_a"]), F.lit("/"), said(c["gt_b"])), c["gq"].cast("string"), c["dr"].cast("string"), c["dv"].cast("string"), *[F.lit(".")] * phased, c["id"])
    has = lambda c: c["gt_a"].isNotNull() & (c["dv"] > 0)
    alleles = F.aggregate(cells, F.lit(0), lambda n, c: n + F.when(has(c), c["gt_a"] + c["gt_b"]).otherwise(0))
    return each.select("group_id", F.array_join(F.transform(cells, text), "\t").alias("columns"), F.array_join(F.transform(cells, lambda c: F.when(has(c), "1").otherwise("0")), "").alias("supp_vec"), alleles.alias("ac"))


def majority_genotype(members: DataFrame) -> DataFrame:
    """(group_id, gt_a, gt_b): the commonest known genotype of a group; of several that with most alleles."""
    counted = members.where("gt_a is not null").groupBy("group_id", "gt_a", "gt_b").agg(F.count("*").alias("n"))
    over = W.partitionBy("group_id").orderBy(F.desc("n"), F.desc(F.col("gt_a") + F.col("gt_b")), F.desc("gt_b"))
    return counted.withColumn("r", F.row_number().over(over)).where("r = 1").select("group_id", "gt_a", "gt_b")


def supported(candidates: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    return candidates.where(F.col("support") >= p.min_support)


def needs_genotyping(version: Column, since: tuple[int, int, int] = (2, 5, 3)) -> Column:
    """Whether a store's version is below ``since``, compared by numbers."""
    parts = F.transform(F.split(version, r"\."), lambda x: F.coalesce(F.regexp_extract(x, r"^(\d+)", 1).try_cast("int"), F.lit(0)))
    return parts < F.array(*map(F.lit, since))
