"""The three entries: calling one sample, genotyping given variants, combining samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULTS, Params
from ..functions.intervals import depth_at
from ..functions.storage import stored
from ..functions.tasks import tasks
from ..operators import call, cluster, combine, consensus, extract, genotype, grid, qc, scan, text
from ..sources import readers, writers


#: A call's key: its cluster and, within it, the group of lengths, or of mates of breakends.
PART = [*call.KEYS, "sub"]


def reads_of(alignments: DataFrame, regions: DataFrame | None = None, p: Params = DEFAULTS) -> DataFrame:
    """Usable alignments in what calling needs of them: tags, mismatch rate, the leads within their CIGAR and, as ``cigar``, its first and last operation. Stored, so that alignments are read once."""
    ops = F.col("_ops")  # a column of its own: the CIGAR is parsed once for all that is told from it
    parsed = scan.scan(alignments, regions, p).withColumn("_ops", scan.cigar_ops(F.col("cigar")))
    used = extract.inline_events(scan.mismatch_rate(parsed, ops), p, ops=ops)
    told = lambda x: F.concat(x["len"].cast("string"), x["op"])
    ends = F.concat(told(F.get(ops, F.lit(0))), F.when(F.size(ops) > 1, told(F.element_at(ops, -1))).otherwise(""))
    is_sa = (F.col("flag").bitwiseAND(2048) != 0).alias("is_sa")
    return stored(used.select("aln_idx", "read_qname", "flag", "contig", "ref_start", "ref_end", "mapq", ends.alias("cigar"), "query_length", "qry_start", "qry_end", "sa", F.coalesce("hp", F.lit(0)).alias("hap"), F.col("ps").alias("phase_set"), "nm", "nm_rate", is_sa, "inline"))


def spans_of(alignments: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Where usable alignments lie; stored, so that they are read once."""
    return stored(scan.scan(alignments, p=p).select("contig", "ref_start", "ref_end"))


def leads_of(reads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """All leads of ``reads_of``: inline, split and breakend ones. Each carries its read's tags, so nothing is joined."""
    strand = F.when(F.col("flag").bitwiseAND(16) == 0, "+").otherwise("-")
    tag = F.struct("read_qname", "hap", "phase_set", "is_sa", F.col("nm_rate").alias("nm"), F.col("query_length").alias("read_len"))
    x = reads.withColumns({"tag": tag, "own": F.struct("mapq", strand.alias("strand"))})
    inline = extract.inline_leads(x, p, carried=("tag",)).drop("read_qname")
    split = extract.split_leads(x, p, ("tag",))
    bnd = extract.breakends(x, ("tag", "own"))
    bnd = bnd.select("aln_idx", "contig", F.lit("BND").alias("svtype"), F.col("ref_start").alias("lead_start"), F.col("ref_start").alias("lead_end"), F.lit(0).cast("long").alias("svlen"), "own.strand", "own.mapq", F.lit("BND_SA").alias("source"), "mate_contig", "mate_ref_start", "is_first", "is_reverse", "tag")
    found = inline.unionByName(split, allowMissingColumns=True).unionByName(bnd, allowMissingColumns=True)
    named = {"lead_start": "ref_start", "lead_end": "ref_end", "lead_qry_start": "qry_start", "lead_qry_end": "qry_end"}
    return found.withColumnsRenamed(named).select("*", "tag.*").drop("tag").withColumn("read_id", F.xxhash64("read_qname"))


def parts_of(found: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """The leads of known length of clusters, with ``sub``: fragments of one event on a read joined (INS, DEL), clusters split by length, breakends by mate. ``found``: a table or stored; its clusters are dealt once, each step works on them there."""
    carried = tuple(c for c in found.columns if c not in {*call.KEYS, "read_qname", "ref_start", "svlen", "seq"})
    n = tasks(found)
    of = lambda types: found.where(f"svlen is not null and svtype {types}").repartition(n, *call.KEYS)
    whole = cluster.split_by_length(cluster.merged_fragments(of("in ('INS', 'DEL')"), call.KEYS, p, carried), call.KEYS, p)
    sized = whole.unionByName(cluster.split_by_length(of("not in ('INS', 'DEL', 'BND')"), call.KEYS, p), allowMissingColumns=True)
    mates = cluster.bnd_parts(of("= 'BND'"), call.KEYS, p).withColumn("sub", F.concat_ws(":", "mate_contig", F.col("is_first").cast("string"), F.col("part").cast("string")))
    return sized.withColumn("sub", F.col("length_key").cast("string")).unionByName(mates, allowMissingColumns=True)


def with_sequences(calls: DataFrame, leads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """``alt``: of insertions the sequence of the nearest lead, or the consensus if enough others have one; else what is there.

    ``grid.cap_sequences`` has left few leads of a bin their sequence, so those of a call are few.
    """
    bounded = leads.where("svtype = 'INS' and seq is not null").withColumn("nth", F.row_number().over(W.partitionBy(*PART).orderBy("aln_idx", "ref_start")))
    best = call.ins_representative(bounded, calls.where("svtype = 'INS'").select(*PART, "svlen", "pos"), PART, "nth")
    others = bounded.join(best.select(*PART, "lead"), PART).where(F.col("nth") != F.col("lead"))
    others = others.groupBy(*PART).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "seq"))), lambda x: x["seq"]).alias("others"))
    held = best.join(others, PART, "left").select(*PART, F.col("seq").alias("best"), F.coalesce("others", F.array().cast("array<string>")).alias("others"))
    return calls.join(consensus.with_consensus(held).select(*PART, F.col("alt").alias("_seq")), PART, "left").withColumn("alt", F.coalesce("_seq", "alt")).drop("_seq")


def call_sample(alignments: DataFrame, contigs: DataFrame, regions: DataFrame | None = None, repeats: DataFrame | None = None, p: Params = DEFAULTS, keep_failed: bool = False, mosaic: bool = False, measure_nm: bool = False, reference: DataFrame | None = None, chunk: int = 0, reads: DataFrame | None = None, steps: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Genotyped, filtered calls of a sample, in order of contig, position and id, unless not ``ordered``. With ``reference`` (contig, chunk_no, seq in chunks of ``chunk``) there is no depth where it has N.

    ``reads`` and ``steps``: ``reads_of`` the alignments and their coverage, where the caller has them.
    """
    p = p.for_mosaic() if mosaic else p
    reads = reads_of(alignments, regions, p) if reads is None else reads
    leads = stored(leads_of(reads, p))
    steps = grid.coverage(reads) if steps is None else steps
    if reference is not None:
        steps = grid.masked(steps, grid.n_runs(reference, chunk))
    seeds = leads.withColumn("seed", grid.bin_of("ref_start", p.bin_size))
    if repeats is None:
        seeds = seeds.withColumn("repeat", F.lit(False))
    # clusters hold whole bins, so sequences are capped where leads meet their bin's cluster: the same exchange
    clustered = cluster.greedy_clusters(seeds, ["read_qname", "svlen"], p, repeats=repeats)
    found = stored(grid.cap_sequences(clustered, ["aln_idx", "ref_start", "svlen"], p).drop("seed"))
    known = stored(parts_of(found, p))
    parts = tasks(known)
    counts = call.lead_counts(known, found.where("svlen is null"), PART, call.KEYS, p)
    calls = call.candidates(known, PART, p, parts).join(counts, PART)
    long_ins = (F.col("svtype") == "INS") & (F.col("svlen") >= p.long_ins_length)
    calls = calls.withColumns({
        "support": F.when(long_ins, F.col("support_all")).otherwise(F.col("support")),
        "support_long": F.when(F.col("svtype") == "INS", F.when(long_ins, F.col("support_long")).otherwise(0)),
        "support_sa": F.when(F.col("svtype") == "DEL", F.col("support_split")),
        "alt": F.concat(F.lit("<"), "svtype", F.lit(">")),
    })
    mates = call.resolve_bnd(known.where("svtype = 'BND'"), PART).withColumnsRenamed({"support": "mate_support", "alt": "mate_alt"})
    calls = calls.join(mates, PART, "left").withColumns({"support": F.coalesce("mate_support", "support"), "alt": F.coalesce("mate_alt", "alt")}).drop("mate_support", "mate_alt")
    calls = calls.join(F.broadcast(contigs.select("contig", "contig_idx").distinct()), "contig")
    # a row a call, stored where the next steps use it more than once: plans would double with each
    calls = stored(call.call_ids(calls, ["pos", "cluster", "sub"]).withColumn("call_id", F.concat_ws(":", "contig", "id")))
    calls = stored(grid.with_coverage(calls, steps, p).withColumn("coverage_var", F.lit(0.0)))
    calls = with_sequences(calls, known, p)
    first = qc.first_filter(qc.call_rules(p, mosaic) + ([] if mosaic else qc.support_rule(p)))
    k, n = genotype.observed(p)
    calls = genotype.genotyped(calls.withColumn("filter", first), k, n, p, mosaic)
    votes = genotype.phase_votes(known, PART, "aln_idx", p, parts).select(*PART, "hp", "ps", "hp_support", "ps_support", "hp_filter", "ps_filter", "phase", "haplotype")
    calls = genotype.hom_alt_phased(calls.join(votes, PART, "left"))
    regional = scan.regional_rate(reads)
    calls = calls.join(F.broadcast(regional), "contig", "left")
    after = F.when(F.col("gt_filter") != "PASS", F.col("gt_filter")).otherwise(qc.first_filter(qc.genotype_rules(p, mosaic, nm=measure_nm)))
    calls = calls.withColumn("filter", F.when(F.col("filter") != "PASS", F.col("filter")).otherwise(after))
    calls = genotype.phase_rescued(with_haplotypes(stored(calls), found, reads, p))
    calls = calls if keep_failed else calls.where("filter = 'PASS'")
    return calls.orderBy("contig_idx", "pos", "id") if ordered else calls


def with_haplotypes(calls: DataFrame, found: DataFrame, reads: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """hap_support and hap_reads: leads and reads of the call's haplotype in the first bin of its cluster (``found``: the leads of clusters); null without a passing one."""
    first = found.where(grid.bin_of("ref_start", p.bin_size) == F.col("cluster"))
    own = grid.lead_bins(first, p).select("contig", "svtype", F.col("bin").alias("cluster"), F.col("hap1").alias("own1"), F.col("hap2").alias("own2"))
    hap = F.when(F.col("hp_filter") == "PASS", F.when(F.col("hp").isin("1", "2"), F.col("hp").cast("int")))
    x = calls.withColumn("hap", hap).join(own, call.KEYS, "left").withColumn("hap_support", F.when(F.col("hap") == 1, F.col("own1")).when(F.col("hap") == 2, F.col("own2"))).drop("own1", "own2")
    points = x.where("hap is not null").select("contig", "hap", "cluster").distinct()
    spans = depth_at(points, grid.hap_steps(reads, p).where("hap > 0"), ["contig", "hap"], "cluster", 10_000)
    return x.join(spans.withColumnRenamed("depth", "hap_reads"), ["contig", "hap", "cluster"], "left").drop("hap")


def vcf_of(calls: DataFrame, reference: DataFrame | None = None, chunk: int = 0, p: Params = DEFAULTS, prefix: str = "", phased: bool = True, mosaic: bool = False, measure_nm: bool = False) -> DataFrame:
    """(contig, pos, id, line) of a sample's calls; with ``reference`` (contig, chunk_no, seq in chunks of ``chunk``) REF and ALT are bases."""
    calls = calls.withColumn("ref", F.lit("N"))
    if reference is not None:
        whole = (F.col("svtype") == "DEL") & (F.abs("svlen") <= p.long_del_length)
        bases = readers.sequences(calls.select("call_id", "contig", F.greatest(F.col("pos") - 1, F.lit(0)).alias("start"), F.when(whole, F.col("pos") - F.col("svlen")).otherwise(F.greatest("pos", F.lit(1))).alias("end")), reference, chunk, "call_id")
        calls = calls.join(bases, "call_id", "left").withColumns({"anchor": F.substring("bases", 1, 1), "deleted": F.when(whole & (F.col("pos") > 0), F.col("bases"))})
        calls = text.resolved(calls, p).drop("anchor", "deleted", "bases")
    calls = qc.emitted(calls.withColumn("supp_vec", F.lit(None).cast("string")), p).drop("supp_vec")
    return text.vcf_lines(calls, genotype.genotype_string(phased), prefix, phased, mosaic, measure_nm, p=p)


def genotype_variants(alignments: DataFrame, contigs: DataFrame, variants: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """(line_index, gt_a, gt_b, gq, dr, dv, call_id): the nearest call's genotype for every variant of ``variants`` (of ``readers.vcf``); else 0/0 where covered."""
    reads = reads_of(alignments, p=p)
    steps = stored(grid.coverage(reads))  # for the calls and for the variants
    calls = stored(call_sample(alignments, contigs, p=p, keep_failed=True, reads=reads, steps=steps, ordered=False))
    targets = variants.withColumn("target_id", F.col("line_index"))
    mate = ["mate_contig"] * ("mate_contig" in targets.columns)
    near = combine.nearest(targets.select("target_id", "contig", "svtype", "pos", "svlen", *mate), calls.select("call_id", "contig", "svtype", "pos", "svlen", *mate), p)
    depth = grid.with_coverage(variants.select(F.col("line_index").alias("call_id"), "contig", "svtype", "pos", "end"), steps, p)
    depth = depth.select(F.col("call_id").alias("target_id"), F.greatest("cov_start", "cov_center", "cov_end").alias("depth"))
    found = near.select("target_id", "call_id").join(calls.select("call_id", "gt_a", "gt_b", "gq", "dr", "dv"), "call_id", "left").join(depth, "target_id", "left")
    zero = F.when(F.col("depth") > 0, 0).cast("int")
    alone = F.col("call_id").isNull()
    return found.select(F.col("target_id").alias("line_index"), *(F.when(alone, zero).otherwise(F.col(c)).alias(c) for c in ("gt_a", "gt_b")), F.coalesce("gq", F.lit(0)).alias("gq"), F.coalesce("dr", F.when(alone, F.col("depth")), F.lit(0)).alias("dr"), F.coalesce("dv", F.lit(0)).alias("dv"), "call_id")


def combine_samples(candidates: DataFrame, block_coverage: DataFrame, samples: DataFrame, p: Params = DEFAULTS, one_per_sample: bool = False, relabel: int | None = None) -> DataFrame:
    """One call for each group of candidates across samples; with the samples' columns of a record where candidates have gq, dr and dv."""
    samples = stored(samples.select("sample_id").distinct())
    kept = stored(combine.supported(candidates, p))
    n = samples.count()
    members = stored(combine.combined(kept, n, p, one_per_sample))
    calls = combine.group_calls(members, block_coverage, samples, p)
    if not {"gq", "dr", "dv"} <= set(members.columns):
        return calls
    calls = stored(calls)
    emitted = members.join(calls.select("group_id"), "group_id", "left_semi")  # depths are fetched for these alone
    at = emitted.groupBy("group_id", "contig").agg(F.avg("pos").alias("pos_mean")).withColumn("cov_bin", combine.coverage_key(p))
    bins = ["contig", "cov_bin"]
    packed = combine.packed_depths(block_coverage.join(at.select(*bins).distinct(), bins, "left_semi"), bins, combine.sample_index(samples))
    told = combine.group_genotypes(emitted, at.join(packed, bins).select("group_id", "depths"), samples, p, relabel)
    return calls.drop("supp_vec", "ac", "filter").join(told, "group_id").where(F.contains("supp_vec", F.lit("1"))).withColumn("filter", F.when(F.col("ac") == 0, "GT").otherwise("PASS"))


def stored_sample(calls: DataFrame, alignments: DataFrame, path: str, sample_id: str, p: Params = DEFAULTS) -> None:
    """Writes the store of a sample: all its calls, failed ones too, and its binned depth."""
    kept = calls.select("call_id", *CANDIDATE, (F.col("filter") == "PASS").alias("passed"))
    writers.write_sample(kept, grid.coverage_bins(grid.coverage(spans_of(alignments, p)), p), path, sample_id, p=p)


#: What a store keeps of a call.
CANDIDATE = "contig svtype pos end svlen support support_sa qual precise fwd rev stdev_pos stdev_len alt mate_contig mate_pos cov_upstream cov_start cov_center cov_end cov_downstream gt_a gt_b gq dr dv vaf".split()


def combined_population(calls: DataFrame, path: str, p: Params = DEFAULTS) -> None:
    """Stores the variants of ``combine_samples`` and their frequencies, for ``population_annotated`` of later samples."""
    writers.write_population(combine.population_of(calls, p), path, p)


def combine_stores(spark: SparkSession, paths: list[str], names: dict[str, str] | None = None, population: DataFrame | None = None, p: Params = DEFAULTS, one_per_sample: bool = False) -> DataFrame:
    """``combine_samples`` over stores; calls of old stores are genotyped anew. With ``population``, its frequencies too."""
    found, depth, samples = readers.sample_stores(spark, paths, names, p=p)
    found = found.withColumn("call_id", F.concat_ws(":", "sample_id", "call_id"))
    old = combine.needs_genotyping(F.col("version"))
    k, n = genotype.observed(p)
    told = ["gt_a", "gt_b", "gq", "z", "dr", "dv", "vaf", "gt_filter"]
    again = genotype.genotyped(found.where(old).drop(*told), k, n, p).drop("z", "gt_filter")
    found = found.where(~old).unionByName(again)
    calls = combine_samples(found, depth, samples, p, one_per_sample)
    if population is None:
        return calls
    return combine.population_annotated(calls.withColumn("call_id", F.col("group_id")), population, p).drop("call_id")
