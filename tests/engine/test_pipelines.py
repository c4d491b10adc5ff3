"""The entries from alignments to calls and records, on planted variants."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe.config import Params
from helixframe.operators import cluster, combine, genotype, grid, scan
from helixframe.plans import pipelines
from helixframe.sources import readers

SCHEMA = "aln_idx long, read_qname string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, seq string, query_length int, qry_start int, qry_end int, sa string, hp int, ps string, nm int"
CONTIG, LENGTH = "chr1", 400_000
INSERTED = "ACGTTGCA" * 25


class Reads:
    def __init__(self):
        self.rows = []

    def add(self, name, start, cigar, flag=0, sa=None, hp=None, contig=CONTIG, nm=0, inserted=""):
        """The cigar is a list of (length, op); the read's bases are A but for what is inserted."""
        n = lambda ops: sum(k for k, o in cigar if o in ops)
        clip = lambda x: x[0] if x[1] == "S" else 0
        seq, left = "", list(inserted if isinstance(inserted, list) else [inserted])
        for k, o in cigar:
            if o in "MS":
                seq += "A" * k
            elif o == "I":
                seq += left.pop(0)
        size = n("MIS")
        self.rows.append((len(self.rows), name, flag, contig, start, start + n("MD"), 60, "".join(f"{k}{o}" for k, o in cigar), seq, size, clip(cigar[0]), size - clip(cigar[-1]), sa, hp, "7" if hp else None, nm))


def planted():
    r = Reads()
    for i in range(40):  # plain reads, so that everything has depth
        r.add(f"plain{i}", 1_000 + 5_000 * i, [(20_000, "M")], flag=16 * (i % 2))
    for i in range(10):  # a deletion of 300 at 50000, on haplotype 1
        r.add(f"del{i}", 46_000 + 10 * i, [(4_000 - 10 * i, "M"), (300, "D"), (4_000, "M")], flag=16 * (i % 2), hp=1)
    for i in range(10):  # an insertion of 200 at 80000
        r.add(f"ins{i}", 76_000, [(4_000, "M"), (200, "I"), (4_000, "M")], flag=16 * (i % 2), inserted=INSERTED)
    for i in range(8):  # one insertion of 120 in two pieces, 30 apart on the read
        r.add(f"two{i}", 116_000, [(4_000, "M"), (60, "I"), (30, "M"), (60, "I"), (4_000, "M")], flag=16 * (i % 2), inserted=["C" * 60, "G" * 60])
    for i in range(8):  # breakends to two mates from one place
        other = "chr2" if i < 4 else "chr3"
        r.add(f"bnd{i}", 150_000, [(3_000, "M"), (3_000, "S")], flag=16 * (i % 2), sa=f"{other},{90_001},{'-+'[i % 2]},3000M3000S,60,0;")
    for i in range(6):  # an insertion of 3000, which most reads only reach into
        r.add(f"long{i}", 196_000, [(4_000, "M"), (3_000, "I"), (4_000, "M")], flag=16 * (i % 2), inserted="T" * 3_000)
    for i in range(5):
        r.add(f"reach{i}", 196_000, [(4_000, "M"), (2_000, "S")], flag=16 * (i % 2))
    return r.rows


@pytest.fixture(scope="module")
def tables(spark):
    contigs = spark.createDataFrame([(c, LENGTH, i) for i, c in enumerate(("chr1", "chr2", "chr3"))], "contig string, length long, contig_idx int")
    return spark.createDataFrame(planted(), SCHEMA), contigs


@pytest.fixture(scope="module")
def calls(tables):
    return {(r["svtype"], r["mate_contig"], r["pos"] // 1000): r for r in pipelines.call_sample(*tables, keep_failed=True).collect()}


def test_plain_calls(calls):
    gone = calls["DEL", None, 50]
    assert (gone["pos"], gone["end"], gone["svlen"], gone["support"], gone["filter"], gone["precise"]) == (50_000, 50_300, -300, 10, "PASS", True)
    assert gone["support_sa"] == 0 and gone["phase"].startswith("1,7,10,10,PASS,PASS") and (gone["fwd"], gone["rev"]) == (5, 5)
    more = calls["INS", None, 80]
    assert (more["pos"], more["svlen"], more["support"], more["alt"], more["support_long"]) == (80_000, 200, 10, INSERTED, 0)


def test_fragments_of_a_read_are_one_event(calls):
    two = calls["INS", None, 120]
    assert (two["svlen"], two["support"], two["alt"], two["stdev_len"]) == (120, 8, "C" * 60 + "G" * 60, 0.0)
    assert sum(k[0] == "INS" and k[2] == 120 for k in calls) == 1


def test_breakends_split_by_mate(calls):
    ends = {k[1]: r for k, r in calls.items() if k[0] == "BND"}
    assert set(ends) == {"chr2", "chr3"} and all(r["support"] == 4 for r in ends.values())
    assert ends["chr2"]["alt"] == "N]chr2:93000]" and ends["chr3"]["alt"] == "N]chr3:93000]" and ends["chr2"]["pos"] == 153_000


def test_long_reads_support_long_insertions(calls):
    long = calls["INS", None, 200]
    assert (long["svlen"], long["support_long"], long["support"]) == (3_000, 5, 11)


def test_alignments_are_read_once(spark, tables, tmp_path):
    """One scan of the stored alignments makes the reads; nothing after it goes back to them, and leads need no join."""
    tables[0].write.parquet(str(tmp_path / "a"))
    seen = []
    real = pipelines.stored
    pipelines.stored = lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or real(df)
    try:
        calls = pipelines.call_sample(spark.read.parquet(str(tmp_path / "a")), tables[1], keep_failed=True)
    finally:
        pipelines.stored = real
    seen.append(calls._jdf.queryExecution().executedPlan().toString())
    assert sum(plan.count(f"file:{tmp_path}/a") for plan in seen) == seen[0].count(f"file:{tmp_path}/a") == 1
    assert "Join" not in seen[1] and "Generate explode(inline" in seen[1]


def test_haplotypes_of_calls(calls):
    gone = calls["DEL", None, 50]
    assert (gone["hap_support"], gone["hap_reads"]) == (10, 10)
    assert calls["INS", None, 80]["hap_reads"] is None


def test_only_passing_calls_stay(tables, calls):
    kept = pipelines.call_sample(*tables).collect()
    assert {r["filter"] for r in kept} == {"PASS"} and len(kept) == sum(r["filter"] == "PASS" for r in calls.values())
    assert [r["pos"] for r in kept] == sorted(r["pos"] for r in kept)


def test_regional_rate_leaves_out_reads_without_nm(spark):
    r = Reads()
    for i in range(4):
        r.add(f"a{i}", 1_000 * i, [(100, "S"), (1_899, "M"), (50, "I"), (50, "M")], nm=[250, None][i % 2], inserted="A" * 50)
        r.add(f"b{i}", 1_000 * i, [(2_000, "M")], nm=None, contig="chr2")
    rates = {x["contig"]: x["regional_nm"] for x in scan.regional_rate(spark.createDataFrame(r.rows, SCHEMA)).collect()}
    assert rates == {"chr1": 200 / 2_000, "chr2": 0.0}  # long insertions do not count, clipped bases are not aligned


def test_mosaic_calls_join_lengths_further_apart(spark, tables):
    assert Params().for_mosaic().merge_len == 0.27 and Params(merge_len=0.1).for_mosaic().merge_len == 0.1
    r = Reads()
    for i in range(40):
        r.add(f"plain{i}", 1_000 + 3_000 * i, [(20_000, "M")], flag=16 * (i % 2))
    for i in range(12):  # insertions of 1000 and of 1240: further apart than 0.22 of the shorter, not than 0.27
        n = 1_000 + 240 * (i % 2)
        r.add(f"ins{i}", 46_000, [(4_000, "M"), (n, "I"), (4_000, "M")], flag=16 * (i // 2 % 2), inserted="C" * n)
    x = spark.createDataFrame(r.rows, SCHEMA)
    assert len(set(cluster.length_parts([1_000] * 6 + [1_240] * 6, Params()))) == 2
    assert [c["support"] for c in pipelines.call_sample(x, tables[1], keep_failed=True, mosaic=True).collect() if c["svtype"] == "INS"] == [12]


def test_records(spark, tables):
    rng = random.Random(1)
    chunk, bases = 1 << 12, "".join(rng.choice("ACGT") for _ in range(LENGTH))
    reference = spark.createDataFrame([("chr1", i, bases[i * chunk : (i + 1) * chunk]) for i in range(-(-LENGTH // chunk))], "contig string, chunk_no int, seq string")
    found = {r["pos"]: r["line"].split("\t") for r in pipelines.vcf_of(pipelines.call_sample(*tables), reference, chunk, prefix="x.").collect()}
    gone, more = found[50_000], found[80_000]
    assert gone[3] == bases[49_999:50_300] and gone[4] == gone[3][0] and gone[2].startswith("x.DEL.")
    info = dict(x.partition("=")[::2] for x in gone[7].split(";"))
    assert list(info) == ["PRECISE", "SVTYPE", "SVLEN", "END", "SUPPORT", "COVERAGE", "STRAND", "PHASE", "STDEV_LEN", "STDEV_POS", "SUPPORT_SA", "VAF"] and info["END"] == "50300"
    assert gone[8] == "GT:GQ:DR:DV:PS" and gone[9].split(":")[0] in ("1|0", "1|1") and gone[9].endswith(":7")
    assert more[3] == bases[79_999] and more[4] == more[3] + INSERTED
    assert all("CHR2=" in found[p][7] for p in found if found[p][2].startswith("x.BND"))


def test_genotypes_of_given_variants(spark, tables):
    given = spark.createDataFrame([(0, "chr1", "DEL", 50_010, -290, 50_300), (1, "chr1", "INS", 80_005, 200, 80_005), (2, "chr1", "DEL", 30_000, -400, 30_400), (3, "chr3", "DEL", 30_000, -400, 30_400)], "line_index long, contig string, svtype string, pos long, svlen long, end long")
    got = {r["line_index"]: r for r in pipelines.genotype_variants(*tables, given).collect()}
    assert got[0]["gt_b"] == got[1]["gt_b"] == 1 and got[0]["dv"] == 10
    assert (got[2]["gt_a"], got[2]["gt_b"], got[2]["call_id"]) == (0, 0, None) and got[2]["dr"] > 0
    assert got[3]["gt_a"] is None and got[3]["dr"] == 0


def test_forced_genotyping_scans_alignments_once(spark, tables, monkeypatch):
    scanned, real = [], scan.scan
    monkeypatch.setattr(scan, "scan", lambda *a, **k: scanned.append(a) or real(*a, **k))
    given = spark.createDataFrame([(0, "chr1", "DEL", 50_010, -290, 50_300)], "line_index long, contig string, svtype string, pos long, svlen long, end long")
    assert pipelines.genotype_variants(*tables, given).count() == 1 and len(scanned) == 1


def test_samples_are_combined(spark):
    rows = [(s, f"{s}:{i}", "chr1", t, 10_000 * (i + 1) + 7 * s, 10_000 * (i + 1) + 7 * s + 100, 100 + s, 5, 3, 2, True, 0, 1, True, None, None) for s in range(3) for i, t in enumerate(("INS", "DEL", "DUP")) if (s, i) != (2, 1)]
    x = spark.createDataFrame(rows, "sample_id int, call_id string, contig string, svtype string, pos long, end long, svlen long, support long, fwd long, rev long, precise boolean, gt_a int, gt_b int, passed boolean, mate_contig string, mate_pos long")
    depth = spark.createDataFrame([(2, "chr1", 20_000, 9)], "sample_id int, contig string, cov_bin long, depth long")
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id int")
    got = {r["svtype"]: r for r in pipelines.combine_samples(x, depth, samples).collect()}
    assert {t: r["supp_vec"] for t, r in got.items()} == {"INS": "111", "DEL": "110", "DUP": "111"}
    assert got["DEL"]["genotypes"] == "0/1\t0/1\t0/0" and got["INS"]["samples"] == 3


def test_population_of_combined_samples(spark, tmp_path):
    """Written, read back and looked up by a later call."""
    rows = [(s, f"{s}:{v}", "chr1", t, at, at + 100, 100, 5, 3, 2, True, *gt, True, None, None) for v, t, at, gts in (("a", "INS", 10_000, {0: (0, 1), 1: (1, 1), 2: (0, 0), 3: (0, 1)}), ("b", "DUP", 50_000, {0: (0, 1), 1: (0, 1)})) for s, gt in gts.items()]
    x = spark.createDataFrame(rows, "sample_id int, call_id string, contig string, svtype string, pos long, end long, svlen long, support long, fwd long, rev long, precise boolean, gt_a int, gt_b int, passed boolean, mate_contig string, mate_pos long").withColumn("alt", F.lit("A" * 100))
    depth = spark.createDataFrame([(2, "chr1", 50_000, 9), (3, "chr1", 50_000, 2)], "sample_id int, contig string, cov_bin long, depth long")
    calls = pipelines.combine_samples(x, depth, x.select("sample_id").distinct())
    pipelines.combined_population(calls, str(tmp_path / "p"))
    found = {r["svtype"]: r for r in readers.population(spark, str(tmp_path / "p")).collect()}
    assert (found["INS"]["af"], found["INS"]["genotyped_n"], found["INS"]["variant_n"], found["INS"]["alt"]) == (0.5, 4, 3, "A" * 100)
    assert (found["DUP"]["af"], found["DUP"]["genotyped_n"], found["DUP"]["variant_n"]) == (2 / 6, 3, 2)
    assert combine.population_of(calls, Params(population_min_share=0.8)).count() == 1
    later = spark.createDataFrame([("c", "chr1", "INS", 10_020, 100, "A" * 99 + "C")], "call_id string, contig string, svtype string, pos long, svlen long, alt string")
    assert combine.population_annotated(later, readers.population(spark, str(tmp_path / "p"))).first()["population_af"] == 0.5


def test_no_depth_where_the_reference_has_n(spark, tables, calls):
    chunk = 1 << 15
    bases = "A" * 50_100 + "N" * 100 + "A" * (LENGTH - 50_200)
    reference = spark.createDataFrame([("chr1", i, bases[i * chunk : (i + 1) * chunk]) for i in range(-(-LENGTH // chunk))], "contig string, chunk_no int, seq string")
    steps = grid.masked(grid.coverage(tables[0]), grid.n_runs(reference, chunk))
    plain = calls["DEL", None, 50]
    found = grid.with_coverage(spark.createDataFrame([(1, "chr1", "DEL", plain["pos"], plain["end"])], "call_id long, contig string, svtype string, pos long, end long"), steps).first()
    assert (found["cov_center"], found["cov_upstream"]) == (0, plain["cov_upstream"]) and plain["cov_center"] > 0
    masked = pipelines.call_sample(*tables, keep_failed=True, reference=reference, chunk=chunk)
    assert masked.where("pos = 50000 and svtype = 'DEL'").first()["cov_center"] == 0


def test_homozygous_calls_keep_their_haplotype(spark):
    """Reads of two haplotypes fail a heterozygous call's phase, not a homozygous one's, unless those are unphased."""
    rows = [("hom", 1, 1, "1", "FAIL", "7"), ("het", 0, 1, "1", "FAIL", "7"), ("none", 1, 1, "NULL", "FAIL", "NULL"), ("zero", 1, 1, "0", "FAIL", "7"), ("unknown", None, None, "2", "FAIL", "7")]
    df = spark.createDataFrame([(*r[:5], r[5], 4, 4, "FAIL", None) for r in rows], "id string, gt_a int, gt_b int, hp string, hp_filter string, ps string, hp_support long, ps_support long, ps_filter string, haplotype string")
    got = {r["id"]: (r["hp_filter"], r["haplotype"], r["phase_set"]) for r in genotype.hom_alt_phased(df).collect()}
    assert got == {"hom": ("PASS", "1", "7"), "het": ("FAIL", None, None), "none": ("PASS", None, None), "zero": ("FAIL", None, None), "unknown": ("FAIL", None, None)}


def test_calls_without_depth_fail_genotyping(spark):
    rows = [("a", "DEL", -100, 5, 0, 0, 0, 0, 0), ("b", "DEL", -100, 5, 9, 9, 9, 9, 9), ("c", "DEL", -100, 0, 0, 0, 0, 0, 0)]
    names = ("cov_upstream", "cov_start", "cov_center", "cov_end", "cov_downstream")
    df = spark.createDataFrame([(*r, "PASS") for r in rows], "id string, svtype string, svlen long, support long, " + ", ".join(f"{c} long" for c in names) + ", filter string")
    df = df.withColumns({"support_long": F.lit(0), "support_sa": F.lit(0).cast("long"), "end": F.lit(200).cast("long"), "pos": F.lit(100).cast("long")})
    got = {r["id"]: r for r in genotype.genotyped(df, *genotype.observed(Params())).collect()}
    assert got["c"]["gt_filter"] == "GT_FAILED" and got["c"]["gt_a"] is None and got["b"]["gt_filter"] == "PASS"


def test_stores_of_samples(spark, tables, tmp_path):
    calls = pipelines.call_sample(*tables, keep_failed=True)
    for name in ("s1.store", "s2.store"):
        pipelines.stored_sample(calls, tables[0], str(tmp_path / name), "" if name == "s1.store" else "named")
    paths = [str(tmp_path / x) for x in ("s1.store", "s2.store")]
    found, depth, samples = readers.sample_stores(spark, paths)
    assert {r["sample_id"] for r in samples.collect()} == {"s1", "named"} and depth.where("contig = 'chr1'").count() > 0
    assert found.count() == 2 * calls.where("svtype not like 'SINGLE%'").count()
    assert {r["sample_id"] for r in readers.sample_stores(spark, paths, {paths[0]: "mine"})[2].collect()} == {"mine", "named"}
    got = {(r["svtype"], r["pos"]): r for r in pipelines.combine_stores(spark, paths).collect()}
    assert got["DEL", 50_000]["supp_vec"] == "11" and got["DEL", 50_000]["columns"].count("s1:chr1:DEL.") == 1 and got["DEL", 50_000]["ac"] >= 2
    variants = spark.createDataFrame([("chr1", "DEL", 50_004, -301, "v", None, 0.25, 40)], "contig string, svtype string, pos long, svlen long, id string, alt string, af double, genotyped_n long")
    known = {(r["svtype"], r["pos"]): r["population_af"] for r in pipelines.combine_stores(spark, paths, population=variants).collect()}
    assert known["DEL", 50_000] == 0.25 and known["INS", 80_000] == 0
    for name in ("d/s1", "e/d/s1"):  # one path ends like the other
        pipelines.stored_sample(calls, tables[0], str(tmp_path / name), "")
    paths = [str(tmp_path / x) for x in ("d/s1", "e/d/s1")]
    samples = readers.store_headers(spark, paths, {paths[1]: "second", f"file:{paths[0]}/": "first"}).collect()
    assert {r["sample_id"]: r["root"].endswith("/e/d/s1") for r in samples} == {"first": False, "second": True}
    with pytest.raises(ValueError, match="one sample id: s1"):
        readers.store_headers(spark, paths)
    with pytest.raises(ValueError, match="blocks of"):
        readers.store_headers(spark, paths, p=Params(block_size=5))


def test_calls_of_other_samples_keep_apart_by_sequence(spark):
    rows = [(1, 1, "c", "INS", 1000, 100, 9, "ACGT" * 25), (2, 2, "c", "INS", 1010, 100, 5, "ACGT" * 24 + "ACGA"), (3, 3, "c", "INS", 1005, 100, 4, "TTTT" * 25)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "call_id long, sample_id long, contig string, svtype string, pos long, svlen long, support long, alt string, mate_contig string, mate_pos long")
    got = {r["call_id"]: r["group_id"] for r in combine.combined(df, 3).collect()}
    assert got[1] == got[2] != got[3]


def test_columns_of_samples(spark):
    rows = [("g", 0, "a", 0, 1, 50, 5, 6), ("g", 0, "b", 0, 0, 9, 1, 2), ("g", 1, "c", 0, 0, 3, 8, 1), ("h", 1, "d", None, None, None, None, 4)]
    members = spark.createDataFrame(rows, "group_id string, sample_id int, call_id string, gt_a int, gt_b int, gq int, dr long, dv long")
    depth = spark.createDataFrame([("g", 2, 7), ("h", 0, 2), ("h", 2, 0)], "group_id string, sample_id int, depth long")
    samples = spark.createDataFrame([(0,), (1,), (2,)], "sample_id int")
    packed = combine.packed_depths(depth, ["group_id"], combine.sample_index(samples))
    got = {r["group_id"]: r for r in combine.group_genotypes(members, packed, samples).collect()}
    assert got["g"]["columns"] == "0/1:50:5:6:.:a,b\t0/0:3:8:1:.:c\t0/0:0:7:0:.:NULL" and (got["g"]["supp_vec"], got["g"]["ac"]) == ("110", 1)
    assert got["h"]["columns"] == "./.:0:2:0:.:NULL\t./.:0:0:4:.:d\t./.:0:0:0:.:NULL" and (got["h"]["supp_vec"], got["h"]["ac"]) == ("000", 0)
    again = {r["group_id"]: r["columns"].split("\t") for r in combine.group_genotypes(members, packed, samples, relabel=20).collect()}
    assert [x.split(":")[0] for x in again["g"]] == ["0/1", "0/1", "0/1"] and again["h"][1].startswith("./.")


def test_absent_samples_of_many_are_one_row_a_group(spark, monkeypatch):
    """Bitmaps and packs of depths say what a row for each group and absent sample says, with more samples than a word or a pack has."""
    monkeypatch.setattr(combine, "PACK", 7)
    rng = random.Random(3)
    samples = spark.createDataFrame([(f"s{i:03}",) for i in range(150)], "sample_id string")
    groups = {f"g{g}": 1_000 * g + 700 for g in range(12)}
    rows = [(f"{g}-{s}-{k}", f"s{s:03}", g, "c", "DEL", at, at + 60, -60, 5, 3, 2, True, *rng.choice([(0, 1), (1, 1), (0, 0), (None, None)]), True, rng.randint(0, 60), 4, 6) for g, at in groups.items() for s in rng.sample(range(150), 40) for k in range(rng.choice([1, 1, 2]))]
    members = spark.createDataFrame(rows, "call_id string, sample_id string, group_id string, contig string, svtype string, pos long, end long, svlen long, support long, fwd long, rev long, precise boolean, gt_a int, gt_b int, passed boolean, gq int, dr long, dv long")
    depth = {(f"s{s:03}", at // 500 * 500): rng.randint(0, 9) for at in groups.values() for s in range(150) if rng.random() < 0.7}
    table = spark.createDataFrame([(s, "c", b, n) for (s, b), n in depth.items()], "sample_id string, contig string, cov_bin long, depth long")
    calls = {r["group_id"]: r for r in combine.group_calls(members, table, samples).collect()}
    index = combine.sample_index(samples)
    at = spark.createDataFrame([(g, "c", x // 500 * 500) for g, x in groups.items()], "group_id string, contig string, cov_bin long")
    packed = at.join(combine.packed_depths(table, ["contig", "cov_bin"], index), ["contig", "cov_bin"])
    told = {r["group_id"]: r["columns"].split("\t") for r in combine.group_genotypes(members, packed.select("group_id", "depths"), samples).collect()}
    assert len(calls) == len(told) == 12
    for g, x in groups.items():
        genotypes = calls[g]["genotypes"].split("\t")
        for s in range(150):
            own = [r for r in rows if r[2] == g and r[1] == f"s{s:03}"]
            n = depth.get((f"s{s:03}", x // 500 * 500), 0)
            zero = "0/0" if n >= 5 else "./."
            if own:
                best = max(own, key=lambda r: (-1 if r[12] is None else r[12] + r[13], r[12] or 0, r[13] or 0))
                assert genotypes[s] == (f"{best[12]}/{best[13]}" if best[12] is not None else "./.")
            else:
                assert genotypes[s] == zero and told[g][s] == f"{zero}:0:{n}:0:.:NULL"
            assert calls[g]["supp_vec"][s] == str(int(any((r[12] or 0) + (r[13] or 0) > 0 for r in own)))
    plan = combine.group_calls(members, table, samples)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
