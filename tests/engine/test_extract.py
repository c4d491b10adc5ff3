from pyspark.sql import functions as F

from helixframe.operators import call, extract, scan
from helixframe.plans import pipelines

SCHEMA = "aln_idx long, read_qname string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, seq string, query_length int, qry_start int, qry_end int, sa string, hp int, ps string, nm int"


def alignments(spark, *rows):
    base = {"read_qname": "r", "flag": 0, "contig": "chr1", "ref_start": 1000, "ref_end": 3000, "mapq": 60, "cigar": "2000M", "seq": None, "query_length": 2000, "qry_start": 0, "qry_end": 2000, "sa": None, "hp": None, "ps": None, "nm": 5}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(({"aln_idx": i} | base | r)[n] for n in names) for i, r in enumerate(rows)], SCHEMA)


def test_events_of_a_cigar(spark):
    a = alignments(spark, {"cigar": "100M60I50M70D10M5I", "seq": "A" * 100 + "G" * 60 + "A" * 65}, {"cigar": "2000S100M"}, {"cigar": "100M50S", "flag": 2048}, {"cigar": "10M9Y"}, {"cigar": "3000H100M"})
    got = [tuple(r) for r in extract.inline_leads(a).select("aln_idx", "svtype", "svlen", "lead_start", "lead_end", "seq").orderBy("aln_idx", "lead_start").collect()]
    assert got == [(0, "INS", 60, 1100, 1100, "G" * 60), (0, "DEL", -70, 1220, 1150, None), (1, "INS", None, 1000, 1000, None), (2, "SINGLE_RIGHT", 0, 1100, 1100, None)]


def test_split_reads(spark):
    # a deletion of 500 between two parts; a duplication; an inversion; another contig; and a low quality part
    a = alignments(
        spark,
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,2501,+,1000S1000M,60,0;"},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,1501,+,1000S1000M,60,0;"},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,4001,-,1000M1000S,60,0;"},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr2,4001,+,1000S1000M,60,0;"},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,2501,+,1000S1000M,10,0;"},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,2501,+,1000S1000M,60,0;" * 4},
        {"ref_end": 2000, "qry_end": 1000, "sa": "chr1,2001,+,1200S800M,60,0;"},
    )
    got = {r["aln_idx"]: (r["svtype"], r["lead_start"], r["svlen"]) for r in extract.split_leads(a).collect()}
    assert got == {0: ("DEL", 2500, -500), 1: ("DUP", 1500, 500), 2: ("INV", 2000, 3000), 6: ("INS", 2000, 200)}


def test_fallback_takes_the_parts_of_the_first_strand(spark):
    # + + with another contig between: no pair shows an event, the two left do
    a = alignments(spark, {"ref_end": 2000, "qry_end": 1000, "query_length": 3000, "sa": "chr2,100,+,1000S1000M1000S,60,0;chr1,2501,+,2000S1000M,60,0;"})
    rows = extract.split_leads(a).collect()
    assert [(r["svtype"], r["svlen"]) for r in rows] == [("INS", 1000)]


def test_breakends(spark):
    a = alignments(
        spark,
        {"cigar": "1000M1000S", "ref_end": 2000, "sa": "chr5,5001,-,1000M1000S,60,0;"},
        {"cigar": "1000S1000M", "ref_end": 2000, "sa": "chr5,5001,-,1000S1000M,60,0;"},
        {"cigar": "1000M1000S", "ref_end": 2000, "sa": "chr5,5001,+,1000S1000M,60,0;"},
    )
    got = {r["aln_idx"]: tuple(r)[2:] for r in extract.breakends(a).collect()}
    assert got == {0: (2000, "chr5", 6000, True, True), 1: (1001, "chr5", 5002, False, False)}


def test_scan_by_region_and_contig(spark):
    a = alignments(spark, {}, {"mapq": 5}, {"flag": 256}, {"qry_end": 500}, {"ref_start": 90_000})
    regions = spark.createDataFrame([("chr1", 0, 50_000), ("chr1", 500, 60_000)], "contig string, start long, end long")
    assert [r["aln_idx"] for r in scan.scan(a).orderBy("aln_idx").collect()] == [0, 4]
    assert [r["aln_idx"] for r in scan.scan(a, regions).collect()] == [0]
    contigs = spark.createDataFrame([("chr1", 248956422), ("fragment", 123456)], "contig string, length long")
    pick = lambda **k: sorted(r["contig"] for r in scan.contigs_to_process(contigs, **k).collect())
    assert pick() == ["chr1"] and pick(requested=["fragment"]) == pick(region_contigs=["fragment"]) == ["fragment"] and len(pick(every=True)) == 2


def test_planted_variants_are_called(spark):
    """Ten reads with a deletion, five of ten with an insertion, none elsewhere."""
    rows = []
    for i in range(10):
        rows.append({"read_qname": f"d{i}", "flag": 16 * (i % 2), "ref_start": 10_000 + i, "ref_end": 14_300 + i, "cigar": f"{2000 - i}M300D2000M", "query_length": 4000, "qry_end": 4000})
        cigar = f"{2000 - i}M200I2000M" if i < 5 else "4000M"
        rows.append({"read_qname": f"i{i}", "flag": 16 * (i % 2), "ref_start": 50_000 + i, "ref_end": 54_000, "cigar": cigar, "query_length": 4200, "qry_end": 4200})
    contigs = spark.createDataFrame([("chr1", 2_000_000, 0)], "contig string, length long, contig_idx int")
    got = pipelines.call_sample(alignments(spark, *rows), contigs).collect()
    assert [(r["svtype"], r["pos"], r["svlen"], r["support"], r["gt_a"], r["gt_b"], r["id"]) for r in got] == [("DEL", 12_000, -300, 10, 1, 1, "DEL.0S0"), ("INS", 52_000, 200, 5, 0, 1, "INS.0S0")]
    variants = spark.createDataFrame([(0, "chr1", "DEL", 12_050, -310, 12_360), (1, "chr1", "DEL", 51_000, -100, 51_100), (2, "chr1", "INS", 900_000, 60, 900_000)], "line_index long, contig string, svtype string, pos long, svlen long, end long")
    forced = {r["line_index"]: (r["gt_a"], r["gt_b"]) for r in pipelines.genotype_variants(alignments(spark, *rows), contigs, variants).collect()}
    assert forced == {0: (1, 1), 1: (0, 0), 2: (None, None)}


def test_breakend_alts(spark):
    # The six breakends of the VCF 4.2 specification
    cases = [("chr17", 198982, True, True, "N]chr17:198982]", "++"), ("chr13", 123456, False, True, "]chr13:123456]N", "-+"), ("chr2", 321682, True, False, "N[chr2:321682[", "+-"), ("chr17", 198983, False, False, "[chr17:198983[N", "--"), ("chr2", 321681, True, True, "N]chr2:321681]", "++"), ("chr13", 123457, False, False, "[chr13:123457[N", "--")]
    df = spark.createDataFrame([c[:4] for c in cases], "m string, p long, f boolean, r boolean")
    got = df.select(call.bnd_alt(*map(F.col, "mpfr")).alias("a"), call.bnd_orientation(F.col("f"), F.col("r")).alias("o")).collect()
    assert [tuple(r) for r in got] == [c[4:] for c in cases]
