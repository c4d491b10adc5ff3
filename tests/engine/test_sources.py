import gzip
import random
import time

import pytest
from pyspark.sql import functions as F

from helixframe.operators import combine, consensus, grid, qc, text
from helixframe.sources import readers, sequences, writers
from helixframe.streaming import windowed


def test_bed(spark, tmp_path):
    (tmp_path / "a.bed").write_text("#comment\n\nchr1 100 200\nchr1\t500\t600\nchr3 500 600\njunk\n")
    got = sorted(map(tuple, readers.bed_regions(spark, str(tmp_path / "a.bed")).collect()))
    assert got == [("chr1", 100, 200), ("chr1", 500, 600), ("chr3", 500, 600)]
    repeats = sorted(map(tuple, readers.tandem_repeats(spark, str(tmp_path / "a.bed")).collect()))
    assert repeats == [("chr1", 0, 700), ("chr1", 0, 1100), ("chr3", 0, 1100)]
    assert [tuple(r) for r in readers.region_strings(spark, ["chr1:5-10", "nonsense"]).collect()] == [("chr1", 5, 10)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.bed_regions(spark, str(tmp_path / "none.bed"))


def test_sam(spark, tmp_path):
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:chr1\tLN:5000\n@SQ\tSN:chr2\tLN:70\nr1\t16\tchr1\t101\t60\t5S90M5D10M\t*\t0\t0\tACGT\t*\tNM:i:7\tSA:Z:chr2,5,+,5M,60,0;\tHP:i:2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\n")
    rows = readers.sam(spark, str(tmp_path / "a.sam")).collect()
    assert len(rows) == 1 and {k: rows[0][k] for k in ("read_qname", "flag", "ref_start", "ref_end", "query_length", "qry_start", "qry_end", "sa", "hp", "ps", "nm")} == {"read_qname": "r1", "flag": 16, "ref_start": 100, "ref_end": 205, "query_length": 105, "qry_start": 5, "qry_end": 105, "sa": "chr2,5,+,5M,60,0;", "hp": 2, "ps": None, "nm": 7}
    assert [tuple(r)[:2] for r in readers.sam_contigs(spark, str(tmp_path / "a.sam")).orderBy("contig_idx").collect()] == [("chr1", 5000), ("chr2", 70)]


def test_fasta_and_masks(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 one\nACGTNNNNAC\nGTNN\n>chr2\nAAAA\n")
    ref = readers.fasta(spark, str(tmp_path / "a.fa"), chunk=4)
    assert "".join(r["seq"] for r in ref.where("contig = 'chr1'").orderBy("chunk_no").collect()) == "ACGTNNNNACGTNN"
    points = spark.createDataFrame([("chr1", 0), ("chr1", 9), ("chr2", 3), ("chr2", 4), ("chr9", 0)], "contig string, at long")
    assert {(r["contig"], r["at"]): r["base"] for r in readers.bases(points, ref, 4).collect()} == {("chr1", 0): "A", ("chr1", 9): "C", ("chr2", 3): "A", ("chr2", 4): None, ("chr9", 0): None}
    runs = sorted(map(tuple, grid.n_runs(ref, 4).collect()))
    assert runs == [("chr1", 4, 8), ("chr1", 12, 14)]
    steps = spark.createDataFrame([("chr1", 2, 13, 5), ("chr2", 0, 4, 1)], "contig string, start long, end long, depth long")
    assert sorted(map(tuple, grid.masked(steps, grid.n_runs(ref, 4)).collect())) == [("chr1", 2, 4, 5), ("chr1", 8, 12, 5), ("chr2", 0, 4, 1)]


def plain_fasta(text):
    """Chunks by the plainest way: split at '>', drop white space."""
    parts = [r.partition("\n")[::2] for r in text.split("\n>")]
    return {head.split()[0]: "".join(body.split()) for head, body in parts if body.split()}


@pytest.mark.parametrize("split, step", [(1 << 20, 1 << 16), (37, 16), (5, 3)])
def test_fasta_ranges(spark, tmp_path, monkeypatch, split, step):
    """Regular, ragged, one-line, blank-lined and empty records, in ranges of every size, equal a plain reading."""
    monkeypatch.setattr(sequences, "SPLIT_BYTES", split)
    monkeypatch.setattr(sequences, "STEP", step)
    monkeypatch.setattr(sequences, "open_stream", lambda path: open(path, "rb"))
    rng = random.Random(split)
    base = lambda n: "".join(rng.choice("ACGTN") for _ in range(n))
    body = lambda n, w, end="\n": end.join(base(w if i + w <= n else n - i) for i in range(0, n, w))
    texts = [f"chr1 a b\n{body(100, 10)}", f"chr2\n{body(95, 10)}\n", "none\n", f"ragged\n{base(9)}\n{base(14)}\n{base(3)}\n{base(14)}", f"line\n{base(300)}", f"blank\n\n{body(33, 7)}\n\n", f"dos\r\n{body(64, 8, chr(13) + chr(10))}\r\n", f"end\n{base(8)}\n{base(5)}\n{base(8)}", f"tail\n{body(25, 10)}\n\n\n", f"hole\n{body(20, 10)}\n\n{base(10)}", f"last\n{base(1)}"]
    text = ">" + "\n>".join(texts)
    (tmp_path / "a.fa").write_bytes(text.encode())
    path = str(tmp_path / "a.fa")
    want = plain_fasta(text[1:])
    for chunk in (4, 1000):
        got = {}
        for r in readers.fasta(spark, path, chunk).orderBy("contig", "chunk_no").collect():
            got[r["contig"]] = got.get(r["contig"], "") + r["seq"]
            assert r["chunk_no"] == (len(got[r["contig"]]) - 1) // chunk and len(r["seq"]) <= chunk
        assert got == want
    index = {r["contig"]: r for r in readers.fasta_index(spark, path).collect()}
    assert {c: r["length"] for c, r in index.items()} == {c: len(s) for c, s in want.items()}
    assert index["chr1"]["line_bases"] == 10 and index["line"]["line_bases"] == 300 and index["ragged"]["line_bases"] is None and index["end"]["line_bases"] is index["hole"]["line_bases"] is None and index["tail"]["line_bases"] == 10
    assert (index["dos"]["line_bases"], index["dos"]["line_bytes"]) == (8, 10)
    only = readers.fasta(spark, path, 50, ["chr2"]).orderBy("chunk_no").collect()
    assert "".join(r["seq"] for r in only) == want["chr2"]


def test_fasta_with_an_index_beside_it(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c\nACGTA\nCCGTT\nG\n")
    (tmp_path / "a.fa.fai").write_text("c\t11\t3\t5\t6\n")
    assert [tuple(r) for r in readers.fasta_index(spark, str(tmp_path / "a.fa")).collect()] == [("c", 11, 3, 5, 6)]
    assert [r["seq"] for r in readers.fasta(spark, str(tmp_path / "a.fa"), 4).orderBy("chunk_no").collect()] == ["ACGT", "ACCG", "TTG"]


def test_fasta_takes_linear_time(spark, tmp_path):
    """32 MB of one contig; a reading that looks for each chunk from the start takes most of a minute."""
    line = (b"ACGTTGCAAC" * 6 + b"\n") * 1000
    with open(tmp_path / "big.fa", "wb") as file:
        file.write(b">c\n")
        for _ in range(550):
            file.write(line)
    began = time.perf_counter()
    rows, bases = readers.fasta(spark, str(tmp_path / "big.fa")).agg(F.count("*"), F.sum(F.length("seq"))).first()
    assert bases == 33_000_000 and rows == -(-bases // (1 << 16)) and time.perf_counter() - began < 20


@pytest.mark.parametrize("zipped", [False, True])
def test_vcf(spark, tmp_path, zipped):
    lines = ["##x", "#CHROM", "c\t11\ta\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL;SVLEN=-50;END=60;FLAG", "c\t21\tb\tA\tACCC\t9\tPASS\t.", "c\t31\td\tN\tN]chr7:88]\t9\tPASS\tSVTYPE=TRA;K=1;K=2"]
    path = tmp_path / ("a.vcf" + ".gz" * zipped)
    path.write_bytes(gzip.compress("\n".join(lines).encode()) if zipped else "\n".join(lines).encode())
    rows = {r["id"]: r for r in readers.vcf(spark, str(path)).collect()}
    assert [(rows[i]["svtype"], rows[i]["pos"], rows[i]["svlen"], rows[i]["end"]) for i in "abd"] == [("DEL", 10, -50, 60), ("INS", 20, 3, 20), ("BND", 30, 0, 30)]
    assert rows["a"]["info"]["FLAG"] == "True" and rows["d"]["info"]["K"] == "2" and (rows["d"]["mate_contig"], rows["d"]["mate_pos"]) == ("chr7", 88)
    (tmp_path / "bad.vcf").write_text("c\t1\n")
    with pytest.raises(Exception, match="malformed VCF line"):
        readers.vcf(spark, str(tmp_path / "bad.vcf")).collect()


def test_records(spark):
    # Insertion, deletion and unresolved insertion as the VCF 4.2 specification writes them
    rows = [("INS", 3, 3, "TAG", "C", None, "C", "CTAG"), ("DEL", 2, -2, None, "T", "TCG", "TCG", "T"), ("INS", 2, 20, "<INS>", "T", None, "T", "<INS>"), ("BND", 5, 0, "N]c:7]", "r", None, "N", "N]c:7]"), ("DEL", 2, -60_000, None, "T", None, "T", "<DEL>")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, svtype string, pos long, svlen long, alt string, anchor string, deleted string, want_ref string, want_alt string")
    for r in text.resolved(df).collect():
        assert (r["ref"], r["alt"]) == (r["want_ref"], r["want_alt"])
    head = text.header([("chr1", 10)], ["s1", "s2"], with_id=True)
    assert head[0] == "##fileformat=VCFv4.2" and "##contig=<ID=chr1,length=10>" in head and head[-1].endswith("FORMAT\ts1\ts2") and sum("##FILTER" in x for x in head) == len(text.FILTERS)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", "c", p, f"l{p}") for p in (250_000, 5, 120_000)], "sample_id string, contig string, pos long, line string")
    writers.write_text(rows, str(tmp_path / "out"), ["#h1", "#h2"], ["pos"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/body")).collect()] == ["l5", "l120000", "l250000"]
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out/header")).collect()] == ["#h1", "#h2"]
    writers.write_store(rows, str(tmp_path / "store"))
    assert [r["pos"] for r in readers.store(spark, str(tmp_path / "store"), "c", 100_000).collect()] == [120_000]
    (tmp_path / "list.tsv").write_text("# c\na/b/s1.store\nx.store\tmine\n")
    assert sorted(map(tuple, readers.store_list(spark, str(tmp_path / "list.tsv")).collect())) == [("a/b/s1.store", "s1"), ("x.store", "mine")]


def test_populations(spark, tmp_path):
    rows = spark.createDataFrame([("v1", "c", "DEL", 5, 0.5), ("v2", "d", "INS", 250_000, 0.1), ("v3", "c", "DEL", 120_000, 0.2)], "id string, contig string, svtype string, pos long, af double")
    writers.write_population(rows, str(tmp_path / "p"))
    assert sorted(r["id"] for r in readers.population(spark, str(tmp_path / "p")).collect()) == ["v1", "v2", "v3"]
    assert sorted((r["id"], r["block"]) for r in readers.population(spark, str(tmp_path / "p"), "c").collect()) == [("v1", 0), ("v3", 100_000)]


def test_combining(spark):
    rows = [(1, 1, "c", "DEL", 1000, -100, 9), (2, 2, "c", "DEL", 1040, -110, 5), (3, 3, "c", "DEL", 9000, -100, 7), (4, 1, "c", "DEL", 1010, -3000, 4)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "call_id long, sample_id long, contig string, svtype string, pos long, svlen long, support long, mate_contig string, mate_pos long").repartition(3)
    got = {r["call_id"]: r["group_id"] for r in combine.combined(df, 3).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 3
    versions = spark.createDataFrame([("2.10",), ("2.5.2",), ("2.5.3",), ("2.0.7b",)], "v string")
    assert [r[0] for r in versions.select(combine.needs_genotyping(F.col("v"))).collect()] == [False, True, False, True]


def test_consensus_corrects_single_errors():
    rng = random.Random(1)
    truth = "".join(rng.choice("ACGT") for _ in range(300))
    bad = truth[:150] + ("A" if truth[150] != "A" else "C") + truth[151:]
    assert consensus.consensus(bad, [truth] * 6) == truth
    assert consensus.consensus(truth, [truth] * 6) == truth and consensus.consensus(truth, []) == truth


def test_alignment_along_the_best_sequence():
    unique = {"ACG": 0, "TTA": 6, "GGC": 12, "CAT": 20}
    best = "ACGAAATTACCCGGCTTTTACATGA"
    same = consensus.aligned(best, best, unique, 3, 1)
    assert same == best[:20] + "-" * 5  # nothing after the last anchor
    longer = best[:16] + "A" + best[16:]  # one more base between two anchors: dashes as far as the read moved
    assert consensus.aligned(best, longer, unique, 3, 1) == best[:12] + "-" * 13
    late = "T" + best[:20]  # the first anchor is not the read's first k-mer
    assert consensus.aligned(best, late, {"TTA": 6, "GGC": 12}, 3, 1) == "-" * 6 + best[6:12] + "-" * 13
    assert consensus.aligned(best, best[:7], unique, 3, 1) is None and consensus.aligned(best, "GGGG", unique, 3, 1) is None


def test_all_filters_are_listed_once(spark):
    df = spark.createDataFrame([(5,), (0,)], "x int")
    rules = [("A", F.col("x") > 1), ("B", F.col("x") > 2), ("A", F.col("x") > 3)]
    assert [tuple(r) for r in df.select(qc.first_filter(rules), qc.all_filters(rules)).collect()] == [("A", "A;B"), ("PASS", "PASS")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp_seconds(1700000000 + id * 60) as ts", "concat('c', id % 2) as contig", "id * 37 as ref_start", "cast(id as double) as value")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = windowed.windowed_leads(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("grid").start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.sql("select * from grid").collect())) == sorted(map(tuple, windowed.windowed_leads(rows).collect()))
    finally:
        q.stop()
