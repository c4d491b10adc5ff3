import gzip
import json
import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.sources import bam, bam_regions

from .test_bam import record

CONTIGS = [("chr1", 3_000_000), ("chr2", 90_000_000), ("none", 500), ("chr3", 40_000)]


def own_bin(start, end):
    """The smallest bin that holds [start, end)."""
    for shift, first in reversed(bam_regions.LEVELS):
        if start >> shift == (end - 1) >> shift:
            return first + (start >> shift)


@pytest.fixture(scope="module")
def file(tmp_path_factory):
    """An indexed file with short and very long reads, close together and far apart, and reads without a contig at the end."""
    rng = random.Random(11)
    rows = []
    for ref, (name, length) in enumerate(CONTIGS):
        for _ in range({"chr1": 500, "chr2": 300, "none": 0, "chr3": 60}[name]):
            start = rng.randrange(length - 400) if rng.random() < 0.7 else rng.randrange(length // 50)
            rows.append((ref, start, min(rng.choice([5, 80, 20_000, 300_000]), length - start)))
    rows.sort()
    data = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(CONTIGS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in CONTIGS)
    begins = []
    for i, (ref, start, size) in enumerate(rows):
        begins.append(len(data))
        data += record(f"r{i}", 0, ref, start, 60, [(5, "M"), (size, "N"), (5, "M")], "ACGTACGTAC", b"")
    begins.append(len(data))
    data += record("lost", 4, -1, -1, 0, [], "A", b"")
    blob, members = b"", []
    for i in range(0, len(data), 301):
        members.append((i, len(blob)))
        blob += gzip.compress(data[i : i + 301])
    path = tmp_path_factory.mktemp("bam") / "a.bam"
    path.write_bytes(blob + gzip.compress(b""))
    place = lambda at: next(f << 16 | at - i for i, f in reversed(members) if i <= at)
    index = b"BAI\1" + struct.pack("<i", len(CONTIGS))
    for ref in range(len(CONTIGS)):
        bins, linear, n = defaultdict(list), {}, 0
        for i, (r, start, size) in enumerate(rows):
            if r != ref:
                continue
            n, end = n + 1, start + size + 10
            span = (place(begins[i]), place(begins[i + 1]))
            held = bins[own_bin(start, end)]
            if held and held[-1][1] == span[0]:
                held[-1] = (held[-1][0], span[1])
            else:
                held.append(span)
            for w in range(start >> 14, (end - 1 >> 14) + 1):
                linear.setdefault(w, span[0])
        index += struct.pack("<i", len(bins) + bool(n))
        for b, held in bins.items():
            index += struct.pack("<Ii", b, len(held)) + b"".join(struct.pack("<QQ", *x) for x in held)
        if n:
            index += struct.pack("<IiQQQQ", bam.COUNTS_BIN, 2, 1, 2, n, 0)
        wide = [linear.get(w, 0) for w in range(max(linear, default=-1) + 1)]
        index += struct.pack("<i", len(wide)) + struct.pack(f"<{len(wide)}Q", *wide)
    (path.parent / "a.bam.bai").write_bytes(index)
    return str(path), [(CONTIGS[r][0], s, s + n + 10, f"r{i}") for i, (r, s, n) in enumerate(rows)], len(blob)


def planned(path, split=1 << 30, regions=None, filters=()):
    reader = bam_regions.PushingReader([path], regions, split)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader.partitions()


def size_of(parts):
    return sum((b >> 16) - (a >> 16) for p in parts for a, b, *_ in p.work)


def test_regions_are_those_of_a_full_scan(spark, file):
    path, rows, _ = file
    rng = random.Random(2)
    some = [("chr1", 0, 3_000_000), ("chr3", 10, 11), ("chr1", 5, 5), ("nowhere", 0, 9), ("none", 0, 500)]
    for _ in range(6):
        contig, length = rng.choice([CONTIGS[0], CONTIGS[1]])
        a = rng.randrange(length)
        some.append((contig, a, a + rng.choice([1, 200, 70_000, 5_000_000])))
    for regions in [[r] for r in some[:4]] + [some[5:], some[:2] + some[5:]]:
        got = bam_regions.alignments(spark, [path], regions).select("contig", "ref_start", "ref_end", "read_qname").collect()
        assert sorted(map(tuple, got)) == sorted(r for r in rows if any(r[0] == c and a <= r[1] < b for c, a, b in regions))


def test_filters_are_pushed_down(spark, file):
    path, rows, _ = file
    for where, keep in (
        ("contig = 'chr2' and ref_start < 2000000", lambda r: r[0] == "chr2" and r[1] < 2_000_000),
        ("contig in ('chr1', 'chr3') and ref_start >= 30000 and ref_start <= 70000", lambda r: r[0] in ("chr1", "chr3") and 30_000 <= r[1] <= 70_000),
        ("contig = 'chr1' and ref_start < 500000 and ref_end > 490000", lambda r: r[0] == "chr1" and r[1] < 500_000 and r[2] > 490_000),
        ("ref_start > 2900000 and mapq = 60", lambda r: r[1] > 2_900_000),
        ("contig = 'chr1' and contig in ('chr2')", lambda r: False),
    ):
        x = bam_regions.alignments_where(spark, [path], where)
        assert sorted(r["read_qname"] for r in x.collect()) == sorted(r[3] for r in rows if keep(r))
    # frames without pushed filters may be used in several places of a plan
    x = bam_regions.alignments(spark, [path])
    both = x.where("contig = 'chr1'").select("read_qname").union(x.where("contig = 'chr3'").select("read_qname"))
    assert both.count() == sum(r[0] in ("chr1", "chr3") for r in rows) and x.count() == len(rows)


def test_a_region_reads_only_its_blocks(file):
    path, _, size = file
    whole = size_of(planned(path))
    assert 0.9 * size < whole <= size
    part = planned(path, regions=[("chr1", 1_500_000, 1_510_000)])
    assert 0 < size_of(part) < 0.25 * whole
    by_filter = planned(path, filters=[bam_regions.EqualTo(("contig",), "chr3"), bam_regions.LessThan(("ref_start",), 40_000)])
    assert 0 < size_of(by_filter) < 0.15 * whole
    assert planned(path, regions=[("none", 0, 500)])[0].work == []


def test_parts_of_every_size_and_stable_numbers(spark, file):
    path, rows, _ = file
    bam_regions.alignments(spark, [path])
    seen = {}
    for split in (1, 500, 5_000, 1 << 20):
        x = spark.read.format("bam_regions").option("paths", json.dumps([path])).option("splitBytes", split).load().cache()
        got = x.select("aln_idx", "read_qname", "seq", "cigar").orderBy("aln_idx").collect()
        assert [r["read_qname"] for r in got] == [r[3] for r in rows] and x.rdd.getNumPartitions() >= {1: 100, 500: 20, 5_000: 3}.get(split, 1)
        seen[split] = [tuple(r) for r in got]
        x.unpersist()
    assert len({str(x) for x in seen.values()}) == 1
    whole = bam.bam(spark, [path]).drop("aln_idx")
    assert sorted(map(str, whole.collect())) == sorted(map(str, bam_regions.alignments(spark, [path]).drop("aln_idx").collect()))


def test_without_an_index(spark, file, tmp_path):
    path, rows, _ = file
    (tmp_path / "b.bam").write_bytes(open(path, "rb").read())
    x = bam_regions.alignments(spark, [str(tmp_path / "b.bam")], [("chr1", 0, 100_000), ("chr3", 0, 40_000)])
    assert sorted(r["read_qname"] for r in x.collect()) == sorted(r[3] for r in rows if r[0] == "chr3" or r[0] == "chr1" and r[1] < 100_000)


def test_counts_of_the_index(spark, file):
    path, rows, _ = file
    got = {r["contig"]: (r["mapped"], r["length"]) for r in bam_regions.contig_counts(spark, path).collect()}
    want = {r["contig"]: r["n"] for r in bam.bam(spark, [path]).groupBy("contig").agg(F.count("*").alias("n")).collect()}
    assert got == {c: (want.get(c), n) for c, n in CONTIGS}
