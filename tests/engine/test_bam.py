import gzip
import struct

from helixframe.sources import bam


def record(name, flag, ref, pos, mapq, ops, seq, tags):
    codes = [bam.BASES.index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    cigar = b"".join(struct.pack("<I", n << 4 | bam.OPS.index(o)) for n, o in ops)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(ops), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + cigar + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def test_reads_blocks_across_members(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr1", 5000), (b"chr2", 70)))
    tags = b"NMC\x07" + b"SAZchr2,5,+,5M,60,0;\0" + b"HPi" + struct.pack("<i", 2) + b"XBBs" + struct.pack("<ihh", 2, 1, 2) + b"XAAq"
    rows = [record("r1", 16, 0, 100, 60, [(5, "S"), (4, "M"), (5, "D"), (2, "M")], "ACGTNACGTAC", tags), record("r2", 4, -1, -1, 0, [], "A", b""), record("r3", 0, 1, 3, 9, [(3, "M")], "", b"")]
    data = head + b"".join(rows)
    cut = [data[i : i + 37] for i in range(0, len(data), 37)]  # records cross the members
    path = tmp_path / "a.bam"
    path.write_bytes(b"".join(map(gzip.compress, cut)) + gzip.compress(b""))
    assert bam.bam_contigs(str(path)) == [("chr1", 5000), ("chr2", 70)]
    got = [tuple(r)[1:] for r in bam.bam(spark, [str(path)]).orderBy("aln_idx").collect()]
    assert got == [
        (0, "r1", 16, "chr1", 100, 111, 60, "5S4M5D2M", "ACGTNACGTAC", 11, 5, 11, "chr2,5,+,5M,60,0;", 2, None, 7),
        (2, "r3", 0, "chr2", 3, 6, 9, "3M", None, 3, 0, 3, None, None, None, None),
    ]


def test_index_cuts_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bam, "SPLIT_BYTES", 200)
    head = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", len(n) + 1) + n + b"\0" + struct.pack("<i", k) for n, k in ((b"chr1", 5000), (b"chr2", 70)))
    rows = [record(f"r{i}", 0, int(i >= 60), i, 60, [(4, "M")], "ACGT", b"") for i in range(100)]
    data, begins = head, []
    for x in rows:
        begins.append(len(data))
        data += x
    file, members = b"", []
    for i in range(0, len(data), 97):  # records cross the members
        members.append((i, len(file)))
        file += gzip.compress(data[i : i + 97])
    path = tmp_path / "a.bam"
    path.write_bytes(file + gzip.compress(b""))
    place = lambda at: next(f << 16 | at - i for i, f in reversed(members) if i <= at)
    index = b"BAI\1" + struct.pack("<i", 2)
    for a, b in ((0, 60), (60, 100)):
        end = place(begins[b]) if b < 100 else place(len(data) - 1) + 1
        index += struct.pack("<i", 2) + struct.pack("<IiQQ", 4681, 1, place(begins[a]), end) + struct.pack("<IiQQQQ", bam.COUNTS_BIN, 2, 1, 2, 3, 4)
        index += struct.pack("<i", 6) + struct.pack("<6Q", 0, *[place(begins[i]) for i in range(a, b, 8)][:5])
    whole = [tuple(r)[1:] for r in bam.bam(spark, [str(path)]).orderBy("aln_idx").collect()]
    (tmp_path / "a.bam.bai").write_bytes(index)
    assert len(bam.splits(str(path))) > 3
    cut = [tuple(r)[1:] for r in bam.bam(spark, [str(path)]).orderBy("aln_idx").collect()]
    assert [r[1:] for r in cut] == [r[1:] for r in whole] and len(cut) == 100 and len({r[0] for r in cut}) == 100
    assert 0 < len(bam.splits(str(path), ["chr2"])) < len(bam.splits(str(path)))
    assert [r["read_qname"] for r in bam.bam(spark, [str(path)], ["chr2"]).orderBy("aln_idx").collect()] == [f"r{i}" for i in range(60, 100)]
