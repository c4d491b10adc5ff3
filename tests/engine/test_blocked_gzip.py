import gzip
import io
import random
import struct
import zlib

import pytest

from helixframe.sources import blocked_gzip, readers


def member(data):
    """One member with its own size in the header, as the format has it."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def blocked(data, size):
    """``size``: bytes of a member, or a function that gives them."""
    out, at = b"", 0
    while at < len(data):
        n = size() if callable(size) else size
        out += member(data[at : at + n])
        at += n
    return out + member(b"")


@pytest.mark.parametrize("split", [1, 50, 333, 1 << 20])
def test_every_line_has_one_owner(split):
    """Members that end at, within and across lines, empty members, empty lines, and texts that look like members."""
    rng = random.Random(split)
    for data in (b"", b"\n", b"one", b"a\n\nb\n", b"".join(b"x" * rng.choice([0, 1, 5, 40, 300]) + rng.choice([b"\n", b"\r\n"]) for _ in range(200)), b"\x1f\x8b\x08\x04\n" * 300):
        for size in (1, 7, 64, lambda: rng.choice([1, 3, 90]), 5_000):
            file = blocked(data, size)
            got = []
            for a in range(0, len(file), split if len(file) < 40 * split else max(split, len(file) // 40)):
                b = a + (split if len(file) < 40 * split else max(split, len(file) // 40))
                got += blocked_gzip.range_lines(io.BytesIO(file), a, min(b, len(file)), len(file))
            want = data.split(b"\n")
            assert got == (want[:-1] if want[-1] == b"" else want)


def test_a_compressed_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocked_gzip, "SPLIT_BYTES", 2_000)
    rng = random.Random(5)
    lines = ["##x", "#CHROM", *(f"c\t{i + 1}\tv{i}\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL;SVLEN=-{rng.randint(50, 9_999)};END={i + 60};N={rng.random()}" for i in range(3_000))]
    text = "\n".join(lines) + "\n"
    (tmp_path / "a.vcf.gz").write_bytes(blocked(text.encode(), 700))
    (tmp_path / "b.vcf").write_text(text)
    (tmp_path / "c.vcf.gz").write_bytes(gzip.compress(text.encode()))
    assert blocked_gzip.lines(spark, str(tmp_path / "a.vcf.gz")).rdd.getNumPartitions() > 10
    assert not blocked_gzip.is_blocked(str(tmp_path / "c.vcf.gz"))
    found = [[tuple(r) for r in readers.vcf(spark, str(tmp_path / x)).orderBy("line_index").select("id", "pos", "svlen", "line").collect()] for x in ("a.vcf.gz", "b.vcf", "c.vcf.gz")]
    assert found[0] == found[1] == found[2] and [r[0] for r in found[0]] == [f"v{i}" for i in range(3_000)]


def test_a_torn_file_raises(spark, tmp_path):
    file = blocked(b"c\t1\ta\tN\t<DEL>\t9\tPASS\tSVTYPE=DEL\n" * 500, 900)
    (tmp_path / "a.vcf.gz").write_bytes(file[: len(file) // 2])
    with pytest.raises(Exception, match="no whole member"):
        readers.vcf(spark, str(tmp_path / "a.vcf.gz")).collect()
