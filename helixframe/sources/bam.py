"""BAM files: compressed blocks are gzip members, records follow one another.

A file with an index beside it (.bai) is cut at starts of records that the index names, about every
SPLIT_BYTES, and only the parts that hold wanted contigs are read. Without one it is streamed by one task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Fixed values of the format: operations by number, bases by nibble, sizes of tag values.
OPS = "MIDNSHP=X"
BASES = "=ACMGRSVTWYHKDBN"
#: The two bases of each byte.
PAIRS = [a + b for a in BASES for b in BASES]
TAG_FORMATS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
ROWS = 2000
#: Compressed bytes of a part.
SPLIT_BYTES = 64 << 20
#: Fixed value of the format: the bin of an index that holds counts instead of places.
COUNTS_BIN = 37450

SCHEMA = (
    "path string, aln_idx long, read_qname string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, seq string, "
    "query_length int, qry_start int, qry_end int, sa string, hp int, ps string, nm int"
)


def open_stream(path: str):
    """Plain and file: paths directly, other schemes by Arrow's file systems."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        return open(at.path, "rb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Inflated:
    """Bytes of a file of gzip members, from the member at ``start`` on."""

    def __init__(self, file, start: int = 0):
        self.file, self.member, self.data = file, zlib.decompressobj(31), bytearray()
        self.read, self.made, self.taken = start, 0, 0
        self.members = [(0, start)]  # where members begin: in the bytes, and in the file

    def take(self, n: int) -> bytes:
        """``n`` bytes, or fewer at the end."""
        while len(self.data) < n:
            rest = self.member.unused_data
            if self.member.eof:
                self.member = zlib.decompressobj(31)
                self.members.append((self.made, self.read - len(rest)))
            raw = rest
            if not raw:
                raw = self.file.read(1 << 16)
                self.read += len(raw)
            if not raw:
                break
            more = self.member.decompress(raw)
            self.made += len(more)
            self.data += more
        out, self.data = bytes(self.data[:n]), self.data[n:]
        self.taken += len(out)
        return out

    def place(self, at: int) -> int:
        """The virtual offset of byte ``at``, of those read last: the member's place in the file and the byte's in the member."""
        while len(self.members) > 1 and self.members[1][0] <= at:
            del self.members[0]
        begin, file = self.members[0]
        return file << 16 | at - begin

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def contigs(data: Inflated) -> list[tuple[str, int]]:
    if data.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    data.take(data.number())
    return [(data.take(data.number())[:-1].decode(), data.number()) for _ in range(data.number())]


def tags(block: bytes) -> dict[str, object]:
    found, at = {}, 0
    while at + 3 <= len(block):
        name, kind = block[at : at + 2].decode(), chr(block[at + 2])
        at += 3
        if kind in "ZH":
            end = block.index(0, at)
            found[name], at = block[at:end].decode(), end + 1
        elif kind == "B":
            size = struct.calcsize(TAG_FORMATS[chr(block[at])])
            at += 5 + size * struct.unpack_from("<i", block, at + 1)[0]
        elif kind == "A":
            found[name], at = chr(block[at]), at + 1
        else:
            found[name] = struct.unpack_from(TAG_FORMATS[kind], block, at)[0]
            at += struct.calcsize(TAG_FORMATS[kind])
    return found


def index_places(path: str) -> list[tuple[list[int], int]]:
    """For each contig of an index, virtual offsets at which records begin, and where its last one ends; empty without an index."""
    try:
        with open_stream(f"{path}.bai") as file:
            data = file.read()
    except FileNotFoundError:
        return []
    at = 8

    def numbers(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    out = []
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        begins, end = set(), 0
        for _ in range(numbers("<i")[0]):
            name, n = numbers("<Ii")
            places = numbers(f"<{2 * n}Q")
            if name != COUNTS_BIN:
                begins |= set(places[::2])
                end = max(end, *places[1::2])
        begins |= set(numbers(f"<{numbers('<i')[0]}Q")) - {0}
        out.append((sorted(begins), end))
    return out


def splits(path: str, wanted: list[str] | None = None) -> list[tuple[int, int]]:
    """(start, end) virtual offsets of a file's parts; 0 stands for the first record and for the file's end."""
    places = index_places(path)
    if not any(begins for begins, _ in places):
        return [(0, 0)]
    cuts = [0]
    for x in sorted({x for begins, _ in places for x in begins}):
        if (x >> 16) - (cuts[-1] >> 16) >= SPLIT_BYTES:
            cuts.append(x)
    parts = list(zip(cuts, [*cuts[1:], 0]))
    if wanted is None:
        return parts
    spans = [(begins[0], end) for (name, _), (begins, end) in zip(bam_contigs(path), places) if name in wanted and begins]
    return [(a, b) for a, b in parts if any(begin < (b or end + 1) and a < end for begin, end in spans)]


def records(data: Inflated, names: list[tuple[str, int]], stop: int = 0, places: bool = False) -> Iterator[tuple]:
    """Mapped records in file order, before the virtual offset ``stop`` if there is one, as rows of SCHEMA without the path; ``places``: numbered by their virtual offset."""
    index = -1
    while len(head := data.take(4)) == 4:
        place = data.place(data.taken - 4) if stop or places else 0
        if stop and place >= stop:
            return
        block = data.take(struct.unpack("<i", head)[0])
        index = place if places else index + 1
        ref, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiBBHHHi", block)
        if ref < 0 or not n_ops:
            continue
        at = 32 + n_name
        name = block[32 : at - 1].decode()
        ops = [(x >> 4, OPS[x & 15]) for x in struct.unpack_from(f"<{n_ops}I", block, at)]
        at += 4 * n_ops
        packed = block[at : at + (n_seq + 1) // 2]
        seq = "".join(map(PAIRS.__getitem__, packed))[:n_seq]
        found = tags(block[at + len(packed) + n_seq :])
        length = sum(n for n, o in ops if o in "MIS=X")
        left, right = (ops[0][0] if ops[0][1] == "S" else 0), (ops[-1][0] if n_ops > 1 and ops[-1][1] == "S" else 0)
        span = sum(n for n, o in ops if o in "MDN=X")
        text = lambda k: None if k not in found else str(found[k])  # noqa: B023, E731
        number = lambda k: None if k not in found else int(found[k])  # noqa: B023, E731
        yield index, name, flag, names[ref][0], pos, pos + span, mapq, "".join(f"{n}{o}" for n, o in ops), seq or None, length, left, length - right, text("SA"), number("HP"), text("PS"), number("NM")


def bam(spark: SparkSession, paths: list[str], wanted: list[str] | None = None) -> DataFrame:
    """The mapped alignments of BAM files, of the ``wanted`` contigs or all; ``aln_idx`` is in file order within each."""
    columns = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, part, start, stop in batch.itertuples(index=False, name=None):
                with open_stream(path) as file:
                    data = Inflated(file)
                    names, held = contigs(data), []
                    if start:
                        file.seek(start >> 16)
                        data = Inflated(file, start >> 16)
                        data.take(start & 0xFFFF)
                    for index, *row in records(data, names, stop):
                        if wanted is None or row[2] in wanted:
                            held.append((path, part << 32 | index, *row))
                        if len(held) == ROWS:
                            yield pd.DataFrame(held, columns=columns)
                            held = []
                    yield pd.DataFrame(held, columns=columns)

    parts = [(path, i, *span) for path in paths for i, span in enumerate(splits(path, wanted))]
    return spark.createDataFrame(parts, "path string, part long, start long, stop long").repartition(max(len(parts), 1)).mapInPandas(run, SCHEMA)


def bam_contigs(path: str) -> list[tuple[str, int]]:
    """(contig, length) of a BAM file's header."""
    with open_stream(path) as file:
        return contigs(Inflated(file))
