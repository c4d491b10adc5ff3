"""Lines of blocked gzip files, many tasks a file.

A blocked file is gzip members of at most 64 kB that name their own size, so a reader can start at any of
them. A range of bytes owns the members that begin in it: its task looks for the first, decompresses up
to the range's end, leaves the line that it begins within to the range before, and goes on past the end to
the end of its last line. Line numbers rise in file order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bam import open_stream

#: Compressed bytes of a range.
SPLIT_BYTES = 16 << 20
# Fixed values of the format: how a member begins, and the longest one.
MAGIC, LONGEST = b"\x1f\x8b\x08\x04", 1 << 16
#: Members that have to follow one another for a place to count as the start of one.
CHAIN = 3
#: Lines of a batch.
ROWS = 10_000


def member_size(data: bytes, at: int) -> int | None:
    """Bytes of the member at ``at`` as its header says; None where there is none, or not enough of it."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 4 <= min(end, len(data)):
        name, length = data[field : field + 2], struct.unpack_from("<H", data, field + 2)[0]
        if name == b"BC" and length == 2 and field + 6 <= len(data):
            return struct.unpack_from("<H", data, field + 4)[0] + 1
        field += 4 + length
    return None


def is_blocked(path: str) -> bool:
    with open_stream(path) as file:
        return member_size(file.read(LONGEST), 0) is not None


def first_member(file, start: int, size: int) -> int:
    """The first place from ``start`` on where CHAIN members follow one another, or as many as the file still has; its size where there is none."""
    file.seek(start)
    data = file.read((CHAIN + 1) * LONGEST)
    at = data.find(MAGIC)
    while at >= 0 and at < LONGEST:
        place, known = at, 0
        while known < CHAIN and start + place < size and (length := member_size(data, place)):
            place, known = place + length, known + 1
        if known == CHAIN or known and start + place == size:
            return start + at
        at = data.find(MAGIC, at + 1)
    return size


def _texts(file, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(place, text) of the members from ``at`` on."""
    file.seek(at)
    data, base = b"", at
    while base < size:
        if len(data) < LONGEST:
            data += file.read(1 << 20)
        length = member_size(data, 0)
        if not length or len(data) < length:
            raise ValueError(f"no whole member at byte {base}")
        yield base, zlib.decompress(data[:length], 31)
        data, base = data[length:], base + length


def range_lines(file, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The lines that the range [start, stop) owns, without their ends."""
    at = first_member(file, start, size) if start else 0
    if at >= stop:
        return
    held, skip = b"", start > 0
    for place, text in _texts(file, at, size):
        if place >= stop:  # only what ends the last line is still ours, and nothing if no line ends in the range
            if skip:
                return
            head, found, _ = text.partition(b"\n")
            held += head
            if not found:
                continue
            yield held
            return
        *lines, held = (held + text).split(b"\n")
        if skip and lines:
            lines, skip = lines[1:], False
        yield from lines
    if held and not skip:
        yield held


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, line_index) of a blocked file."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    ranges = [(i, a, min(a + SPLIT_BYTES, size)) for i, a in enumerate(range(0, size, SPLIT_BYTES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(no: int, first: int, held: list[bytes]) -> pa.RecordBatch:
            text = [x.removesuffix(b"\r").decode() for x in held]
            return pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(range(no << 40 | first, (no << 40 | first) + len(held)), pa.int64())], names=["value", "line_index"])

        for given in batches:
            for no, start, stop in zip(*(c.to_pylist() for c in given.columns)):
                with open_stream(path) as file:
                    held, n = [], 0
                    for line in range_lines(file, start, stop, size):
                        held.append(line)
                        if len(held) == ROWS:
                            yield batch(no, n, held)
                            n, held = n + len(held), []
                    yield batch(no, n, held)

    return spark.createDataFrame(ranges, "no long, start long, stop long").repartition(max(len(ranges), 1)).mapInArrow(run, "value string, line_index long")
