"""FASTA by byte ranges: an index of records, and reads of planned ranges, so that a contig is many tasks.

The index has a row for each record: contig, length, offset of the first base, bases and bytes of a line.
It is read from the file's ``.fai`` or built in one pass over ranges of SPLIT_BYTES: a task owns the lines that
begin in its range. Where lines of a record differ in length (all but its last), ``line_bases`` is null and
the record is streamed by one task; elsewhere a range of bases is a range of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bam import open_stream

#: Bytes of a range.
SPLIT_BYTES = 16 << 20
#: Bytes read at once where a line or a record is followed beyond its range.
STEP = 1 << 20
WHITE = b" \t\r\n\x0b\x0c"
INDEX = "contig string, length long, offset long, line_bases long, line_bytes long"
SEGMENTS = "range_no long, seg_no long, contig string, offset long, n_lines long, bases long, line_bases long, line_bytes long, same boolean, ends boolean, blank boolean"


def _lines(file, start: int, stop: int) -> Iterator[tuple[int, int, int, bytes | None]]:
    """(offset, bytes with the line's end, bases, header or None) of the lines that begin in [start, stop)."""
    bases = lambda x: len(x.translate(None, WHITE))
    at = start
    if start:
        file.seek(start - 1)
        while (block := file.read(STEP)) and b"\n" not in block:
            at += len(block)
        at += block.index(b"\n") if block else 0
        if not block or at >= stop:
            return
    while at < stop:
        file.seek(at)
        block = file.read(STEP)
        if not block:
            return
        ends = np.flatnonzero(np.frombuffer(block, np.uint8) == 10)
        begin = 0
        for end in ends.tolist():
            if at + begin >= stop:
                return
            line = block[begin : end + 1]
            yield at + begin, len(line), bases(line), line if line[:1] == b">" else None
            begin = end + 1
        at += begin
        if begin == 0:  # a line longer than the block: follow it
            size, known, head = len(block), bases(block), block
            while more := file.read(STEP):
                end = more.find(b"\n") + 1
                more = more[: end or None]
                size, known = size + len(more), known + bases(more)
                head = head if len(head) > 1 << 16 else head + more
                if end:
                    break
            yield at, size, known, head if head[:1] == b">" else None
            at += size


class _Run:
    """Sequence lines of one record in one range. ``same``: all lines are like the first; ``ends``: all but a shorter last one, which blank lines may follow. ``blank``: it begins with blank lines."""

    def __init__(self, contig: str | None, offset: int):
        self.contig, self.offset = contig, offset
        self.n_lines, self.bases, self.line_bases, self.line_bytes, self.same, self.ends, self.blank = 0, 0, None, None, True, True, False

    def add(self, at: int, bases: int, size: int) -> None:
        if not self.n_lines:
            if bases:
                self.offset, self.line_bases, self.line_bytes = at, bases, size
            else:
                self.blank = True
        elif bases:
            self.ends = self.same and bases <= self.line_bases
        if bases:
            self.n_lines += 1
            self.bases += bases
        self.same = self.same and (not self.n_lines or (bases, size) == (self.line_bases, self.line_bytes))

    def row(self, range_no: int, seg_no: int) -> tuple:
        return range_no, seg_no, self.contig, self.offset, self.n_lines, self.bases, self.line_bases, self.line_bytes, self.same, self.ends, self.blank


def _segments(path: str, no: int, start: int, stop: int) -> list[tuple]:
    """The runs of a range, as SEGMENTS."""
    out: list[_Run] = []
    with open_stream(path) as file:
        for at, size, bases, head in _lines(file, start, stop):
            if head is not None:
                name = head[1:].split()
                out.append(_Run(name[0].decode() if name else "", at + size))
                continue
            if not out:
                out.append(_Run(None, at))
            out[-1].add(at, bases, size)
    return [x.row(no, i) for i, x in enumerate(out)]


def fasta_index(spark: SparkSession, path: str) -> DataFrame:
    """The index of a FASTA file, from ``path``.fai or built; records without bases are left out."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.fai")):
        f = F.split("value", "\t")
        x = spark.read.text(f"{path}.fai").where(F.trim("value") != "").select(f[0].alias("contig"), *(f[i + 1].cast("long").alias(c) for i, c in enumerate(("length", "offset", "line_bases", "line_bytes"))))
        return x.where("length > 0")
    size = store.getFileStatus(fs).getLen()
    parts = [(i, a, min(a + SPLIT_BYTES, size)) for i, a in enumerate(range(0, size, SPLIT_BYTES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = zip(*(x.split() for x in SEGMENTS.split(", ")))
        types = [{"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[k] for k in kinds]
        for batch in batches:
            for no, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                rows = _segments(path, no, start, stop)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))

    found = spark.createDataFrame(parts, "range_no long, start long, stop long").repartition(max(len(parts), 1)).mapInArrow(run, SEGMENTS)
    # a row for each record and range, whose order needs one window: far fewer rows than lines
    order = W.orderBy("range_no", "seg_no")
    numbered = found.withColumn("record", F.sum(F.col("contig").isNotNull().cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy("record").orderBy("range_no", "seg_no")
    whole = W.partitionBy("record")
    lines = numbered.withColumns({"first_bases": F.first("line_bases", True).over(within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "first_bytes": F.first("line_bytes", True).over(within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), "last_run": F.max(F.when(F.col("n_lines") > 0, F.struct("range_no", "seg_no"))).over(whole), "first_run": F.min(F.when(F.col("n_lines") > 0, F.struct("range_no", "seg_no"))).over(whole)})
    here = F.struct("range_no", "seg_no")
    is_last, inside = here == F.col("last_run"), (here > F.col("first_run")) & (here <= F.col("last_run"))
    full = (F.col("line_bases") == F.col("first_bases")) & (F.col("line_bytes") == F.col("first_bytes"))
    one_short = (F.col("n_lines") == 1) & (F.col("line_bases") <= F.col("first_bases"))
    fits = ~(inside & F.col("blank")) & ((F.col("n_lines") == 0) | F.when(is_last, one_short | full & (F.col("ends"))).otherwise(full & F.col("same")))
    rows = lines.groupBy("record").agg(F.max("contig").alias("contig"), F.sum("bases").alias("length"), F.min(F.when(F.col("n_lines") > 0, F.col("offset"))).alias("offset"), F.min("first_bases").alias("line_bases"), F.min("first_bytes").alias("line_bytes"), F.bool_and(fits).alias("fits"))
    ragged = lambda c: F.when(F.col("fits"), F.col(c)).alias(c)
    return rows.where("contig is not null and length > 0").select("contig", "length", "offset", ragged("line_bases"), ragged("line_bytes"))


def fasta(spark: SparkSession, path: str, chunk: int = 1 << 16, wanted: list[str] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(contig, chunk_no, seq): sequences in chunks of ``chunk`` bases, of the ``wanted`` contigs or all. Only their bytes are read."""
    index = fasta_index(spark, path) if index is None else index
    index = index if wanted is None else index.where(F.col("contig").isin(wanted))
    step = max(SPLIT_BYTES // chunk, 1)
    last = F.floor((F.col("length") - 1) / chunk)
    tasks = F.when(F.col("line_bases").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))
    planned = index.select("contig", "length", "offset", "line_bases", "line_bytes", F.explode(tasks).alias("first_chunk"))

    def chunks(contig: str, no: int, data: bytes) -> pa.RecordBatch:
        cut = [data[i : i + chunk].decode() for i in range(0, len(data), chunk)]
        return pa.RecordBatch.from_arrays([pa.array([contig] * len(cut), pa.string()), pa.array(range(no, no + len(cut)), pa.int32()), pa.array(cut, pa.string())], names=["contig", "chunk_no", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, length, offset, bases, size, first in zip(*(c.to_pylist() for c in batch.columns)):
                with open_stream(path) as file:
                    if bases is not None:
                        a, b = first * chunk, min((first + step) * chunk, length)
                        at = lambda x: offset + x // bases * size + x % bases  # noqa: B023, E731
                        file.seek(at(a))
                        yield chunks(contig, first, file.read(at(b - 1) + 1 - at(a)).translate(None, WHITE))
                        continue
                    file.seek(offset)
                    held, no, left = b"", 0, length
                    while left and (block := file.read(STEP)):
                        more = block.translate(None, WHITE)[:left]
                        held, left = held + more, left - len(more)
                        whole = len(held) // chunk * chunk
                        if whole:
                            yield chunks(contig, no, held[:whole])
                            no, held = no + whole // chunk, held[whole:]
                    yield chunks(contig, no, held)

    spread = planned.repartition("contig", "first_chunk")
    return spread.mapInArrow(run, "contig string, chunk_no int, seq string")
