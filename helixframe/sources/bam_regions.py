"""BAM as a data source of Spark that fetches regions.

``spark.read.format("bam_regions")`` takes ``paths`` and ``regions`` (JSON lists; a region is contig, start, end and
owns the reads that start in it). With ``push``, filters on contig, ref_start and ref_end are pushed down as well.
Spark 4.1 keeps one set of pushed filters for a loaded frame, so a frame with ``push`` is for one place of one
plan, and always filtered; that is why it is not the default. Of an indexed file the hierarchical bins that a region touches, less what the linear index shows to end before it, give the
spans of the file that are read; spans are cut at places where records begin and dealt to tasks by SPLIT_BYTES.
A file without an index is one task. ``aln_idx`` is a record's virtual offset, whatever else is read.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from . import bam

# Fixed values of the format: a level of bins is the shift of its windows and the number of its first bin.
LEVELS = ((29, 0), (26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
WINDOW = 14
FURTHEST = 1 << 29
COLUMNS = [x.split()[0] for x in bam.SCHEMA.split(", ")]
KINDS = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
ARROW = pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in bam.SCHEMA.split(", "))])


@dataclass
class ContigIndex:
    """A contig's part of an index; ``mapped`` and ``unmapped`` are None where the index does not count."""

    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)
    mapped: int | None = None
    unmapped: int | None = None


def read_index(path: str) -> list[ContigIndex]:
    """The index beside a file; empty without one."""
    try:
        with bam.open_stream(f"{path}.bai") as file:
            data = file.read()
    except FileNotFoundError:
        return []
    at, out = 8, []

    def numbers(form: str) -> tuple:
        nonlocal at
        at += struct.calcsize(form)
        return struct.unpack_from(form, data, at - struct.calcsize(form))

    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        own = ContigIndex()
        for _ in range(numbers("<i")[0]):
            number, n = numbers("<Ii")
            places = numbers(f"<{2 * n}Q")
            if number == bam.COUNTS_BIN:
                own.mapped, own.unmapped = places[2:4]
            else:
                own.bins[number] = list(zip(places[::2], places[1::2]))
        own.linear = list(numbers(f"<{numbers('<i')[0]}Q"))
        out.append(own)
    return out


def spans(index: ContigIndex, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) virtual offsets of what may hold records that touch [start, end), apart from one another and in order."""
    start, end = max(start, 0), min(end, FURTHEST)
    if start >= end:
        return []
    # of a window without records nothing is known; those beyond the last end before the region
    least = index.linear[start >> WINDOW] if start >> WINDOW < len(index.linear) else index.linear[-1] if index.linear else 0
    found = sorted((max(a, least), b) for shift, first in LEVELS for n in range(first + (start >> shift), first + ((end - 1) >> shift) + 1) for a, b in index.bins.get(n, ()) if b > least)
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(index: ContigIndex, found: list[tuple[int, int]], size: int) -> Iterator[tuple[int, int]]:
    """``found`` in pieces of about ``size`` bytes of the file, cut where records begin."""
    begins = sorted({a for chunks in index.bins.values() for a, _ in chunks} | set(index.linear))
    for a, b in found:
        for x in begins:
            if a < x < b and (x >> 16) - (a >> 16) >= size:
                yield a, x
                a = x
        yield a, b


class Part(InputPartition):
    """Spans of one file, each with the region that its records have to start in or, if ``touch``, to touch."""

    def __init__(self, path: str, work: list[tuple]):
        self.path, self.work = path, work


class BamSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bam_regions"

    def schema(self) -> str:
        return bam.SCHEMA

    def reader(self, schema) -> DataSourceReader:
        given = self.options.get("regions")
        kind = PushingReader if self.options.get("push") == "true" else BamReader
        return kind(json.loads(self.options["paths"]), [tuple(r) for r in json.loads(given)] if given else None, int(self.options.get("splitBytes", bam.SPLIT_BYTES)))


class BamReader(DataSourceReader):
    """Reads ``regions``, less what a subclass has narrowed."""

    def __init__(self, paths: list[str], regions: list[tuple] | None, split: int):
        self.paths, self.regions, self.split = paths, regions, split
        self.contigs: set | None = None
        self.first, self.stop, self.ends_after = 0, FURTHEST, -1

    def _wanted(self, names: list[tuple[str, int]]) -> dict[str, list[tuple[int, int]]]:
        """By contig the apart ranges that records have to start in."""
        given = [(n, 0, FURTHEST) for n, _ in names] if self.regions is None else self.regions
        out: dict[str, list] = {}
        for contig, a, b in sorted(given):
            a, b = max(a, self.first), min(b, self.stop)
            if a < b and (self.contigs is None or contig in self.contigs):
                held = out.setdefault(contig, [])
                if held and a <= held[-1][1]:
                    held[-1] = (held[-1][0], max(b, held[-1][1]))
                else:
                    held.append((a, b))
        return out

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            names, index = bam.bam_contigs(path), read_index(path)
            wanted = self._wanted(names)
            if not index:
                out.append(Part(path, [(0, 0, None, 0, 0)]))
                continue
            held, size = [], 0
            for (contig, _), own in zip(names, index):
                for a, b in wanted.get(contig, ()):
                    for x, y in cut(own, spans(own, a, b), self.split):
                        held.append((x, y, contig, a, b))
                        size += (y >> 16) - (x >> 16)
                        if size >= self.split:
                            out.append(Part(path, held))
                            held, size = [], 0
            if held:
                out.append(Part(path, held))
        return out or [Part("", [])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.work:
            return
        with bam.open_stream(partition.path) as file:
            names = bam.contigs(bam.Inflated(file))
            wanted = self._wanted(names)
            held: list[tuple] = []
            for start, stop, contig, a, b in partition.work:
                file.seek(start >> 16)
                data = bam.Inflated(file, start >> 16)
                if start:
                    data.take(start & 0xFFFF)
                else:
                    bam.contigs(data)
                for row in bam.records(data, names, stop, places=True):
                    if contig is None:
                        if not any(x <= row[4] < y for x, y in wanted.get(row[3], ())):
                            continue
                    elif row[3] != contig or row[4] >= b:
                        break  # sorted by contig and start
                    elif row[4] < a:
                        continue
                    if row[5] > self.ends_after:
                        held.append((partition.path, *row))
                    if len(held) == bam.ROWS:
                        yield _batch(held)
                        held = []
            yield _batch(held)


class PushingReader(BamReader):
    """Takes filters too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Narrows what is read; Spark still decides on every row."""
        for f in filters:
            match f:
                case EqualTo(("contig",), value):
                    self._only({value})
                case In(("contig",), values):
                    self._only(set(values))
                case GreaterThanOrEqual(("ref_start",), value):
                    self.first = max(self.first, value)
                case GreaterThan(("ref_start",), value):
                    self.first = max(self.first, value + 1)
                case LessThan(("ref_start",), value):
                    self.stop = min(self.stop, value)
                case LessThanOrEqual(("ref_start",), value):
                    self.stop = min(self.stop, value + 1)
                case GreaterThan(("ref_end",), value):
                    self.ends_after = max(self.ends_after, value)
                case GreaterThanOrEqual(("ref_end",), value):
                    self.ends_after = max(self.ends_after, value - 1)
            yield f

    def _only(self, contigs: set) -> None:
        self.contigs = contigs if self.contigs is None else self.contigs & contigs


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(ARROW)], schema=ARROW)


def alignments(spark: SparkSession, paths: list[str], regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """The mapped alignments of BAM files that start in one of ``regions`` (contig, start, end), or all."""
    return _load(spark, paths, regions)


def alignments_where(spark: SparkSession, paths: list[str], condition: Column | str) -> DataFrame:
    """The mapped alignments that meet ``condition``, which the index helps with where it compares contig, ref_start or ref_end with constants."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # the second condition holds for all; it is there so that what is pushed is never empty
    return _load(spark, paths, None, push="true").where(condition).where("ref_start >= 0")


def _load(spark: SparkSession, paths: list[str], regions: list | None, **options) -> DataFrame:
    spark.dataSource.register(BamSource)
    source = spark.read.format("bam_regions").option("paths", json.dumps(paths)).options(**options)
    return (source if regions is None else source.option("regions", json.dumps(regions))).load()


def contig_counts(spark: SparkSession, path: str) -> DataFrame:
    """(contig, mapped, length) from the header and the index's own counts, without reading a record; mapped is null where the index does not count."""
    index = read_index(path)
    rows = [(name, own.mapped, length) for (name, length), own in zip(bam.bam_contigs(path), index or [ContigIndex()] * (1 << 20))]
    return spark.createDataFrame(rows, "contig string, mapped long, length long")
