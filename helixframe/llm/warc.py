"""Dictionary-compressed WARC archives (.warc.zst), written and read.

Each task writes archives of its own. It holds back the first records of an archive, builds a
Zstandard dictionary from them, writes it in a leading skippable frame and then compresses every
record into a frame of its own, so any record can be read alone. Where those records are too few or
too small to train on, the dictionary is their own bytes. An archive is closed at ROLL_BYTES.

Records with equal payloads (by SHA-1) of at least ``least`` bytes become revisits of the one with
the largest page id. That page id is one maximum for each digest, combined before the shuffle; the
pages only meet the digests that occur more than once, copies of which they find under several salts,
so a payload may be that of any share of the pages.

Files go to a folder all executors share. Their names hold the task attempt, so an attempt that is
lost leaves files that no manifest lists; the manifest is saved once all are written.

Defined cases: a null payload is empty; a null url is left out of the record; a page with a null id
is a response, and nothing revisits it; rows that repeat the largest id are all responses; an empty
table writes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, columns_as, map_batches, new_path, saved, spread_join

#: Bytes of records that a dictionary is built from, at most.
TRAIN_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
#: An archive is closed once it has so many bytes.
ROLL_BYTES = 256 << 20
READ_BYTES = 1 << 16
#: Fixed value: magic number of the skippable frame that holds a dictionary, by the .warc.zst specification.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_file(uri: str, mode: str):
    """A binary file of a shared store: plain paths and file: directly, other schemes by Arrow's file systems."""
    at = urlparse(uri)
    if at.scheme in ("", "file"):
        if mode == "wb":
            os.makedirs(os.path.dirname(at.path), exist_ok=True)
        return open(at.path, mode)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "wb":
        store.create_dir(path.rpartition("/")[0])
        return store.open_output_stream(path)
    return store.open_input_stream(path)


def planned(pages: DataFrame, least: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set for revisits."""
    rows = columns_as(pages, page_id=id_col, url=url_col, html=payload_col).withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    repeated = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    return spread_join(rows, repeated, ["digest"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit has the HTTP headers of the response, with the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{page_id}>"] if page_id is not None else []
    head += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if refers_to is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """One archive being written."""

    def __init__(self, uri: str, level: int):
        self.uri, self.level, self.held, self.held_bytes, self.n, self.size = uri, level, [], 0, 0, 0
        self.file = self.compressor = None

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor:
            self._put(self.compressor.compress(data))
            return
        self.held.append(data)
        self.held_bytes += len(data)
        if self.held_bytes >= TRAIN_BYTES:
            self._begin()

    def _put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def _begin(self) -> None:
        import zstandard

        self.file = open_file(self.uri, "wb")
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(self.held_bytes // 8, 256)), self.held)
        except zstandard.ZstdError:  # too few or too small records to train on: the records themselves
            trained = zstandard.ZstdCompressionDict(b"".join(self.held)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(trained.as_bytes())) + trained.as_bytes())
        trained.precompute_compress(level=self.level)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=trained, write_checksum=True)
        for x in self.held:
            self._put(self.compressor.compress(x))
        self.held = []

    def close(self) -> dict:
        if not self.compressor:
            self._begin()
        self.file.close()
        return {"path": [self.uri], "records": [self.n], "bytes": [self.size]}


def write(pages: DataFrame, folder: str | None = None, least: int = 1000, level: int = 3, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives; the manifest (path, records, bytes), saved."""
    folder = folder or new_path(pages.sparkSession, "warc")
    rows = planned(pages, least, id_col, url_col, payload_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        archive, count = None, 0
        for batch in batches:
            texts = column(batch, "html").cast(pa.binary())
            for i in range(len(batch)):
                page, url, digest, refers = (column(batch, c)[i].as_py() for c in ("page_id", "url", "digest", "refers_to"))
                if archive is None:
                    archive = Archive(f"{folder}/{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst", level)
                archive.add(record(page, url, texts[i].as_py(), digest, refers, date))
                if archive.size >= ROLL_BYTES:
                    yield pa.RecordBatch.from_pydict(archive.close())
                    archive, count = None, count + 1
        if archive:
            yield pa.RecordBatch.from_pydict(archive.close())

    return saved(rows.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def frames(file: io.RawIOBase) -> Iterator[bytes]:
    """The decompressed records of an archive, one for each frame."""
    import zstandard

    data, dictionary = file.read(READ_BYTES), None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        end = 8 + struct.unpack_from("<I", data, 4)[0]
        while len(data) < end:
            data += file.read(READ_BYTES)
        dictionary, data = zstandard.ZstdCompressionDict(data[8:end]), data[end:]
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data := data or file.read(READ_BYTES):
        one, parts = decompressor.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else file.read(READ_BYTES)
            if not one.eof and not data:
                raise ValueError("an archive ends within a record")
        yield b"".join(parts)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The fields of a record's header, and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def read(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record; ``with_payload`` adds payload (null for revisits).

    A response's length and digest are taken from its payload; if the recorded digest differs, it raises.
    """
    number = lambda x: int(x[len("<urn:page:") : -1]) if x else None
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            for path in column(batch, "path").to_pylist():
                rows: dict = {k: [] for k in names}
                size = 0
                with open_file(path, "rb") as file:
                    for data in frames(file):
                        fields, block = parsed(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        if fields["warc-type"] == "response":
                            length = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"{path}: the payload of {fields.get('warc-record-id')} does not have its digest")
                        else:
                            length, payload = int(http.lower().rpartition(b"content-length:")[2].split(b"\r\n")[0]), None
                        values = (number(fields.get("warc-record-id")), length, digest, fields["warc-type"], number(fields.get("warc-refers-to")), payload)
                        for k, v in zip(names, values):
                            rows[k].append(v)
                        size += len(data)
                        if size >= 8 << 20:
                            yield rows
                            rows, size = {k: [] for k in names}, 0
                yield rows

        return step

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_batches(manifest.repartition(tasks), make, schema)
