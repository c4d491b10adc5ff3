"""Packing: concatenate all token streams and cut the concatenation into fixed windows.

Two passes. The first tokenises every text once, writes the ids to the shared folder and, with
them, each document's offset within its partition. The totals by partition, one number each, give
the partitions' global offsets as prefix sums. The second pass reads the ids and cuts them where
the windows end; what crosses a window's end becomes two pieces, the boundary records. No row is
shuffled and no partition waits for another, so a hot source or a giant text costs nothing extra.

Strings that the vocabulary's file lists as added tokens stand for their one id wherever they occur in
a text, as they do under the ``tokenizers`` library by default.

Defined cases: a null or empty text is one separator token; a null id is kept as null; repeated
rows are packed as often as they come; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, columns_as, map_batches, saved

#: Ids are handed on in batches of about this many bytes.
BATCH_BYTES = 8 << 20

TOKENS = "part int, part_start long, doc_id long, n long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a ``tokenizers`` file and their ids."""
    with open(json_path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    for x in listed:
        if x["lstrip"] or x["rstrip"] or x["single_word"]:
            raise ValueError(f"{x['content']}: tokens that take the white space around them are not supported")
    return {x["content"]: x["id"] for x in listed}


def byte_bpe(ranks_path: str, pattern: str, special: dict[str, int]):
    """A byte-level BPE encoder: text to numpy uint32 ids. ``ranks_path``: base64 token and rank a line.

    The ids are those of the same vocabulary's JSON file under the ``tokenizers`` library (tests
    compare the two on whole tables), at about six times its speed.
    """
    import base64

    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all", disallowed_special=())


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], separator: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """First pass, saved: every text's ids (little-endian uint32, ``separator`` last) and its offset in its partition."""

    def make():
        encode, part, start = byte_bpe(ranks_path, pattern, special), TaskContext.get().partitionId(), 0
        end = np.array([separator], np.uint32)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            nonlocal start
            rows: dict = {k: [] for k in ("part", "part_start", "doc_id", "n", "ids")}
            size = 0
            for doc, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text")):
                ids = np.concatenate([encode(text.as_py()), end]) if text.is_valid else end
                for k, v in zip(rows, (part, start, doc, len(ids), ids.astype("<u4", copy=False).tobytes())):
                    rows[k].append(v)
                start += len(ids)
                size += 4 * len(ids)
                if size >= BATCH_BYTES:
                    yield rows
                    rows, size = {k: [] for k in rows}, 0
            yield rows

        return step

    return saved(map_batches(columns_as(docs, doc_id=id_col, text=text_col), make, TOKENS), "tokens")


def partition_offsets(tokens: DataFrame) -> np.ndarray:
    """Prefix sums of the partitions' totals, indexed by partition: eight bytes for each partition of the scan."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(int(totals["part"].max()) + 2 if len(totals) else 1, np.int64)
    sums[totals["part"].to_numpy(np.int64) + 1] = totals["n"].to_numpy(np.int64)
    return np.cumsum(sums)


def cut(tokens: DataFrame, window: int, with_ids: bool = False) -> DataFrame:
    """Second pass: the pieces of the windows; ``with_ids`` adds each piece's ids as binary."""
    base = tokens.sparkSession.sparkContext.broadcast(partition_offsets(tokens))

    def make():
        offsets = base.value

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            n = column(batch, "n").to_numpy()
            if not len(n):
                return
            at = offsets[column(batch, "part").to_numpy()] + column(batch, "part_start").to_numpy()
            first, last = at // window, (at + n - 1) // window
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = np.maximum(sequence * window, at[row])
            length = np.minimum((sequence + 1) * window, (at + n)[row]) - begin
            start = begin - at[row]
            ids = [memoryview(x) for x in column(batch, "ids").to_pylist()]
            pieces = [ids[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            out = {
                "doc_id": column(batch, "doc_id").take(pa.array(row)),
                "start": start,
                "length": length,
                "ids_crc32": [zlib.crc32(x) for x in pieces],
                "doc_tokens": n[row],
                "sequence_id": sequence,
                "offset": begin - sequence * window,
            }
            yield out | ({"ids": [bytes(x) for x in pieces]} if with_ids else {})

        return step

    return map_batches(tokens, make, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], window: int = 1024, separator: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text in windows of ``window`` tokens: all full, but for the last. ``special``: strings that are one token, and their ids."""
    return cut(tokenised(docs, ranks_path, pattern, special, separator, id_col, text_col), window, with_ids)


def sequences(pieces: DataFrame, window: int = 1024, padding: int = 0) -> DataFrame:
    """The packed windows: ``input_ids`` padded to ``window``, ``segment_ids`` (1 for the first piece, 0 for padding) and ``n_tokens``.

    Takes ``pack(..., with_ids=True)``. A window has at most ``window`` pieces, so that no group is larger.
    """
    import pandas as pd

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("offset")
        ids = np.frombuffer(b"".join(rows["ids"]), "<u4").astype(np.int32)
        segments = np.repeat(np.arange(1, len(rows) + 1, dtype=np.int32), rows["length"])
        pad = window - len(ids)
        return pd.DataFrame({"sequence_id": [key[0]], "input_ids": [np.pad(ids, (0, pad), constant_values=padding)], "segment_ids": [np.pad(segments, (0, pad))], "n_tokens": [len(ids)]})

    return pieces.groupBy("sequence_id").applyInPandas(build, "sequence_id long, input_ids array<int>, segment_ids array<int>, n_tokens int")
