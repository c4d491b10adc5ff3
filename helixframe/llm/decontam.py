"""Benchmark decontamination by a generalised suffix automaton of the normalised test items.

The automaton holds all items at word level. A document's words are streamed through it, and at
each word it keeps the length of the longest match that ends there. A match as long as an item's
window (``window`` words, or the whole of a shorter item) marks the window's words as hit.

Only runs of words that the items know can match, so a run shorter than the shortest window is
skipped and the automaton starts anew in the next; that is exact.

The items are read in shards of at most ``SHARD_WORDS`` words. One shard is broadcast at a time:
its size is bounded by that number. A larger benchmark takes one pass over the documents for each
shard, which writes the marks of rows with hits and no texts; then the marks of all shards are united
for each row.

Defined cases: null or blank texts have no words and stay; an item without words never matches; an
item with a null id marks words but is not listed; equal item ids count once; null doc ids and
repeated rows are kept as they are; an empty benchmark hits nothing; other columns are ignored by
``matches`` and kept by ``remove_spans``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .common import LOWER, column, columns_as, map_batches, new_path, plain_words

#: Words of the items in one automaton; at about 0.5 KB a word a task holds 100 MB at most.
SHARD_WORDS = 200_000
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class SuffixAutomaton:
    """Generalised suffix automaton of sequences of ints, with the windows that end in each state."""

    def __init__(self, items: Iterable[tuple[str | None, list[int]]], window: int):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.shortest = window
        ends: list[tuple[int, int, str | None]] = []
        for name, words in items:
            last, size = 0, min(window, len(words))
            self.shortest = min(self.shortest, size)
            for i, w in enumerate(words):
                last = self._extend(last, w)
                if i + 1 >= size:
                    ends.append((last, size, name))
        own: list[dict[int, set]] = [{} for _ in self.next]
        for state, size, name in ends:  # the state whose lengths include the window's
            while self.len[self.link[state]] >= size:
                state = self.link[state]
            own[state].setdefault(size, set()).add(name)
        #: By state: (length, names) of every window that is a suffix of the state's longest match.
        self.windows: list[list[tuple[int, frozenset]]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            self.windows[state] = self.windows[self.link[state]] + [(k, frozenset(v)) for k, v in sorted(own[state].items())]

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, w, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, w, q)
        else:
            self.link[cur] = 0
        return cur

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.len.append(length)
        return len(self.len) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def stream(self, words: list[int]) -> Iterator[tuple[int, int, frozenset]]:
        """(end, length, names) of every window that ends at a word; the longest last."""
        state = matched = 0
        step, link, size, windows = self.next, self.link, self.len, self.windows
        for i, w in enumerate(words):
            while state and w not in step[state]:
                state = link[state]
                matched = size[state]
            if w in step[state]:
                state = step[state][w]
                matched += 1
                for length, names in windows[state]:
                    if length <= matched:
                        yield i + 1, length, names


class Matcher:
    """Marks the words of texts that windows of the items cover."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        class Ids(dict):
            def __missing__(self, word):
                return 0

        self.ids = Ids()
        rows = [(name, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for name, text in items if (words := plain_words(text))]
        self.automaton = SuffixAutomaton(rows, window)

    def mark(self, words: list[bytes]) -> tuple[np.ndarray | None, set]:
        """A flag for each word, or None if there is no hit, and the names of the items found."""
        n, least = len(words), self.automaton.shortest
        ids = np.fromiter(map(self.ids.__getitem__, words), np.int64, n)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).view(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= least
        hit, names = None, set()
        for a, b in zip(begin[long].tolist(), end[long].tolist()):
            for at, length, found in self.automaton.stream(ids[a:b].tolist()):
                if hit is None:
                    hit = np.zeros(n, bool)
                hit[a + at - length : a + at] = True
                names |= found
        return hit, names


def shards(items: DataFrame, window: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in lists of at most SHARD_WORDS words; a longer item is split, its pieces overlapping by a window less one word."""
    held, words = [], 0
    for row in items.toLocalIterator():
        all_words = plain_words((row["text"] or "").encode())
        step = SHARD_WORDS - window
        for i in range(0, max(len(all_words) - window + 1, 1), step):
            piece = all_words[i : i + step + window - 1]
            if held and words + len(piece) > SHARD_WORDS:
                yield held
                held, words = [], 0
            held.append((None if row["item_id"] is None else str(row["item_id"]), b" ".join(piece)))
            words += len(piece)
    yield held


def _marked(df: DataFrame, doc_id: str, text: str, items: DataFrame, window: int, finish, schema) -> DataFrame:
    """``finish`` over the batches of ``df`` and, for each row, its number of words, a flag for each word (None without a hit) and the names of the items found."""
    spark, names_of = df.sparkSession, df.columns
    of = shards(items, window)
    first, second = next(of), next(of, None)
    if second is None:
        sent = spark.sparkContext.broadcast(first)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, window)
            for batch in batches:
                words = (plain_words(x or b"") for x in column(batch, text).cast(pa.binary()).to_pylist())
                yield finish(batch, [(len(w), *matcher.mark(w)) for w in words])

        return df.mapInArrow(run, schema)

    # Several: each shard's pass writes the marks of rows with hits only, by id and text; then they are united
    folder, key = new_path(spark, "marks"), ["_id", "_raw"]
    keyed = df.withColumns({"_id": F.struct(F.col(doc_id)), "_raw": F.xxhash64(text)})
    for i, shard in enumerate(chain([first, second], of)):
        _hits(keyed.select(*key, F.col(text).alias("text")), shard, window).withColumn("shard", F.lit(i)).write.mode("append").parquet(folder)
    hits = spark.read.parquet(folder).groupBy(*key, "shard").agg(F.max("spans").alias("spans"), F.max("names").alias("names"))  # equal rows have equal marks
    united = hits.groupBy(*key).agg(F.collect_list(F.struct("spans", "names")).alias("_marks"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, marks in zip(column(batch, text).cast(pa.binary()).to_pylist(), column(batch, "_marks").to_pylist()):
                n, hit, names = len(plain_words(x or b"")), None, set()
                for m in marks or ():
                    hit = np.zeros(n, bool) if hit is None else hit
                    for a, b in np.frombuffer(m["spans"], "<i8").reshape(-1, 2):
                        hit[a:b] = True
                    names |= set(m["names"])
                out.append((n, hit, names))
            yield finish(batch.select(names_of), out)

    return keyed.join(united, key, "left").select(*df.columns, "_marks").mapInArrow(unite, schema)


def _hits(rows: DataFrame, shard: list, window: int) -> DataFrame:
    """(_id, _raw, spans, names) of the rows (_id, _raw, text) that windows of the shard hit."""
    sent = rows.sparkSession.sparkContext.broadcast(shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, window)
        for batch in batches:
            marks = [matcher.mark(plain_words(x or b"")) for x in column(batch, "text").cast(pa.binary()).to_pylist()]
            at = [i for i, (hit, _) in enumerate(marks) if hit is not None]
            kept = [column(batch, c).take(pa.array(at, pa.int64())) for c in ("_id", "_raw")]
            spans = pa.array([_spans(marks[i][0]) for i in at], pa.binary())
            names = pa.array([sorted(x for x in marks[i][1] if x is not None) for i in at], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*kept, spans, names], names=["_id", "_raw", "spans", "names"])

    return rows.mapInArrow(run, rows.select("_id", "_raw").schema.add("spans", "binary").add("names", ArrayType(StringType())))


def _spans(hit: np.ndarray) -> bytes:
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).astype("<i8").tobytes()


def matches(docs: DataFrame, items: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_words, spans, items) for every row: half-open word ranges that windows cover, merged, and the items found.

    ``spans`` is binary: pairs of little-endian int64.
    """

    def finish(batch: pa.RecordBatch, marks: list) -> pa.RecordBatch:
        n = pa.array([m[0] for m in marks], pa.int64())
        spans = pa.array([b"" if hit is None else _spans(hit) for _, hit, _ in marks], pa.binary())
        names = pa.array([sorted(x for x in found if x is not None) for *_, found in marks], pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), n, spans, names], names=["doc_id", "text", "n_words", "spans", "items"])

    at = columns_as(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _marked(at, "doc_id", "text", columns_as(items, item_id=item_id_col, text=item_text_col), window, finish, "doc_id long, text string, n_words long, spans binary, items array<string>")


def digest(found: DataFrame) -> DataFrame:
    """The report of ``matches``: counts, and the SHA-256 of the sorted ids of the items found."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            pairs = [np.frombuffer(x, "<i8") for x in column(batch, "spans").to_pylist()]
            hit = [int(p[1::2].sum() - p[::2].sum()) for p in pairs]
            items = column(batch, "items").to_pylist()
            yield {
                "doc_id": column(batch, "doc_id"),
                "n_words": column(batch, "n_words"),
                "n_hit": hit,
                "n_items": list(map(len, items)),
                "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items],
                "contaminated": [x > 0 for x in hit],
            }

        return step

    return map_batches(found.select("doc_id", "n_words", "spans", "items"), make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def cut_spans(text: bytes, spans: bytes) -> bytes:
    """The text without the words of the spans and what stands between them; what is left on both sides is joined by one space."""
    pairs = np.frombuffer(spans, "<i8").reshape(-1, 2)
    words = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    kept, at = [], 0
    for a, b in pairs.tolist():
        kept.append(text[at : words[a][0]].strip())
        at = words[b - 1][1]
    kept.append(text[at:].strip())
    return b" ".join(x for x in kept if x)


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.5) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the hit spans; a document goes if more than ``max_coverage`` of its words are hit.

    All other columns stay. Texts without hits are handed on unchanged. The marks of all shards are united
    before anything is cut or judged.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index("text")

    def finish(batch: pa.RecordBatch, marks: list) -> pa.RecordBatch:
        field = batch.schema.field(at)
        texts = batch.column(at).cast(pa.binary()).to_pylist()
        cut = [x if hit is None else cut_spans(x, _spans(hit)) for x, (_, hit, _) in zip(texts, marks)]
        keep = [hit is None or hit.sum() <= max_coverage * n for n, hit, _ in marks]
        return batch.set_column(at, field, pa.array(cut, pa.binary()).cast(field.type)).filter(pa.array(keep, pa.bool_()))

    found = _marked(plain, f"c{names.index('doc_id')}", f"c{at}", columns_as(items, item_id="item_id", text="text"), window, finish, plain.schema)
    return found.toDF(*names)
