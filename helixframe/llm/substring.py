"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words. Every word that a window covers goes, if the same window
also starts in a document with a smaller id. Four steps, each linear in the input:

1. Whole copies. Documents with the same words as one of a smaller id are repeats throughout; only
   the first of each group goes on. A group of a million copies is one row from here on.
2. Phrases. In every window the phrase of ``phrase`` words with the smallest hash is selected
   (winnowing), so equal windows select equal phrases wherever they stand. Phrases that two
   documents select are recurring; no window without a recurring phrase can recur.
3. Automata. Documents are dealt into blocks by a hash of id and text, so that rows without an id, or of
   one id, spread. For each block the recurring
   phrases that its documents select are compiled into an Aho-Corasick automaton, its shard, and all
   texts of the block stream through it. That gives every occurrence of every phrase, and so every
   window that may recur: those whose own selected phrase occurs. A block sends one row for each
   such distinct window, with its smallest id. Over the blocks, the rows confirm the recurring ones.
4. Removal. Confirmed windows go back to the blocks that hold them, and the blocks' documents are
   streamed once more to mark the words.

Words are compared by 128-bit hashes of their bytes, windows by 96 bits made of them.
No group is gathered: rows of a phrase or window are combined to one for each block before they are
shuffled. A shard is as large as its block, which BLOCK_BYTES bounds at any size of the input.

Defined cases: null, empty and blank texts have no words; rows with a null id keep all their words
and remove none; repeated rows have the same id, so do not remove each other; an empty table gives
no rows; other columns are ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_bytes, column, columns_as, map_batches, numbers, saved

#: Bytes of text in one block, and of those handled at once.
BLOCK_BYTES = 4 << 20
CHUNK_BYTES = 1 << 20
#: Words kept in the hash cache of a task.
CACHE_WORDS = 1 << 17
#: Size of the table of flags that spares most lookups of windows.
FILTER_BITS = 22
WINDOWS = "h1 long, h2 int, block int, least long, most long"
PHRASE_TYPES = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
#: Odd 64-bit multipliers of the rolling hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Of a window's two hashes 64 and 32 bits are sent.
SHIFTS = (np.uint64(0), np.uint64(32))


class WordHashes(dict):
    """128-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        value = xxhash.xxh3_128_digest(word)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        """(n, 2) uint64."""
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64).reshape(-1, 2)


class Rolling:
    """Hashes of all runs of ``size`` words: sums of word hash times power, as differences of prefix sums modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.powers = self.inverses = np.ones(1, np.uint64)

    def __call__(self, hashes: np.ndarray, size: int) -> np.ndarray:
        n = len(hashes)
        if len(self.powers) < n:
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, self.base))])
            self.inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, self.inverse))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * self.powers[:n])])
        return mixed((sums[size:] - sums[:-size]) * self.inverses[: n - size + 1])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0


class Words:
    """The words of several texts in a row, and which text each belongs to."""

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.begin = np.cumsum(self.counts) - self.counts
        self.words = list(chain.from_iterable(split))
        self.flat = b" " + b" ".join(self.words) + b" "
        self.after = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)  # where the blank behind each word stands
        self.text_of = np.repeat(np.arange(len(split)), self.counts)

    def __len__(self) -> int:
        return len(self.words)

    def of_text(self, i: int) -> list[bytes]:
        return self.words[self.begin[i] : self.begin[i] + self.counts[i]]

    def whole(self, window: int) -> np.ndarray:
        """For each start of ``window`` words, whether all are of one text."""
        last = max(len(self) - window + 1, 0)
        return self.text_of[:last] == self.text_of[window - 1 :] if last else np.zeros(0, bool)

    def occurrences(self, automaton) -> np.ndarray:
        """By word, whether a phrase of the automaton starts there. Phrases are told from their end, so all have one length."""
        ends = np.fromiter((e for e, _ in automaton.iter(self.flat.decode("latin-1"))), np.int64)
        return np.searchsorted(self.after, ends)


def chunks(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[range, list[bytes]]]:
    """The texts of a column in turns of about CHUNK_BYTES, with their rows."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy())
    first = 0
    while first < len(ends):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + CHUNK_BYTES)), first) + 1
        yield range(first, min(last, len(ends))), as_bytes(column.slice(first, last - first))
        first = last


def selected(grams: np.ndarray, span: int) -> np.ndarray:
    """For every ``span`` neighbours, the position of the smallest (leftmost)."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    at, k = np.arange(len(grams)), 1
    while k < span:  # minima over 1, 2, 4, ... neighbours, then over the span
        step = min(k, span - k)
        left, right = at[:-step], at[step:]
        at = np.where(grams[left] <= grams[right], left, right)
        k += step
    return at


def _found(docs: DataFrame, window: int, phrase: int, id_col: str, text_col: str, carry: str | None, finish, schema) -> DataFrame:
    """Steps 1 to 4; ``finish`` takes a table (doc_id, text, rest) and the spans of its rows, and gives columns of ``schema``."""
    rows = columns_as(docs, doc_id=id_col, text=text_col, **({"rest": carry} if carry else {}))
    blocks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-text_bytes(rows) // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")

    # 1 and 2: one row for each phrase that a document selects, and one for the document's words as a whole
    chosen = saved(_select(rows.select("doc_id", "text", block.alias("block")), window, phrase), "phrases")
    whole = chosen.where("words is not null").groupBy("words").agg(F.min("doc_id").alias("first"))
    copies = chosen.where("words is not null").join(whole, "words").where("doc_id > first").select("block", "doc_id", "words")
    recurring = chosen.where("words is null").groupBy("gram").agg(F.min("least").alias("a"), F.max("most").alias("b")).where("a < b").select("gram")
    shards = chosen.where("words is null").join(recurring, "gram", "left_semi").select("block", "phrase")

    # 3: automata by block; a window has a row for each block at most
    dealt = rows.withColumn("block", block)
    same = W.partitionBy("h1", "h2")
    seen = _together(dealt, copies.unionByName(shards, allowMissingColumns=True), lambda key, docs, marks: _locate(key[0].as_py(), docs, marks, window), WINDOWS)
    confirmed = seen.withColumns({"first": F.min("least").over(same), "last": F.max(F.coalesce("most", "least")).over(same)}).where("first < last").select("block", "h1", "h2", "first")

    # 4: removal by block
    marks = copies.unionByName(confirmed, allowMissingColumns=True)
    return _together(dealt, marks, lambda docs, marks: finish(docs, _spans(docs, marks, window)), schema)


def _together(dealt: DataFrame, marks: DataFrame, run, schema) -> DataFrame:
    """``run`` over each block's documents and marks. The documents' exchange is the same in both steps, so Spark reuses it."""
    return dealt.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(run, schema)


def words_hash(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _select(rows: DataFrame, window: int, phrase: int) -> DataFrame:
    """Phrases: (gram, phrase, block, least, most), combined within a chunk; documents: (words, block, doc_id)."""

    def make():
        hashes, roll = WordHashes(), Rolling(BASES[0])

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            all_ids, all_blocks = numbers(column(batch, "doc_id")), column(batch, "block").to_numpy()
            for at, texts in chunks(column(batch, "text")):
                ids, blocks = all_ids[at.start : at.stop], all_blocks[at.start : at.stop]
                text = Words(texts)
                whole = np.flatnonzero(text.counts >= window)
                out = {"gram": [], "block": [], "phrase": [], "least": [], "most": []}
                if len(whole):
                    grams = roll(hashes.of(text.words)[:, 0], phrase)
                    own = np.unique(selected(grams, window - phrase + 1)[text.whole(window)])
                    gram, of = grams[own].view(np.int64), text.text_of[own]
                    order = np.lexsort((blocks[of], gram))
                    gram, block, doc, own = gram[order], blocks[of][order], ids[of][order], own[order]
                    start = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])]))
                    begin, end = (text.after - np.fromiter(map(len, text.words), np.int64, len(text)))[own[start]], text.after[own[start] + phrase - 1]
                    out = {
                        "gram": gram[start],
                        "block": block[start],
                        "phrase": [text.flat[a:b] for a, b in zip(begin.tolist(), end.tolist())],
                        "least": np.minimum.reduceat(doc, start),
                        "most": np.maximum.reduceat(doc, start),
                    }
                k, m = len(out["gram"]), len(whole)
                yield {c: pa.concat_arrays([pa.array(v, t), pa.nulls(m, t)]) for (c, v), t in zip(out.items(), PHRASE_TYPES) if c != "block"} | {
                    "block": np.concatenate([np.array(out["block"], np.int32), blocks[whole]]),
                    "words": [None] * k + [words_hash(text.of_text(i)) for i in whole.tolist()],
                    "doc_id": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(ids[whole])]),
                }

        return step

    return map_batches(rows.where("doc_id is not null"), make, "gram long, block int, phrase binary, least long, most long, words binary, doc_id long")


def _copies(marks: pa.Table) -> set[tuple[int, bytes]]:
    words = marks["words"]
    known = marks.filter(words.is_valid())
    return set(zip(known["doc_id"].to_pylist(), known["words"].to_pylist()))


def _is_copy(copies: set, ids: np.ndarray, text: Words) -> np.ndarray:
    known = {d for d, _ in copies}
    return np.array([d in known and (d, words_hash(text.of_text(i))) in copies for i, d in enumerate(ids.tolist())], bool)


def _locate(block: int, docs: pa.Table, marks: pa.Table, window: int) -> pa.Table:
    """(h1, h2, block, least, most): the block's distinct windows whose own phrase recurs; most is null if it is least."""
    import ahocorasick

    automaton, size = ahocorasick.Automaton(), 0
    for x in marks["phrase"].drop_null().to_pylist():
        size = x.count(b" ") + 1
        automaton.add_word(f" {x.decode('latin-1')} ", True)
    held, owners = [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)]
    if len(automaton) and len(docs):
        automaton.make_automaton()
        copies, hashes, rolls = _copies(marks), WordHashes(), [Rolling(b) for b in BASES]
        docs = docs.filter(docs["doc_id"].is_valid())
        all_ids = docs["doc_id"].to_numpy()
        for at, texts in chunks(docs["text"]):
            text, ids = Words(texts), all_ids[at.start : at.stop]
            whole = text.whole(window)
            if not whole.any() or not len(last := text.occurrences(automaton)):
                continue
            occurs = np.zeros(len(text), bool)
            occurs[last - size + 1] = True
            own = hashes.of(text.words)
            phrase = selected(rolls[0](own[:, 0], size), window - size + 1)
            starts = np.flatnonzero(whole & occurs[phrase] & ~_is_copy(copies, ids, text)[text.text_of[: len(whole)]])
            held.append(np.stack([roll(own[:, i], window)[starts] >> shift for i, (roll, shift) in enumerate(zip(rolls, SHIFTS))], axis=1))
            owners.append(ids[text.text_of[starts]])
    h, ids = np.concatenate(held), np.concatenate(owners)
    order = np.lexsort((h[:, 1], h[:, 0]))
    h, ids = h[order], ids[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]).any(axis=1)])) if len(h) else np.zeros(0, np.int64)
    least, most = (f.reduceat(ids, start) if len(h) else ids for f in (np.minimum, np.maximum))
    return pa.table({"h1": h[start, 0].copy().view(np.int64), "h2": h[start, 1].astype(np.uint32).view(np.int32), "block": np.full(len(start), block, np.int32), "least": least, "most": pa.array(most, mask=most == least)})


def _spans(docs: pa.Table, marks: pa.Table, window: int) -> list[bytes]:
    """For each row, the merged half-open word ranges to remove: pairs of little-endian int64."""
    known = marks.filter(marks["h1"].is_valid())
    table = np.stack([known[c].to_numpy() for c in ("h1", "h2", "first")], axis=1)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    here = np.zeros(1 << FILTER_BITS, bool)
    here[table[:, 0] & (len(here) - 1)] = True
    copies, hashes, rolls = _copies(marks), WordHashes(), [Rolling(b) for b in BASES]
    all_ids, out = docs["doc_id"].to_pylist(), []
    for at, texts in chunks(docs["text"]):
        text = Words(texts)
        ids = np.array([np.iinfo(np.int64).min if x is None else x for x in all_ids[at.start : at.stop]], np.int64)
        spans = [b""] * len(ids)
        whole = text.whole(window)
        if len(table) and whole.any():
            own = hashes.of(text.words)
            h1 = rolls[0](own[:, 0], window).view(np.int64)
            live = np.flatnonzero(whole & here[h1 & (len(here) - 1)])
            h2 = (rolls[1](own[:, 1], window) >> SHIFTS[1]).astype(np.uint32).view(np.int32)
            row, hit = np.searchsorted(table[:, 0], h1[live]), np.zeros(len(text), bool)
            while len(live):  # entries with equal first halves stand together
                inside = row < len(table)
                live, row = live[inside], row[inside]
                same = table[row, 0] == h1[live]
                live, row = live[same], row[same]
                hit[live] |= (table[row, 1] == h2[live]) & (table[row, 2] < ids[text.text_of[live]])
                row = row + 1
            begin = np.flatnonzero(hit)
            delta = np.zeros(len(text) + 1, np.int64)
            delta[begin] += 1
            delta[begin + window] -= 1  # starts are distinct, so are their ends
            gone = np.cumsum(delta)[:-1] > 0
            for i in np.unique(text.text_of[begin]).tolist():
                part = gone[text.begin[i] : text.begin[i] + text.counts[i]]
                spans[i] = np.flatnonzero(np.diff(np.concatenate([[0], part.view(np.int8), [0]]))).astype("<i8").tobytes()
        if copies:
            for i in np.flatnonzero(_is_copy(copies, ids, text)).tolist():
                spans[i] = np.array([0, text.counts[i]], "<i8").tobytes()
        out += spans
    return out


def kept_words(text: bytes, spans: bytes) -> list[bytes]:
    words, kept, at = text.split(), [], 0
    for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2).tolist():
        kept += words[at:a]
        at = b
    return kept + words[at:]


def repeats(docs: DataFrame, window: int = 50, phrase: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans array<struct<start, stop>>) for every row: the merged half-open word ranges to remove.

    Words stand between ASCII white space and are compared as they are.
    """

    def finish(docs: pa.Table, spans: list[bytes]) -> pa.Table:
        pairs = [[{"start": a, "stop": b} for a, b in np.frombuffer(s, "<i8").reshape(-1, 2).tolist()] for s in spans]
        return pa.table({"doc_id": docs["doc_id"], "text": docs["text"], "spans": pa.array(pairs, pa.list_(pa.struct({"start": pa.int64(), "stop": pa.int64()})))})

    return _found(docs, window, phrase, id_col, text_col, None, finish, "doc_id long, text string, spans array<struct<start:long,stop:long>>")


def digest(docs: DataFrame, window: int = 50, phrase: int = 6) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): counts, and the SHA-256 of the kept words joined by one space."""

    def finish(docs: pa.Table, spans: list[bytes]) -> pa.Table:
        kept = [kept_words(t, s) for t, s in zip(as_bytes(docs["text"]), spans)]
        removed = [int(p[1::2].sum() - p[::2].sum()) for p in (np.frombuffer(s, "<i8") for s in spans)]
        n, sha = [len(k) + r for k, r in zip(kept, removed)], [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
        return pa.table({"doc_id": docs["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    return _found(docs, window, phrase, "doc_id", "text", None, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = 50, phrase: int = 6) -> DataFrame:
    """``docs`` (doc_id, text, ...) with the repeated words cut out of ``text``; rows of which nothing is left go.

    Texts without repeats are handed on unchanged; in the others words are joined by one space.
    """
    names = [f.name for f in docs.schema.fields]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, at = (f"c{names.index(x)}" for x in ("doc_id", "text"))
    plain = plain.withColumn("rest", F.struct(*(c for c in plain.columns if c != at)))

    def finish(docs: pa.Table, spans: list[bytes]) -> pa.Table:
        texts = [b" ".join(kept_words(t, s)) if s else t for t, s in zip(docs["text"].cast(pa.binary()).to_pylist(), spans)]
        keep = pa.array([not s or t != b"" for t, s in zip(texts, spans)], pa.bool_())
        return pa.table({"text": pa.array(texts, pa.binary()).cast(pa.string()), "rest": docs["rest"]}).filter(keep)

    left = _found(plain, window, phrase, doc, at, "rest", finish, plain.select(F.col(at).alias("text"), "rest").schema)
    return left.select(*(F.col("text") if c == at else F.col(f"rest.{c}") for c in plain.columns if c != "rest")).toDF(*names)
