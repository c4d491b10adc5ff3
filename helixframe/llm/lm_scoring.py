"""Cross-entropy difference of two matched bigram models.

The target model is counted over the target documents, the background model over all documents.
They are matched: one order, one smoothing, one vocabulary (the V distinct words of all documents),
and background counts scaled to the target's number of tokens.

    p(w)     = (c(w) + alpha) / (N + alpha * V)
    p(w | v) = (c(v, w) + mu * p(w)) / (c(v) + mu)

A document's score is the mean, over its words, of the target's loss less the background's loss;
lower is closer to the target. Counts cover whole texts of all documents. What is counted (words,
words as contexts, pairs) has a 64-bit key made of 64-bit hashes of the words; nothing is put into
buckets, so the tables grow with the corpus.

Documents are read once, in blocks of at least RUN_TOKENS tokens or what a task has of them, and saved
as numbers of the block's own distinct words. Then

1. Each block sends every distinct key with the block's own two counts of it, once, to the task that
   the key's leading bits name: one row for each task. However common a word or pair is, a block
   sends it once, so there is no hot key.
2. That task has all of a key's counts. It answers every row with the two totals of each key in it,
   in the row's order, and gives the totals of all words and the number of distinct words.
3. The answers meet their block, which knows its keys in the same order, looks its pairs up by place
   and sums the losses of its documents.

So keys go out once and counts come back once: what moves is in proportion to the input at any size.

Defined cases: texts without words (null, empty, blank) have n_words 0 and null scores; rows with
null ids count in the background and are scored; target ids that no document has do nothing; with no
target words the target model is uniform; rows count as often as they come, also if their id repeats;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, columns_as, plain_words, saved

CACHE_WORDS = 1 << 19
#: A table of ids is broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Tokens of a block, and such that one task of the counts is planned for.
RUN_TOKENS, TASK_TOKENS = 1_000_000, 2_000_000
#: The last two bits of a key: what it counts.
PAIR, WORD, CONTEXT = 0, 1, 2
#: Stands before the first word of a text.
START = 0
BLOCKS = "block long, n long, ids array<long>, sizes binary, target binary, words binary, at binary"
ASKED = "block long, bucket int, keys binary, target binary, background binary"
TOLD = "block long, bucket int, target binary, background binary, n_target long, n_background long, n_words long"


class WordKeys(dict):
    """64-bit hashes of words, remembered; none is START."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = max(xxhash.xxh64_intdigest(word), START + 1)
        if len(self) < CACHE_WORDS:
            self[word] = value
        return value

    def of(self, text: bytes) -> np.ndarray:
        words = plain_words(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def small(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def written(x: np.ndarray) -> bytes:
    """Unsigned numbers: the size of one, then their bytes by place, so that places which are mostly zero compress to little."""
    x = small(x)
    return bytes([x.itemsize]) + x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[1:].reshape(data[0], -1).T).view(f"<u{data[0]}").ravel().astype(np.int64)


def written_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return written(np.diff(keys, prepend=np.uint64(0)))


def keys_of(data: bytes) -> np.ndarray:
    return np.cumsum(numbers_of(data).view(np.uint64))


def flagged(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` with ``target``: whether doc_id is in ``ids`` (doc_id). Broadcast if that is small; else by a shuffle, for which null ids are dealt by their text."""
    ids = ids.where("doc_id is not null").select("doc_id", F.lit(True).alias("target")).distinct()
    if ids.count() <= BROADCAST_ROWS:
        return docs.join(F.broadcast(ids), "doc_id", "left").withColumn("target", F.coalesce("target", F.lit(False)))
    known = docs.where("doc_id is not null").join(ids, "doc_id", "left").select("doc_id", "text", F.coalesce("target", F.lit(False)).alias("target"))
    return known.unionByName(docs.where("doc_id is null").select("doc_id", "text", F.lit(False).alias("target")))


def blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS, saved: the rows of ``docs`` (doc_id, text, target), their words as numbers of the block's distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keys, block = WordKeys(), TaskContext.get().partitionId() << 32
        held, target, ids, n = [], [], [], 0

        def block_of() -> pa.RecordBatch:
            words, at, n_of = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order = np.argsort(-n_of, kind="stable")  # the commonest have the smallest numbers
            words, at = words[order], np.argsort(order)[at]
            values = [[block], [n], [ids], [written(np.array([len(x) for x in held]))], [written(np.array(target, np.uint8))], [words.tobytes()], [written(at)]]
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=[x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for text, flag, own in zip(as_bytes(column(batch, "text")), column(batch, "target").to_pylist(), column(batch, "doc_id").to_pylist()):
                held.append(keys.of(text))
                target.append(flag)
                ids.append(own)
                n += len(held[-1])
                if n >= RUN_TOKENS:
                    yield block_of()
                    held, target, ids, n, block = [], [], [], 0, block + 1
        if held:
            yield block_of()

    return saved(docs.mapInArrow(run, BLOCKS), "blocks")


class Block:
    """One row of BLOCKS: its keys, sorted, and its documents' places among them."""

    def __init__(self, sizes: bytes, target: bytes, words: bytes, at: bytes):
        self.sizes, self.flags = numbers_of(sizes), numbers_of(target) > 0
        hashes, at = np.frombuffer(words, np.uint64), numbers_of(at)
        n, size = len(at), len(hashes)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        begin = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        before = np.concatenate([[size], at[:-1]])[:n]
        before[begin] = size
        hashes = np.append(hashes, np.uint64(START))
        # Distinct pairs, as numbers of the block's words, then all keys in order
        pairs, pair = np.unique(before * (size + 1) + at, return_inverse=True)
        v, w = pairs // (size + 1), pairs % (size + 1)
        mine = self.flags[self.owner]
        contexts = np.unique(v)
        kinds = [(hashes[w], hashes[v], PAIR), (hashes[:-1], np.uint64(WORD), WORD), (hashes[contexts], np.uint64(CONTEXT), CONTEXT)]
        keys = np.concatenate([self._mixed(x, y) & ~np.uint64(3) | np.uint64(kind) for x, y, kind in kinds])
        places = [pair, len(pairs) + at, len(pairs) + size + np.searchsorted(contexts, before)]
        self.keys, order = np.unique(keys, return_inverse=True)
        #: By token: where its pair, its word and its context stand in ``keys``.
        self.places = [order[p] for p in places]
        self.counts = [sum(np.bincount(p[chosen], minlength=len(self.keys)) for p in self.places) for chosen in (mine, slice(None))]

    @staticmethod
    def _mixed(x, y):
        x = (x ^ (y >> np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15) + y
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys, and the end: buckets are equal parts of the keys' leading 32 bits."""
    least = np.array([-(-(i << 32) // buckets) << 32 for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, least), [len(keys)]])


def asked(held: DataFrame, buckets: int) -> DataFrame:
    """ASKED: each block's keys and own counts, a row for each bucket that has some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                own = Block(*(column(batch, c)[i].as_py() for c in ("sizes", "target", "words", "at")))
                edges = bucket_edges(own.keys, buckets).tolist()
                spans = [(b, x, y) for b, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]
                for j in range(0, len(spans), 256):
                    part = spans[j : j + 256]
                    columns = [
                        pa.array([column(batch, "block")[i].as_py()] * len(part), pa.int64()),
                        pa.array([b for b, _, _ in part], pa.int32()),
                        pa.array([written_keys(own.keys[x:y]) for _, x, y in part], pa.binary()),
                        *(pa.array([written(c[x:y]) for _, x, y in part], pa.binary()) for c in own.counts),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ASKED.split(", ")])

    return held.select("block", "sizes", "target", "words", "at").mapInArrow(run, ASKED)


def told(rows: DataFrame) -> DataFrame:
    """TOLD: for each row of ASKED the totals of its keys; ``rows`` is dealt by bucket. One row of a task, without bucket, has its words' totals and their number."""
    names = [x.split()[0] for x in TOLD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bucket, keys, counts = [], [], [], ([], [])
        for batch in batches:
            block += column(batch, "block").to_pylist()
            bucket += column(batch, "bucket").to_pylist()
            keys += [keys_of(x) for x in column(batch, "keys").to_pylist()]
            for own, c in zip(counts, ("target", "background")):
                own += [numbers_of(x) for x in column(batch, c).to_pylist()]
        if not keys:
            return
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.bincount(at, weights=np.concatenate(x), minlength=len(found)).astype(np.int64) for x in counts]
        word = found & np.uint64(3) == WORD
        ends = np.cumsum([len(x) for x in keys]).tolist()
        for i in range(0, len(keys), 256):
            spans = list(zip([0, *ends][i : i + 256], ends[i : i + 256]))
            none = pa.nulls(len(spans), pa.int64())
            sent = [pa.array([written(t[at[x:y]]) for x, y in spans], pa.binary()) for t in total]
            yield pa.RecordBatch.from_arrays([pa.array(block[i : i + 256], pa.int64()), pa.array(bucket[i : i + 256], pa.int32()), *sent, none, none, none], names=names)
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*nothing, *(pa.array([int(x)], pa.int64()) for x in (total[0][word].sum(), total[1][word].sum(), word.sum()))], names=names)

    return rows.mapInArrow(run, TOLD)


def score(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.1, mu: float = 50.0) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for every row; ``target_ids`` (doc_id) name the target documents."""
    spark = docs.sparkSession
    held = blocks(flagged(columns_as(docs, doc_id=id_col, text=text_col), target_ids))
    tokens = held.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // TASK_TOKENS))
    answers = saved(told(asked(held, tasks).repartition(tasks, "bucket")), "counts")
    n_target, n_background, size = (x or 0 for x in answers.agg(F.sum("n_target"), F.sum("n_background"), F.sum("n_words")).first())
    scale = [1.0, n_target / max(n_background, 1)]
    total = [n * k + alpha * size for n, k in zip((n_target, n_background), scale)]

    def losses(held: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("bucket")
        out: dict = {"doc_id": [], "n": [], "target": [], "background": []}
        for row in held.to_pylist():
            own = Block(*(row[c] for c in ("sizes", "target", "words", "at")))
            out["doc_id"] += row["ids"]
            out["n"].append(own.sizes)
            for i, c in enumerate(("target", "background")):
                counts = np.concatenate([np.zeros(0, np.int64), *map(numbers_of, answers[c].to_pylist())]) * scale[i]
                pair, word, context = (counts[p] for p in own.places)
                loss = np.log(context + mu) - np.log(pair + mu * (word + alpha) / total[i]) if len(pair) else pair
                out[c].append(np.bincount(own.owner, weights=loss, minlength=len(own.sizes)))
        types = pa.int64(), pa.int64(), pa.float64(), pa.float64()
        return pa.table({k: pa.array(v if k == "doc_id" else np.concatenate(v), t) for (k, v), t in zip(out.items(), types)})

    by_block = held.groupBy("block").cogroup(answers.where("block is not null").select("block", "bucket", "target", "background").groupBy("block"))
    found = by_block.applyInArrow(losses, "doc_id long, n long, target double, background double")
    mean = lambda c: F.when(F.col("n") > 0, F.col(c) / F.col("n"))
    return found.select("doc_id", F.col("n").alias("n_words"), mean("target").alias("target_loss"), mean("background").alias("background_loss"), (mean("target") - mean("background")).alias("score"))
