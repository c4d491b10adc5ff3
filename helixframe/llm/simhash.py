"""SimHash near-duplicates by multi-index hashing.

Fingerprints: a 64-bit hash of every word shingle, repeats included or of the distinct ones; a bit is
set where more than half of the hashes have it. The first lane of 64 bits is over XXH64 (seed 42),
further lanes are over mixtures of it, for wider fingerprints.

Links: the bits are divided into segments. Two fingerprints at ``distance`` or fewer bits have a
segment at distance // segments or fewer. Each fingerprint is entered in the table under every key of
a small ball around each segment; two balls share a key exactly when the segments differ by no more
than the two radii together. All entries of a key are fetched and their complete distances verified.
Two segments of 32 bits and balls of radius 1 (33 keys) lose no link of 4 bits of 64; eight segments
of 16 bits and balls of radius 1 (17 keys) none of 23 bits of 128.

``near_duplicates`` collapses equal fingerprints first, so exact copies cost one row. A bucket emits a
spanning forest of its verified links, at most one edge less than it has entries, so a large group of
near copies gives as many edges as it has entries. Components come from ``components``.

``survivors`` decides by the similarity itself: the share of distinct shingles that two texts have in
common. Equal texts are collapsed first. Candidates are pairs of texts within ``distance`` bits, a
wider radius than the similarity's own; each is confirmed by the two sets of shingles, and only
confirmed pairs join. A bucket gives all its close pairs if it has at most CLOSE of them for each
entry. In a fuller one each text whose own segment is the key is first paired with its nearest and with
the hub, which is closest to all others; that joins most of a large family. Then the full buckets are
searched again for all other close pairs. Of the keys that a pair shares, which may be all, one is its
own; an entry is searched again only under a key that is its own with some close one, at most once under
each of its keys. Pairs within a group are joined already, and of those between groups the ones go whose
sets have to differ too much by their odd sketches. The sketch has the parity of the number of shingles in
each of SKETCH bins, so two sets differ in as many shingles at least as their sketches do in bits; no pair
of the similarity is lost by it. What stays is confirmed as well.
So the groups are those that all close pairs of the table join.

Defined cases: a text that is null, empty or blank has fingerprint zero, which links like any other
in ``near_duplicates``; for ``survivors`` such texts equal each other and resemble nothing else. Null
ids carry a fingerprint and a component but never name one, if their component has another id; their
rows are left alone by ``survivors``. Repeated rows repeat in ``near_duplicates``; ``survivors`` decides
by row, so rows that share an id but not the text are judged apart, and of equal ones one stays. An
empty table gives no rows; other columns are ignored by ``near_duplicates`` and kept by ``survivors``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, as_bytes, column, columns_as, forget, give_back, map_batches, saved, spread_join
from .components import components

SEED = 42
#: Shingles of a long text are hashed and counted in runs of this many.
RUN = 1 << 16
#: Table rows that one task of the search is planned for, of up to 33 bytes each.
TASK_ROWS = 1_000_000
#: Buckets of more entries are searched one by one.
SPARSE = 256
#: Close pairs, for each entry, that a bucket gives; one with more gives the nearest and the hub of each entry.
CLOSE = 4
#: Distances held at once in the search of one bucket.
TILE = 1 << 18
#: Pairs whose sketches are held at once.
PART = 1 << 16
#: Bits of the sketch of a set of shingles.
SKETCH = 512
SKETCH_NAMES = [f"s{i}" for i in range(SKETCH // 64)]
#: A table of ids is broadcast up to this many rows.
BROADCAST_ROWS = 1_000_000


def mixed(x: np.ndarray, lane: int) -> np.ndarray:
    """The hashes of a further lane."""
    x = (x + np.uint64(lane)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of all shingles of ``width`` lower-cased (A-Z) words between ASCII white space, in order; fewer words are one shingle."""
    import xxhash

    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_digest
    parts = []
    for i in range(0, len(starts), RUN):
        spans = zip(starts[i : i + RUN].tolist(), ends[i : i + RUN].tolist())
        parts.append(np.frombuffer(b"".join([digest(flat[a:b], SEED) for a, b in spans]), ">u8").astype(np.uint64))
    return np.concatenate(parts)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """The lanes of the SimHash of hashes of shingles; all zero without any."""
    total = np.zeros((lanes, 64), np.int64)
    for i in range(0, len(hashes), RUN):
        part = hashes[i : i + RUN]
        for lane in range(lanes):
            own = (mixed(part, lane) if lane else part).astype(">u8")
            total[lane] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * x > len(hashes)).tobytes(), "big") for x in total]


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{i}" for i in range(1, lanes))]


def fingerprints(docs: DataFrame, width: int = 4, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fp1, ...): the lanes of the fingerprint as signed longs."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            fps = np.array([fingerprint(gram_hashes(x, width), lanes) for x in as_bytes(column(batch, "text"))], np.uint64).reshape(-1, lanes)
            yield {"doc_id": column(batch, "doc_id")} | {name: fps[:, i].copy().view(np.int64) for i, name in enumerate(lane_names(lanes))}

        return step

    return map_batches(columns_as(docs, doc_id=id_col, text=text_col), make, "doc_id long, " + ", ".join(f"{x} long" for x in lane_names(lanes)))


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of the numbers of hashes in SKETCH bins, as words of 64 bits."""
    odd = np.bincount((grams & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def words_of(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([column(batch, x).to_numpy().view(np.uint64) for x in names], axis=1)


def lanes_of(batch: pa.RecordBatch, lanes: int) -> np.ndarray:
    return words_of(batch, lane_names(lanes))


def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.uint64)


def segment(fps: np.ndarray, s: int, segments: int) -> np.ndarray:
    """The values of one segment."""
    each = segments // fps.shape[1]
    bits = 64 // each
    return fps[:, s // each] >> np.uint64(s % each * bits) & np.uint64((1 << bits) - 1)


def table_entries(fps: DataFrame, radius: int, segments: int = 2, lanes: int = 1) -> DataFrame:
    """(key, home, node, fp, ...): every fingerprint under every key of the balls around its segments; home marks the segment itself."""
    bits = 64 * lanes // segments
    names = [*lane_names(lanes)[lanes == 1 :], "node"]  # of one lane the node is the fingerprint

    def make():
        masks = ball(bits, radius)

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            fps = lanes_of(batch, lanes)
            own = {name: column(batch, name).to_numpy() for name in names}
            for s in range(segments):
                keys = ((segment(fps, s, segments)[:, None] ^ masks) | np.uint64(s << bits)).ravel().view(np.int64)
                yield {"key": keys, "home": np.tile(masks == 0, len(fps))} | {name: np.repeat(x, len(masks)) for name, x in own.items()}

        return step

    return map_batches(fps, make, "key long, home boolean, " + ", ".join(f"{x} long" for x in names))


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.bitwise_count(a[..., 0] ^ b[..., 0]).astype(np.int16)
    for i in range(1, a.shape[-1]):
        total += np.bitwise_count(a[..., i] ^ b[..., i])
    return total


def forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs that a spanning forest needs; earlier ones are preferred."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        if (ra := find(a)) != (rb := find(b)):
            parent[ra] = rb
            kept.append(i)
    return pairs[kept]


def close_pairs(fps: np.ndarray, distance: int, most: int) -> np.ndarray | None:
    """All (i, j), i < j, within ``distance``; None if there are more than ``most``."""
    out, n, step = [np.zeros((0, 2), np.int64)], 0, max(1, TILE // len(fps))
    for i in range(0, len(fps), step):
        a, b = np.nonzero(apart(fps[i : i + step, None], fps[None, i:]) <= distance)
        later = b > a
        out.append(np.stack([a[later] + i, b[later] + i], axis=1))
        n += int(later.sum())
        if n > most:
            return None
    return np.concatenate(out)


def nearest_and_hub(fps: np.ndarray, home: np.ndarray, distance: int) -> np.ndarray:
    """(i, j): every entry of ``home`` that has close ones with the nearest of them and with the hub: that which is closest to all, by the sum of what distances stay below ``distance``."""
    n, step = len(fps), max(1, TILE // len(fps))
    weight = np.concatenate([np.maximum(distance + 1 - apart(fps[i : i + step, None], fps[None]), 0).sum(axis=1) for i in range(0, n, step)])
    own, out = np.flatnonzero(home), [np.zeros((0, 2), np.int64)]
    for i in range(0, len(own), step):
        at = own[i : i + step]
        d = apart(fps[at, None], fps[None])
        d[np.arange(len(at)), at] = distance + 1
        close = d <= distance
        some = close.any(axis=1)
        for j in (d.argmin(axis=1), np.where(close, weight, -1).argmax(axis=1)):
            out.append(np.stack([at[some], j[some]], axis=1))
    return np.concatenate(out)


def middle(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """One value that is in the balls around both x and y, the same for (y, x): half of the bits that differ are flipped, the lowest, and of the two values that this gives it is the smaller."""
    left = x ^ y
    half, flip = np.bitwise_count(left) >> 1, np.zeros_like(left)
    for i in range(radius):
        lowest = left & (~left + np.uint64(1))
        flip |= np.where(half > i, lowest, np.uint64(0))
        left ^= lowest
    return np.minimum(x ^ flip, y ^ flip)


def middles(key: int, fps: np.ndarray, segments: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(kind, own) of a bucket: own[kind[i], kind[j]] where the key is the ``middle`` of the segments of the entries i and j."""
    bits = 64 * fps.shape[1] // segments
    values, kind = np.unique(segment(fps, key >> bits, segments), return_inverse=True)
    return kind, middle(values[:, None], values[None], radius) == np.uint64(key & (1 << bits) - 1)


def first_here(key: int, fps: np.ndarray, i: np.ndarray, j: np.ndarray, segments: int, radius: int) -> np.ndarray:
    """Of the pairs (i, j) of the bucket those that no segment before that of the key gives a key."""
    at = np.arange(len(i))
    for s in range(key >> 64 * fps.shape[1] // segments):
        part = segment(fps, s, segments)
        at = at[np.bitwise_count(part[i[at]] ^ part[j[at]]) > 2 * radius]
    return at


def meeting(key: int, fps: np.ndarray, distance: int, segments: int, radius: int) -> np.ndarray:
    """The entries of a bucket that are within ``distance`` of another whose key with them is this one: of all keys that a pair shares the ``middle`` in the first segment that gives them any."""
    kind, own = middles(key, fps, segments, radius)
    found, step = np.zeros(len(fps), bool), max(1, TILE // len(fps))
    for i in range(0, len(fps), step):
        x, y = np.nonzero((apart(fps[i : i + step, None], fps[None, i:]) <= distance) & own[kind[i : i + step]][:, kind[i:]])
        later = y > x
        x, y = x[later] + i, y[later] + i
        at = first_here(key, fps, x, y, segments, radius)
        found[x[at]] = found[y[at]] = True
    return np.flatnonzero(found)


def bucket_links(keys: np.ndarray, fps: np.ndarray, node: np.ndarray, home: np.ndarray, distance: int, segments: int, radius: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) nodes: links among the entries of equal keys, bucket by bucket, and (key, node) of the entries of full buckets that have to be searched again. A spanning forest of the links; with ``every``, all, but of a full bucket some for the entries whose own segment is the key (``home``): ``crossing_links`` has its others."""
    order = np.lexsort((*fps.T[::-1], keys))
    keys, fps, node, home = keys[order], fps[order], node[order], home[order]
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([start, [len(keys)]]))
    close = np.concatenate([apart(fps[:-1], fps[1:]) <= distance, [False]])
    dense = (size > SPARSE) | (size > 16) & (2 * np.add.reduceat(close, start) > size) if len(start) else np.zeros(0, bool)
    out, again = [], [np.zeros((0, 2), np.int64)]

    # Small buckets: every entry with the one that stands d behind it, for all buckets at once
    end, sparse = np.repeat(start + size, size), ~np.repeat(dense, size)
    live, d, found = np.flatnonzero(sparse), 1, []
    while len(live := live[live + d < end[live]]):
        near = live[apart(fps[live], fps[live + d]) <= distance]
        found.append(np.stack([near, near + d], axis=1))
        d += 1
    if found:
        at = np.concatenate(found)
        of = np.repeat(np.arange(len(start)), size)[at[:, 0]]
        found = np.bincount(of, minlength=len(start))
        whole = found <= CLOSE * size if every else size == 2
        out.append(node[at[whole[of]]])
        if every:
            dense |= ~whole
        else:
            out.append(node[forest(at[~whole[of]])])

    # Large ones, or such as hold many close entries
    for a, n in zip(start[dense].tolist(), size[dense].tolist()):
        if every:
            own = fps[a : a + n]
            pairs = close_pairs(own, distance, CLOSE * n)
            if pairs is None:
                pairs = nearest_and_hub(own, home[a : a + n], distance)
                met = node[a : a + n][meeting(int(keys[a]), own, distance, segments, radius)]
                again.append(np.stack([np.full(len(met), keys[a]), met], axis=1))
            out.append(node[a + pairs])
            continue
        left, queue = np.arange(a + 1, a + n), [a]
        while len(left):  # a search that takes each entry once
            if not queue:
                queue, left = [int(left[0])], left[1:]
                continue
            here = queue.pop()
            near = apart(fps[left], fps[here]) <= distance
            if near.any():
                out.append(np.stack([np.full(near.sum(), node[here]), node[left[near]]], axis=1))
                queue += left[near].tolist()
                left = left[~near]
    return np.concatenate([np.zeros((0, 2), np.int64), *out]), np.concatenate(again)


def crossing_links(keys: np.ndarray, fps: np.ndarray, node: np.ndarray, root: np.ndarray, size: np.ndarray, sketch: np.ndarray, distance: int, segments: int, radius: int, similarity: float) -> Iterator[np.ndarray]:
    """(n, 2) nodes, part by part: all links among the entries of equal keys whose roots differ and whose sets of ``size`` may have ``similarity`` by their sketches. A pair comes from the key that ``meeting`` takes."""
    order = np.argsort(keys, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(keys)]):
        at = order[a:b]
        _, of, count = np.unique(root[at], return_inverse=True, return_counts=True)
        most = count.argmax()
        others = np.flatnonzero(of != most)  # of two groups one at least is not the largest
        own, key, step = fps[at], int(keys[at[0]]), max(1, TILE // len(at))
        kind, here = middles(key, own, segments, radius)
        for i in range(0, len(others), step):
            rows = others[i : i + step]
            x, y = np.nonzero((apart(own[rows, None], own[None]) <= distance) & here[kind[rows]][:, kind])
            x = rows[x]
            once = (of[x] != of[y]) & ((of[y] == most) | (x < y))
            x, y = x[once], y[once]
            for j in range(0, len(x), PART):
                first = first_here(key, own, x[j : j + PART], y[j : j + PART], segments, radius)
                u, v = at[x[j + first]], at[y[j + first]]
                differ = apart(sketch[u], sketch[v])
                alike = (1 + similarity) * differ <= (1 - similarity) * (size[u] + size[v]) + 1e-6
                if alike.any():
                    yield np.stack([node[u[alike]], node[v[alike]]], axis=1)


def _rows(pairs: np.ndarray, names: list[str], missing: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(pairs), 100_000):
        part = pairs[i : i + 100_000]
        yield pa.RecordBatch.from_arrays([*(pa.array(part[:, c].copy()) for c in range(part.shape[1])), *(pa.nulls(len(part), pa.int64()) for _ in missing)], names=[*names, *missing])


def links(fps: DataFrame, distance: int = 4, segments: int = 2, lanes: int = 1, radius: int | None = None, every: bool = False) -> DataFrame:
    """(u, v): links among the rows of ``fps`` (node, fp, ...), which is saved; of one lane node is fp.

    Enough to join every component, or with ``every`` the candidates that ``survivors`` takes first. The
    default ``radius`` of the balls loses no link; a smaller one only links whose segments all differ
    by more than twice of it.
    """
    radius = math.ceil((distance // segments) / 2) if radius is None else radius
    return links_and_entries(fps, distance, segments, lanes, radius, every).where("key is null").select("u", "v")


def links_and_entries(fps: DataFrame, distance: int, segments: int, lanes: int, radius: int, every: bool) -> DataFrame:
    """(u, v, key): the (u, v) of ``links``, without a key, and (node, node, key) for each entry of a full bucket that has to be searched again."""
    bits = 64 * lanes // segments
    rows = fps.count() * segments * len(ball(bits, radius))
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))

    def search(batches):
        give_back()
        held = [(column(b, "key").to_numpy(), column(b, "node").to_numpy(), column(b, "home").to_numpy(zero_copy_only=False), column(b, "node").to_numpy().view(np.uint64)[:, None] if lanes == 1 else lanes_of(b, lanes)) for b in batches]
        if held:
            keys, node, home, fp = (np.concatenate(x) for x in zip(*held))
            held.clear()
            edges, again = bucket_links(keys, fp, node, home, distance, segments, radius, every)
            yield from _rows(edges, ["u", "v"], ("key",))
            yield from _rows(again[:, [1, 1, 0]], ["u", "v", "key"])

    return table_entries(fps, radius, segments, lanes).repartition(tasks, "key").mapInArrow(search, "u long, v long, key long")


def links_between(fps: DataFrame, entries: DataFrame, distance: int, segments: int, lanes: int, radius: int, similarity: float) -> DataFrame:
    """(u, v), saved: all pairs of ``entries`` (key, node) with different roots that may have ``similarity``, each once. ``fps`` has (node, fp, ..., root, size, s0, ...)."""
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // (TASK_ROWS // 4)))

    def search(batches):
        give_back()
        held = [(*(column(b, x).to_numpy() for x in ("key", "node", "root", "size")), lanes_of(b, lanes), words_of(b, SKETCH_NAMES)) for b in batches]
        if held:
            keys, node, root, size, fp, sketch = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for pairs in crossing_links(keys, fp, node, root, size, sketch, distance, segments, radius, similarity):
                yield from _rows(pairs, ["u", "v"])

    return saved(entries.join(fps, "node").repartition(tasks, "key").mapInArrow(search, "u long, v long"), "between")


def near_duplicates(docs: DataFrame, distance: int = 4, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id is the smallest id that links of 64-bit fingerprints reach."""
    rows = saved(fingerprints(docs, width, id_col=id_col, text_col=text_col), "fingerprints")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct.select("fp", F.col("fp").alias("node")), distance))
    nodes = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(nodes.select("fp", "root"), smallest, ["root"]).select("fp", "component_id")
    return spread_join(rows, named, ["fp"]).select("doc_id", "fp", "component_id")


def text_rows(docs: DataFrame, width: int, lanes: int) -> DataFrame:
    """(doc_id, raw, h1, h2, fp, ..., size, s0, ...) of ``docs`` (doc_id, raw, text): h1 and h2 are a hash of the lower-cased words, fp of the distinct shingles, size their number, s0 and on their sketch."""
    names = [*lane_names(lanes), "size", *SKETCH_NAMES]

    def make():
        import xxhash

        def step(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = as_bytes(column(batch, "text"))
            words = np.array([np.frombuffer(xxhash.xxh3_128_digest(b" ".join(x.translate(LOWER).split())), np.int64) for x in texts]).reshape(-1, 2)
            of = np.zeros((len(texts), len(names)), np.int64)
            for row, text in zip(of, texts):
                grams = np.unique(gram_hashes(text, width))
                row[:lanes] = np.array(fingerprint(grams, lanes), np.uint64).view(np.int64)
                row[lanes] = len(grams)
                row[lanes + 1 :] = odd_sketch(grams)
            yield {"doc_id": column(batch, "doc_id"), "raw": column(batch, "raw"), "h1": words[:, 0].copy(), "h2": words[:, 1].copy()} | {x: of[:, i].copy() for i, x in enumerate(names)}

        return step

    return map_batches(docs.select("doc_id", "raw", "text"), make, ", ".join(f"{x} long" for x in ("doc_id", "raw", "h1", "h2", *names)))


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The (u, v) of ``pairs`` whose texts (node, text) have at least ``similarity`` of their distinct shingles in common."""

    def grams(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {"node": column(batch, "node"), "grams": [np.unique(gram_hashes(x, width)).tobytes() for x in as_bytes(column(batch, "text"))]}

    # Repeated rows of an id give equal sets, of which one stays
    sets = saved(map_batches(texts, lambda: grams, "node long, grams binary").groupBy("node").agg(F.max("grams").alias("grams")), "grams")
    first = pairs.join(sets.withColumnsRenamed({"node": "u", "grams": "a"}), "u")
    both = first.join(sets.withColumnsRenamed({"node": "v", "grams": "b"}), "v").select("u", "v", "a", "b")

    def step(batch: pa.RecordBatch) -> Iterator[dict]:
        keep = []
        for a, b in zip(column(batch, "a").to_pylist(), column(batch, "b").to_pylist()):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            low, high = sorted((len(a), len(b)))
            shared = len(np.intersect1d(a, b, assume_unique=True)) if low >= similarity * high else 0
            keep.append(shared > 0 and shared >= similarity * (low + high - shared))
        at = pa.array(np.flatnonzero(keep))
        yield {"u": column(batch, "u").take(at), "v": column(batch, "v").take(at)}

    return map_batches(both, lambda: step, "u long, v long")


def survivors(docs: DataFrame, similarity: float = 0.8, width: int = 5, distance: int = 31, segments: int = 8, lanes: int = 2, radius: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each group of texts that pairs of ``similarity`` join: that of the smallest id. Rows with null ids stay.

    The defaults: two texts that share 0.8 of their distinct shingles differ in 19 bits of 128, give or
    take 4, so 998 of 1000 such pairs are within 31. Up to 23 bits no pair is missed by the
    table; of those at 0.8 that differ by more, one in 700 has no segment within two bits. Every pair
    within ``distance`` that the table has is decided.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    own, text = (f"c{names.index(x)}" for x in (id_col, text_col))
    known = plain.where(F.col(own).isNotNull()).withColumn("raw", F.xxhash64(text))
    keyed = known.select(F.col(own).cast("long").alias("doc_id"), "raw", F.col(text).alias("text"))

    rows = saved(text_rows(keyed, width, lanes), "rows")
    derived = [*lane_names(lanes), "size", *SKETCH_NAMES]
    distinct = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "raw")).alias("first"), *(F.max(x).alias(x) for x in derived))  # equal words have equal ones
    distinct = saved(distinct.select(F.monotonically_increasing_id().alias("node"), "first.doc_id", "first.raw", *derived), "distinct")

    def decided(pairs: DataFrame) -> DataFrame:
        nodes = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        chosen = distinct.join(nodes, "node").select("node", "doc_id", "raw")
        return confirmed(pairs, keyed.join(_small(chosen), ["doc_id", "raw"]).select("node", "text"), width, similarity)

    found = saved(links_and_entries(distinct.select("node", *lane_names(lanes)), distance, segments, lanes, radius, every=True), "found")
    pairs = saved(found.where("key is null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    edges = saved(decided(pairs), "edges")
    groups = components(edges)
    again = found.where("key is not null").select("key", F.col("u").alias("node"))
    if not again.isEmpty():
        rooted = saved(distinct.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *derived), "rooted")
        between = links_between(rooted, again, distance, segments, lanes, radius, similarity)
        forget(rooted)
        if not between.isEmpty():
            groups = components(edges.union(decided(between)))
    forget(found)
    roots = distinct.join(groups, "node", "left").select("doc_id", "raw", F.coalesce("root", "node").alias("root"))
    kept = roots.groupBy("root").agg(F.min(F.struct("doc_id", "raw")).alias("first")).select(F.col("first.doc_id").alias("kept_id"), F.col("first.raw").alias("kept_raw"))

    is_kept = (F.col(own).cast("long") == F.col("kept_id")) & (F.col("raw") == F.col("kept_raw"))
    left = known.join(_small(kept), is_kept, "left_semi")
    repeated = saved(rows.groupBy("doc_id", "raw").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("kept_id"), F.col("raw").alias("kept_raw")), "repeated")
    if not repeated.isEmpty():
        cols = plain.columns
        once = left.join(_small(repeated), is_kept, "left_semi").groupBy(own, "raw").agg(F.min(F.struct(*cols)).alias("row")).select("row.*")
        left = left.join(_small(repeated), is_kept, "left_anti").select(*cols).unionByName(once)
    return left.select(*plain.columns).unionByName(plain.where(F.col(own).isNull())).toDF(*names)


def _small(ids: DataFrame) -> DataFrame:
    """Marked for broadcast where it has no more than BROADCAST_ROWS rows; joined by a shuffle else."""
    ids = saved(ids, "ids")
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
