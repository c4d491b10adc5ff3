import random

import numpy as np
import pytest
import xxhash

from helixframe.llm import simhash
from helixframe.llm import components as components_module
from helixframe.llm.common import saved
from helixframe.llm.components import components
from helixframe.llm.queries import op4_simhash

from .helpers import SF, WORDS, empty, lower, odd_documents


def brute_fingerprint(text):
    words = WORDS.findall(lower(text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    """fps: (id, fingerprint); the smallest id reached from each row."""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, x) in enumerate(fps):
        for j in range(i):
            if (x ^ fps[j][1]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def test_table(spark):
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((d, f"{x:016x}", c) for (d, x), c in zip(rows, brute_components(rows)))
    assert sorted(map(tuple, op4_simhash(spark, SF).collect())) == want


def test_odd_rows(spark):
    docs = odd_documents(spark, ["one", "one two three four five", "one two three four five"])
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, x, c) for (d, x), c in zip(rows, brute_components(rows))), key=str)
    assert simhash.near_duplicates(empty(docs)).count() == 0


def groups(ids):
    return sorted(sorted(i for i in range(len(ids)) if ids[i] == k) for k in set(ids))


@pytest.mark.parametrize("every", [False, True])
@pytest.mark.parametrize(("distance", "segments", "lanes", "sparse", "close"), [(4, 2, 1, 256, 32), (4, 2, 1, 2, 0), (8, 3, 1, 256, 32), (23, 8, 2, 256, 0), (23, 8, 2, 3, 32)])
def test_links_at_every_distance(spark, monkeypatch, distance, segments, lanes, sparse, close, every):
    monkeypatch.setattr(simhash, "SPARSE", sparse)
    monkeypatch.setattr(simhash, "CLOSE", close)
    rng, bits, fps = random.Random(5), 64 * lanes, set()
    for _ in range(30):  # chains of steps, some of which link and some not
        x = rng.getrandbits(bits)
        for _ in range(12):
            fps.add(x)
            for b in rng.sample(range(bits), rng.randint(1, distance + 2)):
                x ^= 1 << b
    fps = sorted(fps)
    split = np.array([[x >> 64 * i & 2**64 - 1 for i in range(lanes)] for x in fps], np.uint64).view(np.int64)
    nodes = split[:, 0].tolist() if lanes == 1 else list(range(len(fps)))
    table = spark.createDataFrame([(n, *map(int, r)) for n, r in zip(nodes, split)], ", ".join(f"{n} long" for n in ("node", *simhash.lane_names(lanes))))
    pairs = simhash.links(table, distance, segments, lanes, every=every)
    close_by = {tuple(sorted((nodes[i], nodes[j]))) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= distance}
    if every:
        got = {tuple(sorted(r)) for r in pairs.collect()}
        assert got == close_by if close else got <= close_by
        return
    found = {r["node"]: r["root"] for r in components(pairs).collect()}
    assert groups([found.get(x, x) for x in nodes]) == groups(brute_components(list(enumerate(fps)), distance))


def test_nearest_and_hub():
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = [center ^ sum(1 << b for b in rng.sample(range(64), 10)) for _ in range(20)] + [center] + [rng.getrandbits(64) for _ in range(5)]
    home = np.arange(len(fps)) != 3
    edges = set(map(tuple, simhash.nearest_and_hub(np.array(fps, np.uint64)[:, None], home, 14).tolist()))
    apart = lambda i, j: (fps[i] ^ fps[j]).bit_count()
    assert {i for i, _ in edges} == {*range(21)} - {3} and all(apart(i, j) <= 14 and i != j for i, j in edges)
    assert all((i, 20) in edges for i in range(20) if i != 3)
    for i in {*range(21)} - {3}:
        assert min(apart(i, j) for k, j in edges if k == i) == min(apart(i, j) for j in range(len(fps)) if j != i)


def shingles(text):
    words = WORDS.findall(lower(text or ""))
    return frozenset(" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()


def brute_survivors(docs, similarity=0.8):
    """docs: (id, text); the (id, text) that stay, of the rows with an id: one of each group that pairs of the similarity join."""
    rows = sorted({(d, " ".join(WORDS.findall(lower(t or ""))), t) for d, t in docs if d is not None}, key=lambda r: (r[0], r[1]))
    sets, parent = [shingles(t) for _, t, _ in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            low, high = sorted((len(x), len(y)))
            if low >= similarity * high and (rows[i][1] == rows[j][1] or x and len(x & y) >= similarity * len(x | y)):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(least.values())


def test_survivors_are_those_of_the_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == brute_survivors(rows)


def test_survivors_of_near_copies(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(400)] for _ in range(12)]
    texts = []
    for words in base:
        copy = list(words)
        for i in rng.sample(range(400), 3):  # about 0.93 of the shingles stay
            copy[i] = "new"
        texts += [" ".join(words), " ".join(words), " ".join(copy)]
    docs = odd_documents(spark, texts)
    found = simhash.survivors(docs).collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [1, 4, 5, *range(10, 46, 3)]
    assert sum(r["doc_id"] is None for r in found) == 1 and simhash.survivors(docs).columns == docs.columns
    assert simhash.survivors(empty(docs)).count() == 0


def test_survivors_weigh_a_repeated_line_once(spark):
    line = " a line that many pages of the site all have too" * 30
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) + line for i in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert simhash.survivors(docs).count() == 6


def test_survivors_judge_rows_that_share_an_id_apart(spark):
    a, b, c = ("".join(f"{x}{i} " for i in range(80)) for x in "abc")
    docs = spark.createDataFrame([(7, a), (7, b), (3, b), (7, b), (5, c), (9, c), (9, a)], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.survivors(docs).collect())) == [(3, b), (5, c), (7, a)]


def test_survivors_of_a_family_beyond_all_pairs(spark, monkeypatch):
    """Copies of one text that resemble it, not each other: each is tested against the nearest, the text."""
    monkeypatch.setattr(simhash, "CLOSE", 1)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words)]
    for k in range(120):
        copy = list(words)
        for i in rng.sample(range(300), 5):
            copy[i] = f"new{k}x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in simhash.survivors(docs).collect()] == brute_survivors(list(enumerate(texts))) == [0]


def test_survivors_of_full_buckets_are_those_of_all_pairs(spark, monkeypatch):
    """Copies of copies: many resemble neither the hub nor the one whose fingerprint is nearest, but another. None that are alike differ in over 31 bits."""
    monkeypatch.setattr(simhash, "CLOSE", 0)
    rng = random.Random(7)
    versions = [[f"w{i}" for i in range(150)]]
    for k in range(200):
        copy = list(rng.choice(versions[-12:]))
        for i in rng.sample(range(150), rng.randint(3, 4)):
            copy[i] = f"new{k}x{i}"
        versions.append(copy)
    rows = list(enumerate(" ".join(x) for x in versions))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == brute_survivors(rows)


def near_and_strange(rng):
    """Fingerprints of 128 bits: two families of near copies, one of which has equal first halves, and strangers that share a segment with them."""
    fps = set()
    for low in (0, 64):
        center = rng.getrandbits(128)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(low, 128), rng.randint(1, 14))) for _ in range(25)}
        fps |= {rng.getrandbits(112) << 16 | center & 0xFFFF for _ in range(25)}
    fps = sorted(fps)
    meet = lambda x, y: any((x >> s & 0xFFFF ^ y >> s & 0xFFFF).bit_count() <= 2 for s in range(0, 128, 16))
    close = {(i, j) for j in range(len(fps)) for i in range(j) if (fps[i] ^ fps[j]).bit_count() <= 31 and meet(fps[i], fps[j])}
    return np.array([[x & 2**64 - 1, x >> 64] for x in fps], np.uint64), close


def test_the_second_search_gives_a_pair_once():
    fps, close = near_and_strange(random.Random(8))
    masks, keys = simhash.ball(16, 1).astype(np.int64), []
    for s in range(8):
        part = (fps[:, s // 4] >> np.uint64(s % 4 * 16) & np.uint64(0xFFFF)).astype(np.int64)
        keys.append((part[:, None] ^ masks | s << 16).ravel())
    at = np.tile(np.repeat(np.arange(len(fps)), len(masks)), 8)
    sketch = np.zeros((len(at), simhash.SKETCH // 64), np.uint64)
    got = simhash.crossing_links(np.concatenate(keys), fps[at], at, at, np.full(len(at), 9), sketch, 31, 8, 1, 0.8)
    got = [tuple(sorted(x)) for part in got for x in part.tolist()]
    assert len(close) > 300 and sorted(got) == sorted(close)


def test_only_entries_with_a_close_one_are_searched_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CLOSE", 0)
    fps, close = near_and_strange(random.Random(8))
    table = spark.createDataFrame([(n, *map(int, r)) for n, r in enumerate(fps.view(np.int64))], "node long, fp long, fp1 long")
    found = simhash.links_and_entries(table, 31, 8, 2, 1, every=True).collect()
    under = {}
    for r in found:
        if r["key"] is not None:
            under.setdefault(r["key"], []).append(r["u"])
    together = [(i, j) for nodes in under.values() for j in nodes for i in nodes if i < j]
    assert {tuple(sorted((r["u"], r["v"]))) for r in found if r["key"] is None} <= close <= set(together)
    assert {n for nodes in under.values() for n in nodes} == {n for pair in close for n in pair} != set(range(len(fps)))


def test_sketches_lose_no_pair_of_the_similarity():
    rng, pairs, alike, found = np.random.default_rng(6), [], [], 0
    for n in (1, 2, 9, 50, 400, 3000):
        for share in (0.5, 0.75, 0.85, 0.89, 0.95, 1):
            for _ in range(5):
                both, own, other = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64)) for k in (max(1, round(n * share)), round(n * (1 - share)), round(n * (1 - share))))
                pairs.append([np.concatenate([both, own]), np.concatenate([both, other])])
                alike.append(len(both) >= 0.8 * (len(both) + len(own) + len(other)))
    for (a, b), want in zip(pairs, alike):
        got = simhash.crossing_links(np.zeros(2, np.int64), np.zeros((2, 2), np.uint64), np.array([7, 8]), np.array([7, 8]), np.array([len(a), len(b)]), np.array([simhash.odd_sketch(a), simhash.odd_sketch(b)]).view(np.uint64), 31, 8, 1, 0.8)
        got = [sorted(x) for part in got for x in part.tolist()]
        assert got == [[7, 8]] if want else got in ([], [[7, 8]])
        found += len(got)
    assert sum(alike) <= found < len(pairs)


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 400)}


@pytest.mark.parametrize("numbering", ["up", "shuffled"])
def test_components_take_few_rounds(spark, monkeypatch, numbering):
    names = list(range(1000))
    if numbering == "shuffled":
        random.Random(4).shuffle(names)
    taken = []
    monkeypatch.setattr(components_module, "saved", lambda df, label: taken.append(label) or saved(df, label))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(list(zip(names, names[1:])), "u long, v long")).collect()}
    assert got == dict.fromkeys(range(1000), 0)
    assert taken.count("edges") <= 10 and (numbering != "up" or len(taken) <= 15)
