import random
import time
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from helixframe.config import Params
from helixframe.operators import combine, edits, grouping
from helixframe.plans import catalog

COLUMNS = "call_id long, sample_id int, contig string, svtype string, pos long, svlen long, support long, mate_contig string, mate_pos long"
Row = namedtuple("Row", [x.split()[0] for x in COLUMNS.split(", ")])


def table(rng, n, width, types=("DEL", "INS", "BND"), contigs="ab"):
    """Dense and sparse stretches, equal positions, supports and lengths."""
    rows = []
    for i in range(n):
        kind = rng.choice(types)
        at = rng.choice([rng.randrange(width), rng.randrange(width) // 50_000 * 50_000 + rng.randrange(3_000)])
        mate = (rng.choice(["m1", "m2"]), rng.randrange(6_000)) if kind == "BND" else (None, None)
        rows.append(Row(i, rng.randrange(6), rng.choice(contigs), kind, at, rng.choice([0, 60, 300, 320, 1_500]) * (-1 if kind == "DEL" else 1), rng.randrange(3, 9), *mate))
    return rows


def whole(rows, n, p, one):
    """Every contig and type by the plain loop."""
    out = {}
    for key in {(r.contig, r.svtype) for r in rows}:
        own = sorted((r for r in rows if (r.contig, r.svtype) == key), key=lambda r: (r.pos, r.call_id))
        out |= {r.call_id: f"{key[0]}:{key[1]}:{g}" for r, g in zip(own, grouping.grouped_rows(own, n, p, one))}
    return out


@pytest.mark.parametrize("n, width, samples, one", [(500, 400_000, 4, False), (500, 30_000, 4, True), (700, 4_000_000, 80, False)])
def test_parts_give_what_whole_contigs_give(spark, n, width, samples, one):
    rows = table(random.Random(n + width), n, width)
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    for p in (Params(), Params(block_size=5_000, combine_overlap=200)):
        got = {r["call_id"]: r["group_id"] for r in combine.combined(df, samples, p, one).collect()}
        assert got == whole(rows, samples, p, one) and len(set(got.values())) < n
    assert grouping.parts(df).select("contig", "svtype", "part").distinct().count() > 6


def test_buffers_end_with_blocks(spark):
    """Buffers by a fold in a block equal those of a loop over its bins."""
    rng = random.Random(9)
    rows = table(rng, 900, 300_000, ("DEL",), "a")
    want = {}
    for block in range(3):
        counts = {}
        for r in rows:
            if r.pos // 100_000 == block:
                counts[r.pos // 100 * 100] = counts.get(r.pos // 100 * 100, 0) + 1
        held, bins = 0, []
        for i, b in enumerate(sorted(counts)):
            held, bins = held + counts[b], [*bins, b]
            if held >= 25 or i + 1 == len(counts):
                want |= {x: (b, len(bins)) for x in bins}
                held, bins = 0, []
    got = {r["bin"]: (r["last_bin"], r["filled"]) for r in grouping.buffers(spark.createDataFrame(rows, COLUMNS), 4).collect()}
    assert got == want


def test_no_group_holds_a_contig(spark):
    """A task is dealt parts, not contigs."""
    rows = [Row(i, i % 3, "a", "DEL", 5_000 * i, -100, 5, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    plan = combine.combined(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(contig" in plan and "part" in plan.split("MapInPandas")[1].split("hashpartitioning(contig")[1].split(")")[0]
    assert "FlatMapGroupsInPandas" not in plan
    assert grouping.parts(df).select("part").distinct().count() == 400


def test_empty(spark):
    assert combine.combined(spark.createDataFrame([], COLUMNS), 3).count() == 0


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out) + 1)
        if (kind := rng.randrange(3)) == 0:
            out.insert(i, rng.choice("ACGT"))
        elif out and kind == 1:
            del out[min(i, len(out) - 1)]
        elif out:
            out[min(i, len(out) - 1)] = rng.choice("ACGT")
    return "".join(out)


def test_distance_within(monkeypatch):
    rng = random.Random(4)
    for counted, waves in ((200, 200), (12, 3), (1, 0)):
        monkeypatch.setattr(edits, "COUNTED", counted)
        monkeypatch.setattr(edits, "WAVES", waves)
        for _ in range(250):
            a = "".join(rng.choice("ACG") for _ in range(rng.randint(0, 60)))
            b = rng.choice([edited(rng, a, rng.randint(0, 12)), "".join(rng.choice("ACG") for _ in range(rng.randint(0, 60)))])
            d = plain(a, b)
            assert edits.at_least(a, b) <= d
            for limit in (-1, 0, d - 1, d, d + 1, 70):
                assert edits.distance_within(a, b, limit) == (d if d <= limit else None)


def test_long_alleles_are_fast():
    rng = random.Random(6)
    a = "".join(rng.choice("ACGT") for _ in range(50_000))
    other = "".join(rng.choice("ACGT") for _ in range(50_000))
    began = time.perf_counter()
    near = edits.distance_within(a, edited(rng, a, 60), 15_000)
    assert near is not None and near <= 60
    assert edits.distance_within(a, other, 15_000) is None
    assert time.perf_counter() - began < 2
    noisy = edited(rng, a[:20_000], 2_500)
    found = edits.distance_within(a[:20_000], noisy, 6_000)
    assert 1_500 < found <= 2_500 and edits.distance_within(a[:20_000], noisy, found - 1) is None


def test_columns(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        a = "".join(rng.choice("AC") for _ in range(rng.randint(0, 30)))
        rows.append((a, edited(rng, a, rng.randint(0, 9)), rng.randint(0, 12)))
    df = spark.createDataFrame([*rows, (None, "A", 3), ("A", "A", None)], "a string, b string, n int")
    for r in df.select("*", edits.within(F.col("a"), F.col("b"), F.col("n")).alias("d"), combine.alike(F.col("a"), F.col("b"), 0.7).alias("same")).collect():
        if r["a"] is None or r["n"] is None:
            assert r["d"] is None
            continue
        d, mean = plain(r["a"], r["b"]), (len(r["a"]) + len(r["b"])) / 2
        assert r["d"] == (d if d <= r["n"] else None) and r["same"] == (mean > 0 and (mean - d) / mean > 0.7)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")


def test_candidates_are_made_once(spark):
    """What groups them reads them stored; made anew in each step, they would read the table each time."""
    assert scans(catalog.combine_groups(spark, "/root/testdata/sf0.001")) == 0


def test_samples_are_listed_once(spark):
    """Only the depths are read from the table when calls are grouped; counting samples reads what is stored."""
    assert scans(catalog.entry_combine(spark, "/root/testdata/sf0.001")) <= 1
