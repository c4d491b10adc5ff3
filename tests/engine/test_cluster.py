import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.config import DEFAULTS, Params
from helixframe.operators import cluster


def stepped(rows, svtype, p):
    """The rule of the greedy merge as a plain loop over a list, with its own metrics."""
    bins = {}
    for r in rows:
        bins.setdefault(r[0] // 100 * 100, []).append(r)
    found = [{"start": b, "end": b + 100, "rows": v, "rep": any(r[2] for r in v)} for b, v in sorted(bins.items()) if len(v) >= p.min_leads]

    def metrics(c):
        v = c["rows"]
        n = min(len(v), 100)
        step = int(len(v) / n)
        taken = [v[i] for i in range(0, len(v), step)]
        mean = sum(r[0] for r in taken) / len(taken)
        sd = (sum((r[0] - mean) ** 2 for r in taken) / (len(taken) - 1)) ** 0.5 if len(taken) > 1 else 0
        return sum(r[1] for r in taken) / n, sd

    i = 0
    while i < len(found) - 1:
        a, b = found[i], found[i + 1]
        (ma, sa), (mb, sb) = metrics(a), metrics(b)
        inner, outer = b["start"] - a["end"], b["end"] - a["start"]
        if inner <= min(sa, sb) * 2.5 or ((a["rep"] or b["rep"]) and outer <= min(1000, (abs(ma) + abs(mb)) * 1.5)) or (svtype == "BND" and inner <= 1000):
            a["rows"], a["end"], a["rep"] = a["rows"] + b["rows"], b["end"], a["rep"] or b["rep"]
            found.pop(i + 1)
            i = max(0, i - 2)
        i += 1
    return [(c["start"], c["end"], len(c["rows"])) for c in found]


leads = st.lists(st.tuples(st.integers(0, 4000), st.integers(50, 600), st.booleans()), max_size=60)


@settings(max_examples=150, deadline=None)
@given(leads, st.sampled_from(["DEL", "BND"]))
def test_greedy_merge_is_the_plain_loop(rows, svtype):
    rows = [(*r, i) for i, r in enumerate(sorted(rows))]
    got = [(c.start, c.end, len(c.rows)) for c in cluster.merged_runs(rows, svtype, DEFAULTS)]
    assert got == stepped(rows, svtype, DEFAULTS)


def test_parts_do_not_change_the_clusters(spark):
    rng = random.Random(4)
    rows = []
    for contig in "ab":
        at = 0
        for _ in range(40):
            at += rng.choice([100, 300, 900, 2500, 9000])
            rows += [(contig, "DEL", at + rng.randint(0, 250), -rng.randint(50, 400), rng.random() < 0.1) for _ in range(rng.randint(2, 6))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "lead_id long, contig string, svtype string, ref_start long, svlen long, repeat boolean").repartition(7)
    split, whole = ({(r["lead_id"], r["cluster"], r["cluster_end"]) for r in cluster.greedy_clusters(df, ["lead_id"], split=s).collect()} for s in (True, False))
    assert split == whole
    assert cluster.reach(df).select("contig", "part").distinct().count() > 2


def test_first_run_of_a_contig_absorbs_one_neighbour():
    rows = [(b + o, 100, False, b + o) for b in (0, 100, 200, 300) for o in (5, 50)]
    first = [(c.start, c.end) for c in cluster.merged_runs(rows, "DEL", DEFAULTS, True)]
    later = [(c.start, c.end) for c in cluster.merged_runs(rows, "DEL", DEFAULTS, False)]
    assert first == [(0, 200), (200, 400)] and later == [(0, 400)]


def test_long_leads_ride_along(spark):
    df = spark.createDataFrame([(1, "a", "INS", 10, 100), (2, "a", "INS", 20, 110), (3, "a", "INS", 30, None), (4, "a", "INS", 900, None)], "lead_id long, contig string, svtype string, ref_start long, svlen long").selectExpr("*", "false as repeat")
    assert sorted(r["lead_id"] for r in cluster.greedy_clusters(df, ["lead_id"]).collect()) == [1, 2, 3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-3000, 3000), min_size=1, max_size=40))
def test_length_parts_are_a_partition_by_bins(lengths):
    keys = cluster.length_parts(lengths)
    by_bin = {}
    for x, k in zip(lengths, keys):
        assert by_bin.setdefault(abs(x) // 20, k) == k


@pytest.mark.parametrize(("lengths", "sizes"), [([100] * 3 + [110] * 2, [5]), ([100, 100, 400, 400], [2, 2]), ([100, 140, 500, 1000, 1100], [1, 2, 2])])
def test_length_parts(lengths, sizes):
    assert sorted(Counter(cluster.length_parts(lengths)).values()) == sizes


def test_split_by_length(spark):
    rows = [(i, "a", n) for i, n in enumerate([100, 110, 130, 400, 410, 900])]
    df = spark.createDataFrame(rows, "lead_id long, cluster string, svlen long")
    got = {r["lead_id"]: r["length_key"] for r in cluster.split_by_length(df, ["cluster"]).collect()}
    assert [got[i] for i in range(6)] == cluster.length_parts([r[2] for r in rows])


def test_breakend_leads_of_one_place_are_one_part(spark):
    df = spark.createDataFrame([("c", "chr2", 20000, True), ("c", "chr2", 20000, True)], "cluster string, mate_contig string, mate_ref_start long, is_first boolean")
    assert df.count() == 2 and cluster.bnd_parts(df, ["cluster"], Params()).select("part").distinct().count() == 1
