"""What one task holds, and orders that leave nothing open."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from helixframe.config import DEFAULTS
from helixframe.functions import intervals, stats
from helixframe.functions.tasks import tasks
from helixframe.operators import call, cluster, combine, genotype, grid
from helixframe.plans import pipelines


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out.split("Initial Plan")[0]


def test_tasks_grow_with_the_rows(spark):
    assert tasks(spark.range(1000), 100) == 10
    assert tasks(spark.range(0)) == 1


@pytest.mark.parametrize("of", [grid.coverage, grid.hap_reference])
def test_sweeps_deal_their_intervals_by_number(spark, monkeypatch, capsys, of):
    monkeypatch.setattr(intervals, "tasks", lambda df: 19)
    df = spark.createDataFrame([("a", 0, 500, 1), ("a", 200, 900, 2), ("b", 5, 300, 0)], "contig string, ref_start long, ref_end long, hap int")
    found = plan(of(df), capsys)
    assert ", 19), REPARTITION_BY_NUM" in found and "SortMergeJoin" not in found


def test_haplotypes_are_counted_side_by_side(spark):
    df = spark.createDataFrame([("a", 0, 500, 1), ("a", 200, 900, 2), ("a", 200, 420, None), ("a", 999_900, 1_000_150, 1)], "contig string, ref_start long, ref_end long, hap int")
    got = {(r["bin"], r["hap0"], r["hap1"], r["hap2"]) for r in grid.hap_reference(df).collect()}
    assert got == {(0, 0, 1, 0), (100, 0, 1, 0), (200, 1, 1, 1), (300, 1, 1, 1), (400, 0, 1, 1), (500, 0, 0, 1), (600, 0, 0, 1), (700, 0, 0, 1), (800, 0, 0, 1), (999_900, 0, 1, 0), (1_000_000, 0, 1, 0)}


def test_statistics_take_one_sort_a_value(spark, capsys):
    df = spark.createDataFrame([("a", "DEL", 0, 10, -60, 1, "+", 60)], "contig string, svtype string, cluster long, ref_start long, svlen long, read_id long, strand string, mapq int")
    found = plan(call.candidates(df, parts=7), capsys)
    assert found.count("- Sort [") + found.count("+ Sort [") == 2 and ", 7), REPARTITION_BY_NUM" in found
    found = plan(stats.trimmed_stdev(df, call.KEYS, "svlen"), capsys)
    assert found.count("- Sort [") == 1 and "REPARTITION_BY_NUM" in found


def test_the_greedy_merge_gets_starts_and_lengths_alone(spark, capsys):
    df = spark.createDataFrame([(i, "a", "DEL", 10 * i, -60, False, "x" * 50) for i in range(40)], "lead_id long, contig string, svtype string, ref_start long, svlen long, repeat boolean, payload string")
    found = cluster.greedy_clusters(df, ["lead_id"])
    sent = plan(found, capsys).split("MapInArrow")[1].split("Exchange")[0]
    assert "payload" not in sent and {len(r["payload"]) for r in found.collect()} == {50}


def test_fragments_at_one_place_do_not_depend_on_the_order_of_rows(spark):
    pieces = [("r", 100, 160, 0, 60, 60, s, False, "A") for s in "+-+-"] + [("r", 150, 210, 50, 110, 60, "+", False, "C")]
    found = set()
    for seed in range(6):
        rows = random.Random(seed).sample(pieces, len(pieces))
        df = spark.createDataFrame(rows, "read_qname string, ref_start long, ref_end long, qry_start long, qry_end long, svlen long, strand string, repeat boolean, seq string").withColumn("contig", F.lit("a")).coalesce(1)
        found.add(tuple(sorted((r["ref_start"], r["svlen"], r["n_fragments"]) for r in cluster.merged_fragments(df, ["contig"]).collect())))
    assert len(found) == 1


def test_the_second_likelihood_is_not_lost_beside_the_best(spark):
    df = spark.createDataFrame([(23, 46)], "k long, n long").selectExpr("*", "'DEL' as svtype", "100L as svlen")
    row = genotype.genotyped(df, F.col("k"), F.col("n")).first()
    assert (row["gt_a"], row["gt_b"], row["gq"]) == (0, 1, 60)


def test_islands_sort_once_and_take_repeated_positions(spark, capsys):
    at = [("a", x) for x in (10, 10, 90, 400, 999_950, 1_000_020, 1_000_020, 3_000_000, 3_000_090)] + [("b", 5)]
    df = spark.createDataFrame(at, "k string, x long")
    got = sorted({(r["k"], r["x"], r["island"]) for r in intervals.islands(df, ["k"], "x", 0, F.lit(100)).collect()})
    assert got == [("a", 10, 10), ("a", 90, 10), ("a", 400, 400), ("a", 999_950, 999_950), ("a", 1_000_020, 999_950), ("a", 3_000_000, 3_000_000), ("a", 3_000_090, 3_000_000), ("b", 5, 5)]
    assert plan(intervals.islands(df, ["k"], "x", 0, F.lit(100)), capsys).count("Exchange ") <= 4


def test_members_of_groups_are_dealt_once(spark, capsys):
    rows = [(f"c{i}", i % 3, f"g{i // 2}", "a", "DEL", 100 * i, 100 * i, -60, 5, 1, 1, True, 0, 1, True) for i in range(12)]
    members = spark.createDataFrame(rows, "call_id string, sample_id int, group_id string, contig string, svtype string, pos long, end long, svlen long, support long, fwd long, rev long, precise boolean, gt_a int, gt_b int, passed boolean")
    depth = spark.createDataFrame([(0, "a", 0, 9)], "sample_id int, contig string, cov_bin long, depth long")
    found = plan(combine.group_calls(members, depth, members.select("sample_id")), capsys)
    assert "Expand" not in found and "Window" not in found  # groups are stored; members are not counted again


def test_sequences_are_capped_where_their_bin_is(spark, capsys):
    rows = [(i, "a", "INS", 10 * i, 10 * i // 100 * 100, "ACGT") for i in range(60)]
    df = spark.createDataFrame(rows, "aln_idx long, contig string, svtype string, ref_start long, seed long, seq string")
    found = grid.cap_sequences(df.repartition(8, "contig", "svtype", "seed"), ["aln_idx"], replace(DEFAULTS, seqs_per_bin=4))
    assert plan(found, capsys).count("Exchange ") == 1 and found.where("seq is not null").count() == 24


def test_a_cigar_is_parsed_once(spark, monkeypatch):
    monkeypatch.setattr(pipelines, "stored", lambda df: df)
    row = [(0, "r", 0, "c", 5, 2_000, 60, "1000M50I945M", 1_995, 0, 1_995, None, 1, None, 3, None)]
    df = spark.createDataFrame(row, "aln_idx long, read_qname string, flag int, contig string, ref_start long, ref_end long, mapq int, cigar string, query_length int, qry_start int, qry_end int, sa string, hp int, ps string, nm int, seq string")
    found = pipelines.reads_of(df)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    assert [(r["cigar"], len(r["inline"])) for r in found.collect()] == [("1000M945M", 1)]


def leads_of_clusters(spark, n=80):
    rng = random.Random(7)
    rows = [(i, "a", rng.choice(["INS", "DEL", "DUP"]), 1_000 * rng.randint(0, 5), f"r{rng.randint(0, 9)}", rng.randint(0, 900), rng.randint(50, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "aln_idx long, contig string, svtype string, cluster long, read_qname string, ref_start long, svlen long")
    more = {"ref_end": F.col("ref_start"), "qry_start": F.col("ref_start"), "qry_end": F.col("ref_start"), "strand": F.lit("+"), "repeat": F.lit(False), "seq": F.lit(None).cast("string"), "mate_contig": F.lit(None).cast("string")}
    return df.withColumns(more | {"mate_ref_start": F.lit(None).cast("long"), "is_first": F.lit(None).cast("boolean"), "is_sa": F.col("aln_idx") % 2 == 0, "nm": F.lit(0.5), "source": F.lit("INLINE"), "read_len": F.lit(9_000), "hap": F.lit(1), "phase_set": F.lit("7"), "read_id": F.xxhash64("read_qname")})


def test_clusters_are_dealt_once_to_their_parts(spark, capsys):
    found = plan(pipelines.parts_of(leads_of_clusters(spark)), capsys)
    assert found.count("Exchange ") == 3 and "MapInPandas" not in found  # one for each kind of lead


@pytest.mark.parametrize("seed", range(4))
def test_lengths_split_in_windows_as_in_the_walk(spark, seed):
    rng = random.Random(seed)
    groups = [[rng.choice([40, 200, 1_000]) + rng.randint(0, rng.choice([60, 300])) * rng.choice([1, -1]) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(g, i, x) for g, xs in enumerate(groups) for i, x in enumerate(xs)], "cluster int, i int, svlen long")
    got = {(r["cluster"], r["i"]): r["length_key"] for r in cluster.split_by_length(df, ["cluster"]).collect()}
    assert got == {(g, i): k for g, xs in enumerate(groups) for i, k in enumerate(cluster.length_parts(xs))}


def test_votes_and_counts_are_dealt_once(spark, capsys):
    df = leads_of_clusters(spark).withColumn("sub", (F.col("aln_idx") % 2).cast("string"))
    assert plan(genotype.phase_votes(df, pipelines.PART, "aln_idx", parts=5), capsys).count("Exchange ") == 1
    counts = call.lead_counts(df, df.where("aln_idx < 9"), pipelines.PART, call.KEYS)
    assert "Expand" not in plan(counts, capsys)
    rows = df.select(*pipelines.PART, "read_qname", "aln_idx").collect()
    want = {}
    for part in {tuple(r[c] for c in pipelines.PART) for r in rows}:
        mine = [r for r in rows if tuple(r[c] for c in pipelines.PART) == part]
        long = [r for r in rows if r["aln_idx"] < 9 and tuple(r[c] for c in call.KEYS) == part[:3]]  # they belong to each part of their cluster
        want[part] = (len({r["read_qname"] for r in mine + long}), len({r["read_qname"] for r in long}), len(mine), sum(r["aln_idx"] % 2 == 0 for r in mine + long))
    assert want == {tuple(r[c] for c in pipelines.PART): (r["support_all"], r["support_long"], r["n_leads"], r["sa_count"]) for r in counts.collect()}


def test_bins_alone_meet_the_repeats(spark):
    rng = random.Random(3)
    rows = [(i, "a", "DEL", 10 + rng.choice([100, 250, 400, 5_000, 9_000]) * rng.randint(0, 12), -rng.randint(50, 400)) for i in range(150)]
    df = spark.createDataFrame(rows, "lead_id long, contig string, svtype string, ref_start long, svlen long")
    repeats = spark.createDataFrame([("a", 150, 900), ("a", 4_000, 9_500)], "contig string, start long, end long")
    seeds = df.withColumn("seed", grid.bin_of("ref_start"))
    hit = grid.in_repeats(seeds.select("contig", "seed").distinct(), repeats).withColumn("repeat", F.lit(True))
    marked = seeds.join(hit, ["contig", "seed"], "left").na.fill(False, ["repeat"]).drop("seed")
    kept = ["lead_id", "repeat", "cluster", "cluster_end"]
    want, got = ({tuple(r) for r in x.select(*kept).collect()} for x in (cluster.greedy_clusters(marked, ["lead_id"]), cluster.greedy_clusters(df, ["lead_id"], repeats=repeats)))
    assert got == want and {r[1] for r in got} == {True, False}
