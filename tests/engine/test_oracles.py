"""Every query with SQL gives DuckDB's rows over the smallest tables; the others run."""

import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from helixframe.operators import combine, grid, scan
from helixframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    with duckdb.connect() as db:
        for t in TABLES:
            db.sql(f"create view {t} as from '{SF}/{t}.parquet'")
        yield db


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    return "nan" if isinstance(value, float) and math.isnan(value) else f"{value:.6g}" if isinstance(value, float) else str(value)


def rows_of(rows):
    return sorted(tuple(map(plain, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in catalog.ORACLE_SQL:
        want = db.sql(catalog.ORACLE_SQL[name])
        assert sorted(want.columns) == columns
        assert rows_of(rows) == rows_of(want.select(*(f'"{c}"' for c in columns)).fetchall())


def test_no_operator_needs_a_cartesian_product(spark, tmp_path):
    """Plans over stored tables, so that nothing of how the tables were made is in them."""

    def stored(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    alignments = stored("alignments", [(0, 0, 60, "c", 5, 2_000, 0, 2_000)], "aln_idx long, flag int, mapq int, contig string, ref_start long, ref_end long, qry_start int, qry_end int")
    spans = stored("spans", [("c", 0, 900)], "contig string, start long, end long")
    seeds = stored("seeds", [("c", 100)], "contig string, seed long")
    calls = stored("calls", [("a", "c", "DEL", 50, 90, -40, 5, "s", None, None)], "call_id string, contig string, svtype string, pos long, end long, svlen long, support long, sample_id string, mate_contig string, mate_pos long")
    population = stored("population", [("v", "c", "DEL", 60, -40, 0.5, 9)], "id string, contig string, svtype string, pos long, svlen long, af double, genotyped_n long")
    depth = stored("depth", [("s", "c", 0, 9)], "sample_id string, contig string, cov_bin long, depth long")
    members = calls.withColumn("group_id", F.col("call_id"))
    groups = members.groupBy("group_id", "contig").agg(F.avg("pos").alias("pos_mean"))
    plans = {
        "scan": scan.scan(alignments, spans),
        "repeats": grid.in_repeats(seeds, spans),
        "coverage": grid.with_coverage(calls, grid.coverage(alignments)),
        "nearest": combine.nearest(calls.withColumn("target_id", F.col("call_id")).drop("call_id"), calls),
        "population": combine.population_annotated(calls, population),
        "grouping": combine.combined(calls, 3),
        "absent": combine.absent_coverage(groups, members, calls.select("sample_id"), depth),
    }
    for name, df in plans.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Scan parquet" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(0, 0, 60, "c", 5, 2_000, 0, 2_000, "s")], "aln_idx long, flag int, mapq int, contig string, ref_start long, ref_end long, qry_start int, qry_end int, seq string").write.parquet(str(tmp_path / "a"))
    plan = scan.scan(spark.read.parquet(str(tmp_path / "a"))).groupBy("contig").count()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(m" in plan.split("PushedFilters: [")[1]  # plans cut long lists
    assert "seq" not in plan.split("ReadSchema: struct<")[1].split(">")[0]
