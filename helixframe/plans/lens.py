"""Deterministic projections of the test tables into leads, alignments, calls and the like.

Each is one SQL text, the same for Spark and for DuckDB; {lineitem} and so on stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("lineitem", "orders", "part", "events", "documents", "benchmark", "supplier", "nation", "customer")

SVTYPE = "case l_linenumber % 5 when 0 then 'INS' when 1 then 'DEL' when 2 then 'DUP' when 3 then 'INV' else 'BND' end"
SVLEN = "(case when l_linenumber % 5 = 1 then -1 else 1 end) * cast(l_quantity as bigint) * 20"
#: Distinct for every row of lineitem.
LEAD_ID = "((l_orderkey * 8 + l_linenumber) * 10000019 + cast(round(l_extendedprice * 100) as bigint)) * 59 + cast(l_quantity as bigint)"

LEADS = f"""
    select {LEAD_ID} as lead_id, l_returnflag as contig, {SVTYPE} as svtype, l_partkey * 2000 + l_orderkey % 140 as ref_start,
        {SVLEN} as svlen, l_orderkey as read_id, case when l_linestatus = 'O' then '+' else '-' end as strand,
        cast(round(l_discount * 100) as bigint) * 6 as mapq, l_suppkey % 3 as hap, l_suppkey % 4 as sample_id,
        l_suppkey % 7 as phase_set, l_suppkey % 2 = 0 as is_sa, cast(l_quantity as bigint) as quantity, l_partkey as part_id
    from {{lineitem}}"""

ALIGNMENTS = f"""
    select {LEAD_ID} as aln_idx, 'r' || cast(l_orderkey as string) as read_qname, l_returnflag as contig, l_partkey * 2000 + l_orderkey % 140 as ref_start,
        l_partkey * 2000 + l_orderkey % 140 + cast(l_quantity as bigint) * 40 as ref_end, cast(round(l_discount * 100) as bigint) * 6 as mapq,
        case l_linenumber % 4 when 0 then 2048 when 1 then 16 when 2 then 256 else 0 end as flag, l_suppkey % 3 as hap,
        cast(0 as bigint) as qry_start, cast(l_quantity as bigint) * 40 as qry_end, cast(l_quantity as bigint) * 40 + 1200 as query_length, l_suppkey % 50 as nm,
        cast(cast(l_quantity as bigint) * 10 as string) || 'M' || cast(30 + l_partkey % 60 as string) || 'I' || cast(cast(l_quantity as bigint) * 5 as string) || 'M'
            || cast(30 + l_orderkey % 70 as string) || 'D' || cast(cast(l_quantity as bigint) * 5 as string) || 'M' || cast(1200 + l_orderkey % 100 as string) || 'S' as cigar,
        case when l_linenumber % 3 = 0 then l_returnflag || ',' || cast(l_suppkey * 50 + 1 as string) || (case when l_linestatus = 'O' then ',+,' else ',-,' end)
            || cast(l_linenumber * 100 as string) || 'S' || cast(l_partkey % 300 + 50 as string) || 'M20D30I,' || cast(l_suppkey % 60 as string) || ',3;' end as sa
    from {{lineitem}}"""

CALLS = f"""
    select {LEAD_ID} as call_id, l_returnflag as contig,
        case when l_suppkey % 37 = 0 then 'SINGLE_LEFT' else {SVTYPE} end as svtype, l_partkey * 2000 + l_orderkey % 140 as pos,
        ({SVLEN}) * (case when l_partkey % 5 = 0 then 100 else 1 end) as svlen,
        l_partkey * 2000 + l_orderkey % 140 + (case when l_linenumber % 5 = 0 then 0 else cast(l_quantity as bigint) * 20 * (case when l_partkey % 5 = 0 then 100 else 1 end) end) as stop,
        l_suppkey % 20 + 1 as support, l_partkey % 700 / 1.0 as stdev_pos, case when l_linenumber % 5 <> 4 then l_orderkey % 900 / 1.0 end as stdev_len,
        l_suppkey % 3 as fwd, l_partkey % 4 as rev, l_orderkey % 11 as cov_upstream, l_partkey % 13 as cov_start, l_suppkey % 17 as cov_center,
        l_orderkey % 19 as cov_end, l_partkey % 11 as cov_downstream, 10 as cov_global, l_suppkey % 9 as sa_count, l_suppkey % 10 / 10.0 as sa_share,
        l_partkey % 3 as support_sa, l_orderkey % 40 / 100.0 as coverage_var, l_discount * 5 as vaf, l_partkey % 60 as qual,
        l_orderkey % 2 = 0 as precise, l_suppkey % 4 as sample_id, l_suppkey % 5 as edge_reads, l_discount as nm, 0.02 as regional_nm,
        cast(case l_linenumber % 3 when 0 then 0 when 1 then 1 end as int) as gt_a, cast(case l_linenumber % 3 when 0 then l_linenumber % 2 when 1 then 1 end as int) as gt_b
    from {{lineitem}}"""

REPEATS = """
    select r.contig, p_partkey * 2000 + 50 as start, p_partkey * 2000 + 50 + p_size * 10 as stop
    from {part} cross join (select 'A' as contig union all select 'N' union all select 'R') r"""

CONTIGS = "select contig, length, contig_idx from (values ('A', 500000000, 0), ('N', 500000000, 1), ('R', 500000000, 2), ('X', 1000, 3)) as t(contig, length, contig_idx)"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The lens over Parquet tables."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    found = spark.sql(sql, **used)
    return found.withColumnRenamed("stop", "end") if "stop" in found.columns else found


def text(sql: str) -> str:
    """The lens for DuckDB, over its views."""
    return sql.format(**{t: t for t in TABLES})
