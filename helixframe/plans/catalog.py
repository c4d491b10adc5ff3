"""The registered queries of the engine and their SQL: operators over the lenses of the whole test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS as P
from ..functions import stats
from ..functions.storage import stored
from ..functions.tasks import tasks
from ..operators import call, cluster, combine, consensus, extract, genotype, grid, qc, scan, text
from ..sources import readers
from ..streaming import windowed
from . import pipelines
from .lens import ALIGNMENTS, CALLS, CONTIGS, LEADS, REPEATS, view
from .lens import text as lens_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = ["contig", "svtype"]
WITH_LEADS = f"with leads as ({lens_text(LEADS)})"
WITH_ALIGNMENTS = f"with alignments as ({lens_text(ALIGNMENTS)})"
WITH_CALLS = f"with calls as ({lens_text(CALLS)})"
CLUSTERS = """,
    bins as (select contig, svtype, cast(floor(ref_start / 100) * 100 as bigint) as seed from leads group by all having count(*) >= 2),
    marked as (select *, case when seed - lag(seed) over (partition by contig, svtype order by seed) <= 100 then 0 else 1 end as start from bins),
    numbered as (select *, sum(start) over (partition by contig, svtype order by seed rows unbounded preceding) as n from marked),
    named as (select contig, svtype, seed, min(seed) over (partition by contig, svtype, n) as cluster from numbered),
    clustered as (select l.*, cluster from leads l join named b on l.contig = b.contig and l.svtype = b.svtype and cast(floor(l.ref_start / 100) * 100 as bigint) = b.seed)"""
STEPS = """,
    events as (select contig, pos, sum(d) as d from (select contig, ref_start as pos, 1 as d from alignments union all select contig, ref_end, -1 from alignments) group by all having sum(d) <> 0),
    summed as (select contig, pos as start, lead(pos) over w as stop, cast(sum(d) over w as bigint) as depth from events window w as (partition by contig order by pos)),
    steps as (select * from summed where depth > 0)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def leads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, LEADS)


def alignments(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, ALIGNMENTS)


def calls(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, CALLS)


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return cluster.island_clusters(leads(spark, d))


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- scans and grids ---------------------------------------------------------------------------


@query("scan_filter", f"{WITH_ALIGNMENTS} select aln_idx, contig, ref_start, ref_end, mapq from alignments where mapq >= 20 and (flag & 256) = 0 and qry_end - qry_start >= 1000 and contig in (select contig from ({CONTIGS}) where length >= 1000000)")
def scan_filter(spark, d):
    kept = scan.contigs_to_process(spark.sql(CONTIGS))
    return scan.scan(alignments(spark, d)).join(F.broadcast(kept.select("contig")), "contig", "left_semi").select("aln_idx", "contig", "ref_start", "ref_end", "mapq")


@query("region_scan", f"{WITH_ALIGNMENTS}, regions as ({lens_text(REPEATS)}) select aln_idx, contig, ref_start from alignments a where mapq >= 20 and (flag & 256) = 0 and qry_end - qry_start >= 1000 and exists (select 1 from regions r where r.contig = a.contig and a.ref_start >= r.start and a.ref_start < r.stop)")
def region_scan(spark, d):
    return scan.scan(alignments(spark, d), view(spark, d, REPEATS)).select("aln_idx", "contig", "ref_start")


@query("contig_catalog", f"{WITH_ALIGNMENTS} select contig, count(*) as mapped, max(ref_end) as length from alignments group by contig")
def contig_catalog(spark, d):
    return scan.contig_catalog(alignments(spark, d))


@query("lead_bins", f"{WITH_LEADS} select contig, svtype, cast(floor(ref_start / 100) * 100 as bigint) as bin, count(*) as n, count(*) filter (hap not in (1, 2)) as hap0, count(*) filter (hap = 1) as hap1, count(*) filter (hap = 2) as hap2 from leads group by all")
def lead_bins(spark, d):
    return grid.lead_bins(leads(spark, d))


@query("hap_ref_hist", f"{WITH_ALIGNMENTS}, each as (select contig, hap, unnest(range(ref_start // 100 * 100, ref_end // 100 * 100, 100)) as bin from alignments) select contig, bin, count(*) filter (hap not in (1, 2)) as hap0, count(*) filter (hap = 1) as hap1, count(*) filter (hap = 2) as hap2 from each group by all")
def hap_ref_hist(spark, d):
    return grid.hap_reference(alignments(spark, d))


@query("coverage_rle", f'{WITH_ALIGNMENTS}{STEPS} select contig, start, stop as "end", depth from steps')
def coverage_rle(spark, d):
    return grid.coverage(alignments(spark, d))


@query("coverage_masked", f'{WITH_ALIGNMENTS}{STEPS}, masks as (select distinct contig, start + 1000 as ms, stop + 1000 as me from ({lens_text(REPEATS)})), points as (select s.contig, s.start, s.stop, s.depth, m.ms, m.me, lag(m.me) over w as before, row_number() over w as k, count(*) over (partition by s.contig, s.start) as n from steps s join masks m on m.contig = s.contig and ms < s.stop and me > s.start window w as (partition by s.contig, s.start order by ms)) select contig, start, stop as "end", depth from steps s where not exists (select 1 from masks m where m.contig = s.contig and ms < s.stop and me > s.start) union all select contig, coalesce(before, start), ms, depth from points where coalesce(before, start) < ms union all select contig, me, stop, depth from points where k = n and me < stop')
def coverage_masked(spark, d):
    masks = view(spark, d, REPEATS).select("contig", (F.col("start") + 1000).alias("start"), (F.col("end") + 1000).alias("end")).distinct()
    return grid.masked(grid.coverage(alignments(spark, d)), masks)


@query("coverage_500bp", f"{WITH_ALIGNMENTS}{STEPS}, each as (select contig, start, stop, depth, unnest(range(start // 500, (stop - 1) // 500 + 1)) as b from steps) select contig, b * 500 as cov_bin, cast(round_even(sum(depth * (least(stop, (b + 1) * 500) - greatest(start, b * 500))) / 500, 0) as bigint) as depth from each group by contig, b")
def coverage_500bp(spark, d):
    return grid.coverage_bins(grid.coverage(alignments(spark, d)))


@query("contig_mean_cov", f"{WITH_ALIGNMENTS}{STEPS} select c.contig, round(coalesce(sum(depth * (stop - start)), 0) / max(length), 6) as mean_coverage from ({CONTIGS}) c left join steps s on s.contig = c.contig group by c.contig")
def contig_mean_cov(spark, d):
    return rounded(grid.contig_mean_coverage(grid.coverage(alignments(spark, d)), spark.sql(CONTIGS)), "mean_coverage")


_AT = ("upstream", "start", "center", "end", "downstream")


@query(
    "coverage_points",
    f"with alignments as ({lens_text(ALIGNMENTS)}), calls as ({lens_text(CALLS)}){STEPS}, "
    "ends as (select call_id, contig, svtype, pos, case when svtype = 'BND' then pos else stop end as stop from calls), "
    "points as (select call_id, contig, 'upstream' as spot, pos - 500 as x from ends union all select call_id, contig, 'start', case when svtype in ('INS', 'BND') then pos - 100 else pos end from ends "
    "union all select call_id, contig, 'center', case when svtype in ('INS', 'BND') then pos else (pos + stop) // 2 end from ends "
    "union all select call_id, contig, 'end', case when svtype in ('INS', 'BND') then stop + 100 else stop - 100 end from ends union all select call_id, contig, 'downstream', stop + 500 from ends), "
    "found as (select p.call_id, spot, case when s.stop > p.x then s.depth else 0 end as depth from points p asof left join steps s on p.contig = s.contig and p.x >= s.start) "
    "select call_id, " + ", ".join(f"cast(max(coalesce(depth, 0)) filter (spot = '{n}') as bigint) as cov_{n}" for n in _AT) + " from found group by call_id",
)
def coverage_points(spark, d):
    x = calls(spark, d).select("call_id", "contig", "svtype", "pos", "end")
    return grid.with_coverage(x, grid.coverage(alignments(spark, d))).select("call_id", *(f"cov_{n}" for n in _AT))


@query("repeat_semi", f"{WITH_LEADS}, seeds as (select distinct contig, svtype, cast(floor(ref_start / 100) * 100 as bigint) as seed from leads), repeats as ({lens_text(REPEATS)}) select * from seeds s where exists (select 1 from repeats r where r.contig = s.contig and s.seed > r.start and s.seed < r.stop)")
def repeat_semi(spark, d):
    seeds = leads(spark, d).select("contig", "svtype", grid.bin_of("ref_start").alias("seed")).distinct()
    return grid.in_repeats(seeds, view(spark, d, REPEATS))


@query("sequence_cap", f"{WITH_LEADS} select lead_id, case when row_number() over (partition by contig, svtype, ref_start // 100 order by lead_id) <= 10 then repeat('A', quantity) end as seq from leads")
def sequence_cap(spark, d):
    return grid.cap_sequences(leads(spark, d).withColumn("seq", F.expr("repeat('A', cast(quantity as int))")), ["lead_id"]).select("lead_id", "seq")


# --- extraction ----------------------------------------------------------------------------------

OPS = "ops as (select *, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 1)) as n, unnest(regexp_extract_all(cigar, '([0-9]+)([MIDNSHP=X])', 2)) as op, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) as k from alignments), walked as (select *, cast(n as bigint) as len, coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then cast(n as bigint) else 0 end) over w, 0) as pos_read, ref_start + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then cast(n as bigint) else 0 end) over w, 0) as pos_ref from ops window w as (partition by aln_idx order by k rows between unbounded preceding and 1 preceding))"


@query("cigar_walk", f"{WITH_ALIGNMENTS}, {OPS} select aln_idx, op, len, cast(pos_read as bigint) as pos_read, cast(pos_ref as bigint) as pos_ref from walked where op in ('I', 'D', 'S') and len >= 45")
def cigar_walk(spark, d):
    return extract.cigar_events(alignments(spark, d), P.screen).select("aln_idx", "op", "len", "pos_read", "pos_ref")


@query("inline_leads", f"{WITH_ALIGNMENTS}, {OPS}, kept as (select *, op = 'S' and len >= 1250 and (flag & 2304) = 0 and sa is null as far from walked where op in ('I', 'D', 'S') and len >= 45) select aln_idx, contig, cast(pos_ref + case when op = 'D' then len else 0 end as bigint) as lead_start, cast(pos_ref as bigint) as lead_end, case when op = 'I' or far then 'INS' when op = 'D' then 'DEL' when pos_ref = ref_start then 'SINGLE_LEFT' else 'SINGLE_RIGHT' end as svtype, case when op = 'I' then len when op = 'D' then -len when not far then 0 end as svlen from kept")
def inline_leads(spark, d):
    return extract.inline_leads(alignments(spark, d).withColumn("seq", F.lit(None).cast("string"))).select("aln_idx", "contig", "lead_start", "lead_end", "svtype", "svlen")


@query("mismatch_rate", f"{WITH_ALIGNMENTS}, {OPS}, sums as (select aln_idx, sum(case when op in ('I', 'D') and len > 10 then len else 0 end) as gaps from walked group by aln_idx) select a.aln_idx, round(coalesce((nm - gaps) / (qry_end - qry_start + 1), -1), 6) as nm_rate from alignments a join sums s on a.aln_idx = s.aln_idx")
def mismatch_rate(spark, d):
    return rounded(scan.mismatch_rate(alignments(spark, d)).select("aln_idx", "nm_rate"), "nm_rate")


@query("sa_explode", f"{WITH_ALIGNMENTS} select aln_idx, split_part(sa, ',', 1) as contig, cast(split_part(sa, ',', 2) as bigint) - 1 as pos, split_part(sa, ',', 3) as strand, cast(regexp_extract(split_part(sa, ',', 4), '^([0-9]+)S', 1) as bigint) as clip_start, cast(0 as bigint) as clip_end, cast(regexp_extract(sa, 'S([0-9]+)M', 1) as bigint) + 20 as ref_span, cast(regexp_extract(sa, 'S([0-9]+)M', 1) as bigint) + 30 as read_span from alignments where sa is not null")
def sa_explode(spark, d):
    return longs(extract.sa_entries(alignments(spark, d)).select("aln_idx", "contig", "pos", "strand", "clip_start", "clip_end", "ref_span", "read_span"), "clip_end")


@query(
    "split_leads",
    WITH_ALIGNMENTS + """,
    reads as (select *, (flag & 16) <> 0 as back, cast(split_part(sa, ',', 2) as bigint) - 1 as s_pos, split_part(sa, ',', 3) as s_strand, cast(regexp_extract(sa, ',([0-9]+)S', 1) as bigint) as clip, cast(regexp_extract(sa, 'S([0-9]+)M', 1) as bigint) as m, cast(split_part(sa, ',', 5) as bigint) as s_mapq from alignments where (flag & 2048) = 0 and sa is not null),
    parts as (
        select aln_idx, -1 as k, contig, ref_start as rs, ref_end as re, case when back then query_length - qry_end else qry_start end as qs, case when back then query_length - qry_start else qry_end end as qe, case when back then '-' else '+' end as st, mapq from reads
        union all select aln_idx, 0, split_part(sa, ',', 1), s_pos, s_pos + m + 20, case when s_strand = '-' then 0 else clip end, case when s_strand = '-' then 0 else clip end + m + 30, s_strand, s_mapq from reads),
    pairs as (select *, lag(contig) over w as a_contig, lag(rs) over w as ars, lag(re) over w as are, lag(qe) over w as aqe, lag(st) over w as ast, lag(mapq) over w as amapq from parts window w as (partition by aln_idx order by qs, k)),
    gaps as (select *, st = ast as same, qs - aqe as dq, case when st = '+' then rs - are else ars - re end as dr, case when st = '+' then rs else ars end as near, case when st = '+' then abs(rs - ars) else abs(re - are) end as span, case when st = '+' then least(rs, ars) else least(re, are) end as flip from pairs),
    events as (
        select *, case when a_contig is null then case when qs >= 1250 then 'INS' end when contig <> a_contig then null when same and dq >= 45 and dq - dr >= 45 then 'INS' when same and dr >= 45 and dr - dq >= 45 then 'DEL' when same and dr <= 0 and -dr >= 45 then 'DUP' when not same and span >= 45 then 'INV' end as svtype from gaps),
    placed as (select *, case when a_contig is null then rs when svtype = 'INV' then flip else near end as start, case when a_contig is null then null when svtype = 'INS' then dq when svtype in ('DEL', 'DUP') then -dr else span end as size from events where svtype is not null)
    select aln_idx, contig, svtype, start as lead_start, case when svtype = 'INS' then start else start + size end as lead_end, size as svlen, st as strand, mapq, case when k < 0 then 'SPLIT_PRIM' else 'SPLIT_SUP' end as source, qs as lead_qry_start, qe as lead_qry_end
    from placed where least(mapq, coalesce(amapq, mapq)) >= 20""",
)
def split_leads(spark, d):
    return extract.split_leads(alignments(spark, d))


@query("breakends", f"{WITH_ALIGNMENTS}, parts as (select *, cast(split_part(sa, ',', 2) as bigint) - 1 as m_pos, split_part(sa, ',', 3) as m_strand, cast(regexp_extract(sa, 'S([0-9]+)M', 1) as bigint) + 20 as m_span from alignments where sa is not null) select aln_idx, contig, ref_end as ref_start, split_part(sa, ',', 1) as mate_contig, m_pos + 1 as mate_ref_start, true as is_first, false as is_reverse from parts where m_strand <> case when (flag & 16) <> 0 then '-' else '+' end")
def breakends(spark, d):
    return extract.breakends(alignments(spark, d))


@query("owned_leads", f"{WITH_LEADS}, regions as ({lens_text(REPEATS)}) select lead_id from leads l where exists (select 1 from regions r where r.contig = l.contig and l.ref_start >= r.start and l.ref_start < r.stop)")
def owned_leads(spark, d):
    return extract.owned(leads(spark, d), view(spark, d, REPEATS)).select("lead_id")


# --- clusters ------------------------------------------------------------------------------------


@query("cluster_islands", f"{WITH_LEADS}{CLUSTERS} select lead_id, contig, svtype, cluster from clustered")
def cluster_islands(spark, d):
    return clustered(spark, d).select("lead_id", "contig", "svtype", "cluster")


@query("cluster_greedy", f"{WITH_LEADS}{CLUSTERS} select lead_id, contig, svtype, cluster from clustered")
def cluster_greedy(spark, d):
    return cluster.greedy_clusters(leads(spark, d).withColumn("repeat", F.lit(False)), ["lead_id"]).select("lead_id", "contig", "svtype", "cluster")


def _run_sql(r: str, name: str) -> str:
    """Mean length and deviation of starts of a run, over every step-th lead."""
    n = f"least(len({r}.rows), 100)"
    taken = f"list_filter({r}.rows, lambda q, i: (i - 1) % (len({r}.rows) // {n}) = 0)"
    return f"list_sum(list_transform({taken}, lambda q: q.size)) / {n} as {name}_mean, coalesce(list_aggregate(list_transform({taken}, lambda q: cast(q.s as double)), 'stddev_samp'), 0) as {name}_dev"


@query(
    "cluster_greedy_events",
    f"""with recursive leads as (select event_id, event_type as contig, cast(floor(epoch(ts)) as bigint) as s, cast(trunc(value) as bigint) as size, user_id % 5 = 0 as rep from events),
    bins as (select contig, s // 100 * 100 as bin, list({{'s': s, 'size': size, 'id': event_id}} order by s, event_id) as rows, bool_or(rep) as rep from leads group by all having count(*) >= 2),
    walk as (
        select contig, list({{'a': bin, 'z': bin + 100, 'rows': rows, 'rep': rep}} order by bin) as runs, 0 as i from bins group by contig
        union all
        select contig, case when near then list_concat(list_concat(runs[1:i], [{{'a': x.a, 'z': y.z, 'rows': list_concat(x.rows, y.rows), 'rep': x.rep or y.rep}}]), runs[i + 3:]) else runs end, case when near then greatest(i - 1, 1) else i + 1 end
        from (
            select *, y.a - x.z <= least(x_dev, y_dev) * 2.5 or ((x.rep or y.rep) and y.z - x.a <= least(1000, (abs(x_mean) + abs(y_mean)) * 1.5)) as near
            from (select *, {_run_sql("x", "x")}, {_run_sql("y", "y")} from (select *, runs[i + 1] as x, runs[i + 2] as y from walk where i + 1 < len(runs))))),
    ended as (select contig, unnest(runs) as r from walk where i + 1 >= len(runs))
    select unnest(r.rows).id as event_id, contig, r.a as cluster, r.z as cluster_end from ended""",
)
def cluster_greedy_events(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.col("event_type").alias("contig"), F.lit("INS").alias("svtype"), F.unix_timestamp("ts").alias("ref_start"), F.col("value").cast("long").alias("svlen"), (F.col("user_id") % 5 == 0).alias("repeat"))
    return cluster.greedy_clusters(x, ["event_id"]).select("event_id", "contig", "cluster", "cluster_end")


@query("cluster_metrics", f"{WITH_LEADS}{CLUSTERS}, r as (select *, row_number() over (partition by contig, svtype, cluster order by lead_id) - 1 as k, count(*) over (partition by contig, svtype, cluster) as n from clustered) select contig, svtype, cluster, max(n) as n, round(sum(svlen) / least(max(n), 100), 6) as mean_svlen, round(coalesce(stddev_samp(ref_start), 0), 6) as stdev_start from r where k % (n // least(n, 100)) = 0 group by contig, svtype, cluster")
def cluster_metrics(spark, d):
    return rounded(cluster.cluster_metrics(clustered(spark, d), call.KEYS, ["lead_id"]), "mean_svlen", "stdev_start")


@query("fragment_merge", f"{WITH_LEADS}, pieces as (select *, ref_start + abs(svlen) as ref_end, quantity as qry_start, quantity + abs(svlen) as qry_end, part_id % 10 = 0 as in_repeat from leads), m as (select *, lag(ref_start) over w as p_rs, lag(ref_end) over w as p_re, lag(qry_start) over w as p_qs, lag(qry_end) over w as p_qe, lag(strand) over w as p_s from pieces window w as (partition by contig, svtype, sample_id, hap order by ref_start, qry_start, qry_end, svlen)), f as (select *, case when p_rs is not null and (in_repeat or ((abs(ref_start - p_re) < 150 or abs(ref_start - p_rs) < 150) and (abs(qry_start - p_qe) < 150 or abs(qry_start - p_qs) < 150) and strand = p_s)) then 0 else 1 end as new from m), i as (select *, sum(new) over (partition by contig, svtype, sample_id, hap order by ref_start, qry_start, qry_end, svlen rows unbounded preceding) as k from f) select contig, svtype, sample_id, hap as read_qname, min(ref_start) as ref_start, cast(sum(svlen) as bigint) as svlen, count(*) as n_fragments from i group by contig, svtype, sample_id, hap, k")
def fragment_merge(spark, d):
    size = F.abs("svlen")
    x = leads(spark, d).withColumns({"ref_end": F.col("ref_start") + size, "qry_start": F.col("quantity"), "qry_end": F.col("quantity") + size, "repeat": F.col("part_id") % 10 == 0, "read_qname": F.col("hap"), "seq": F.lit(None).cast("string")})
    return cluster.merged_fragments(x, [*KEYS, "sample_id"]).drop("seq")


@query("bnd_resplit", f"{WITH_LEADS}, mates as (select *, case when hap = 0 then 'A' else 'B' end as mate_contig, part_id % 97 * 700 as mate_ref_start, is_sa as is_first from leads where svtype = 'BND'), b as (select *, mate_ref_start // 1000 * 1000 as m from mates), s as (select *, case when m - lag(m) over (partition by contig, sample_id, mate_contig, is_first order by m, lead_id) <= 1000 then null else m end as start from b) select lead_id, mate_contig, is_first, max(start) over (partition by contig, sample_id, mate_contig, is_first order by m, lead_id rows unbounded preceding) as part from s")
def bnd_resplit(spark, d):
    x = leads(spark, d).where("svtype = 'BND'").withColumns({"mate_contig": F.when(F.col("hap") == 0, "A").otherwise("B"), "mate_ref_start": F.col("part_id") % 97 * 700, "is_first": F.col("is_sa")})
    return cluster.bnd_parts(x, ["contig", "sample_id"]).select("lead_id", "mate_contig", "is_first", F.col("part").cast("long").alias("part"))


@query(
    "length_resplit",
    WITH_LEADS.replace("with ", "with recursive ", 1) + CLUSTERS + """,
    sized as (select *, abs(svlen) // 20 * 20 as bin from clustered),
    begun as (select contig, svtype, cluster, list_sort(list(distinct bin)) as ks from sized group by all),
    walk as (
        select contig, svtype, cluster, ks, ks as bins, ks as own, 1 as i from begun
        union all
        select contig, svtype, cluster, case when near then list_filter(ks, lambda x: x <> a) else ks end, bins, case when near then list_transform(own, lambda x: case when x = a then b else x end) else own end, case when near then greatest(0, i - 2) else i + 1 end
        from (select *, abs(b - a) <= greatest(50, least(a, b) * 0.22) as near from (select *, ks[case when i = 0 then len(ks) else i end] as a, ks[i + 1] as b from walk where len(ks) > 1 and i < len(ks)))),
    ended as (select contig, svtype, cluster, unnest(bins) as bin, unnest(own) as length_key from walk where len(ks) <= 1 or i >= len(ks))
    select lead_id, contig, svtype, cluster, length_key from sized join ended using (contig, svtype, cluster, bin)""",
)
def length_resplit(spark, d):
    return cluster.split_by_length(clustered(spark, d), call.KEYS).select("lead_id", "contig", "svtype", "cluster", "length_key")


@query("sa_share", f"{WITH_LEADS}{CLUSTERS} select contig, svtype, cluster, count(*) filter (is_sa) as sa_count, round(avg(cast(is_sa as int)), 6) as sa_share from clustered group by contig, svtype, cluster")
def sa_share(spark, d):
    return rounded(cluster.sa_share(clustered(spark, d), call.KEYS), "sa_share")


@query("single_breaks", f"{WITH_LEADS} select contig, svtype, part_id, case when count(*) >= 3 and abs(cast(trunc(quantile_cont(ref_start, 0.5)) as bigint) - cast(trunc(avg(ref_start)) as bigint)) < 50 then cast(trunc(quantile_cont(ref_start, 0.5)) as bigint) end as break_pos from leads group by contig, svtype, part_id")
def single_breaks(spark, d):
    return cluster.single_breaks(leads(spark, d), ["contig", "svtype", "part_id"])


# --- statistics and candidates -------------------------------------------------------------------

CENTER = """(with c as (select {keys}, {v}, count(*) as n from {t} group by all), m as (select *, max(n) over (partition by {keys}) as top from c), k as (select *, row_number() over (partition by {keys} order by {v}) as r, count(*) over (partition by {keys}) as k from m where n > top - 3) select {keys}, {v} as center from k where r = k // 2 + 1)"""
TRIMMED = """(with r as (select {keys}, {v}, row_number() over (partition by {keys} order by {v}) as r, count(*) over (partition by {keys}) as n from {t}) select {keys}, coalesce(stddev_samp({v}), 0) as stdev from r where r > floor(n / 100.0 * 25) and r <= n - floor(n / 100.0 * 25) group by {keys})"""


@query("center_len", f"{WITH_LEADS} select * from {CENTER.format(keys='contig, svtype, part_id', v='svlen', t='leads')}")
def center_len(spark, d):
    return stats.center(leads(spark, d), [*KEYS, "part_id"], "svlen")


@query("trimmed_stdev", f"{WITH_LEADS} select contig, svtype, part_id, round(stdev, 6) as stdev from {TRIMMED.format(keys='contig, svtype, part_id', v='svlen', t='leads')}")
def trimmed_stdev(spark, d):
    return rounded(stats.trimmed_stdev(leads(spark, d), [*KEYS, "part_id"], "svlen"), "stdev")


@query("most_common_strand", f"{WITH_LEADS}, c as (select contig, svtype, part_id, strand, count(*) as n from leads group by all) select contig, svtype, part_id, strand as most_common, n as count from c qualify row_number() over (partition by contig, svtype, part_id order by n desc, strand desc) = 1")
def most_common_strand(spark, d):
    return stats.most_common(leads(spark, d), [*KEYS, "part_id"], "strand")


@query("most_common_smallest", f"{WITH_LEADS}, c as (select contig, svtype, part_id, mapq, count(*) as n from leads group by all) select contig, svtype, part_id, mapq as most_common, n as count from c qualify row_number() over (partition by contig, svtype, part_id order by n desc, mapq) = 1")
def most_common_smallest(spark, d):
    return stats.most_common(leads(spark, d), [*KEYS, "part_id"], "mapq", smallest=True)


@query("int_median", f"{WITH_LEADS} select contig, svtype, part_id, cast(trunc(quantile_cont(mapq, 0.5)) as bigint) as median, round(avg(mapq), 6) as mean, cast(round_even(avg(mapq), 0) as bigint) as mean_rounded from leads group by contig, svtype, part_id")
def int_median(spark, d):
    return rounded(stats.int_stats(leads(spark, d), [*KEYS, "part_id"], "mapq"), "mean")


@query("forward_diff_variance", "with x as (select event_type, (value - lag(value) over w) / nullif(lag(value) over w, 0) as c from events window w as (partition by event_type, user_id order by ts, event_id)), y as (select event_type, user_id, (value - lag(value) over w) / nullif(lag(value) over w, 0) as c from events window w as (partition by event_type, user_id order by ts, event_id)) select event_type, user_id, count(c) as n, round(coalesce(var_pop(c), 0), 4) as variance from y group by event_type, user_id")
def forward_diff_variance(spark, d):
    x = stats.forward_difference_variance(spark.read.parquet(f"{d}/events.parquet"), ["event_type", "user_id"], ["ts", "event_id"], "value")
    return x.withColumn("variance", F.round("variance", 4))


CANDIDATES = f"""{CLUSTERS},
    base as (select contig, svtype, cluster, count(distinct read_id) as support, cast(trunc(avg(mapq)) as bigint) as qual, count(*) filter (strand = '+') as fwd, count(*) filter (strand = '-') as rev from clustered group by contig, svtype, cluster),
    joined as (select b.*, l.center as svlen, s.center as start, p.stdev as stdev_pos, case when b.svtype <> 'BND' then d.stdev end as stdev_len
        from base b join {CENTER.format(keys="contig, svtype, cluster", v="svlen", t="clustered")} l using (contig, svtype, cluster)
        join {CENTER.format(keys="contig, svtype, cluster", v="ref_start", t="clustered")} s using (contig, svtype, cluster)
        join {TRIMMED.format(keys="contig, svtype, cluster", v="ref_start", t="clustered")} p using (contig, svtype, cluster)
        join {TRIMMED.format(keys="contig, svtype, cluster", v="svlen", t="clustered")} d using (contig, svtype, cluster)),
    candidates as (select contig, svtype, cluster, case when svtype = 'DEL' then start + svlen else start end as pos, case when svtype in ('INS', 'DEL') then start else start + abs(svlen) end as stop, svlen, support, qual, stdev_pos + coalesce(stdev_len, 0) < 25 as precise, fwd, rev, stdev_pos, stdev_len
        from joined where abs(svlen) >= 45 or svtype = 'BND')"""


@query("call_candidates", f'{WITH_LEADS}{CANDIDATES} select contig, svtype, cluster, pos, stop as "end", svlen, support, qual, precise, fwd, rev, round(stdev_pos, 6) as stdev_pos, round(stdev_len, 6) as stdev_len from candidates')
def call_candidates(spark, d):
    return longs(rounded(call.candidates(clustered(spark, d), parts=tasks(leads(spark, d))), "stdev_pos", "stdev_len"), "qual")


LIKELIHOOD = """,
    ks as (select *, case when n > 250 then round_even(k * (250.0 / n), 0) else k end as k2, case when n > 250 then round_even(n * (250.0 / n), 0) else n end as n2 from kn),
    q as (select *, pow(0.05, k2) * pow(0.95, n2 - k2) as q0, pow(0.5, k2) * pow(0.5, n2 - k2) as q1, pow(0.95, k2) * pow(1 - 0.95, n2 - k2) as q2 from ks),
    o as (select *, greatest(q0, q1, q2) as best, q0 + q1 + q2 - greatest(q0, q1, q2) - least(q0, q1, q2) as second, case when q0 >= q1 and q0 >= q2 then 0 when q1 >= q2 then 1 else 2 end as alleles from q)"""


@query(
    "call_and_genotype",
    f"{WITH_LEADS}{CANDIDATES}, kn as (select *, cast(support as double) as k, greatest(support, 2 * fwd + rev) as n from candidates where support >= 3){LIKELIHOOD} "
    'select contig, svtype, pos, stop as "end", svlen, support, case when alleles = 2 then 1 else 0 end as gt_a, case when alleles >= 1 then 1 when svtype = \'DUP\' and k / n >= 1.0 / 6 then 1 else 0 end as gt_b, cast(n - k as bigint) as dr, cast(k as bigint) as dv, round(k / n, 6) as vaf from o',
)
def call_and_genotype(spark, d):
    kept = call.candidates(clustered(spark, d), parts=tasks(leads(spark, d))).where(F.col("support") >= P.min_support)
    x = genotype.genotyped(kept, F.col("support"), 2 * F.col("fwd") + F.col("rev"))
    return rounded(x.select("contig", "svtype", "pos", "end", "svlen", "support", "gt_a", "gt_b", "dr", "dv", "vaf"), "vaf")


@query("call_ids", f"{WITH_CALLS} select call_id, 'P.' || svtype || '.' || upper(format('{{:x}}', row_number() over (partition by contig, svtype order by pos, call_id) - 1)) || 'S' || case contig when 'A' then '0' when 'N' then '1' else '2' end as id from calls")
def call_ids(spark, d):
    x = calls(spark, d).join(F.broadcast(spark.sql(CONTIGS)), "contig")
    return call.call_ids(x, ["pos", "call_id"], "P.").select("call_id", "id")


@query("bnd_alt", f"{WITH_LEADS} select lead_id, case when is_sa then 'N' else '' end || case when hap = 0 then ']' else '[' end || contig || ':' || (ref_start + 7) || case when hap = 0 then ']' else '[' end || case when is_sa then '' else 'N' end as alt from leads")
def bnd_alt(spark, d):
    return leads(spark, d).select("lead_id", call.bnd_alt(F.col("contig"), F.col("ref_start") + 7, F.col("is_sa"), F.col("hap") == 0).alias("alt"))


@query("resolve_bnd", f"{WITH_LEADS}, mates as (select *, case when hap = 0 then 'A' else 'B' end as mate_contig, ref_start + 50 as mate from leads where svtype = 'BND'), top as (select contig, part_id, mate_contig, count(*) as n from mates group by contig, part_id, mate_contig qualify row_number() over (partition by contig, part_id order by n desc, mate_contig desc) = 1), kept as (select m.* from mates m join top t using (contig, part_id, mate_contig)), flags as (select contig, part_id, is_sa, count(*) as n from kept group by contig, part_id, is_sa qualify row_number() over (partition by contig, part_id order by n desc, is_sa desc) = 1), sides as (select contig, part_id, strand = '+' as rev, count(*) as n from kept group by contig, part_id, strand qualify row_number() over (partition by contig, part_id order by n desc, rev desc) = 1), sup as (select contig, part_id, count(distinct read_id) as support from kept group by all) select contig, part_id, t.mate_contig, c.center as mate_pos, f.is_sa as is_first, s.rev as is_reverse, support, case when f.is_sa then 'N' else '' end || case when s.rev then ']' else '[' end || t.mate_contig || ':' || c.center || case when s.rev then ']' else '[' end || case when f.is_sa then '' else 'N' end as alt from top t join {CENTER.format(keys='contig, part_id', v='mate', t='kept')} c using (contig, part_id) join flags f using (contig, part_id) join sides s using (contig, part_id) join sup using (contig, part_id)")
def resolve_bnd(spark, d):
    x = leads(spark, d).where("svtype = 'BND'").withColumns({"mate_contig": F.when(F.col("hap") == 0, "A").otherwise("B"), "mate_ref_start": F.col("ref_start") + 50, "is_first": F.col("is_sa"), "is_reverse": F.col("strand") == "+"})
    return call.resolve_bnd(x, ["contig", "part_id"])


@query("ins_representative", f"{WITH_LEADS}, s as (select *, quantity * 20 + lead_id % 13 as n from leads where svtype = 'INS'), c as (select contig, part_id, max(svlen) as l, min(ref_start) as p from s group by all) select contig, part_id, arg_min(lead_id, (abs(n - l) + 1.5 * abs(ref_start - p), lead_id)) as lead, cast(min(abs(n - l) + 1.5 * abs(ref_start - p)) as double) as cost from s join c using (contig, part_id) group by contig, part_id")
def ins_representative(spark, d):
    x = leads(spark, d).where("svtype = 'INS'").withColumn("seq", F.expr("repeat('A', cast(quantity * 20 + lead_id % 13 as int))"))
    top = x.groupBy("contig", "part_id").agg(F.max("svlen").alias("svlen"), F.min("ref_start").alias("pos"))
    return call.ins_representative(x, top, ["contig", "part_id"], "lead_id").drop("seq")


# --- filters -------------------------------------------------------------------------------------

_SINGLE, _SIZE = "svtype like 'SINGLE%'", "abs(svlen)"
_FALL, _RISE = "cov_downstream / nullif(cov_upstream, 0)", "cov_upstream / nullif(cov_downstream, 0)"
_SLOPE = f"((cov_upstream > cov_center and cov_center > cov_downstream and {_FALL} < 0.7) or (cov_upstream < cov_center and cov_center < cov_downstream and {_RISE} < 0.7))"
RULES_SQL = [
    ("STDEV_POS", f"stdev_pos > 500 or (not ({_SINGLE}) and svtype <> 'BND' and stdev_pos / {_SIZE} > 2)"),
    ("STDEV_LEN", f"(svtype <> 'BND' and stdev_len / {_SIZE} > 1) or stdev_len > 500"),
    ("SINGLE_BREAK", _SINGLE),
    ("SVLEN_MIN", f"{_SIZE} < 50 and svtype <> 'BND' and support < 10"),
    ("STRAND_BND", "svtype = 'BND' and (fwd = 0 or rev = 0)"),
    ("COV_CHANGE_DEL", f"svtype = 'DEL' and {_SIZE} between 50000 and 200000 and ((cov_center > (cov_upstream + cov_downstream) * 0.33 and {_SLOPE}) or (cov_upstream > cov_downstream and ({_FALL} < 0.5 or cov_center > cov_downstream)) or (cov_upstream < cov_downstream and ({_RISE} < 0.5 or cov_center > cov_upstream)))"),
    ("COV_CHANGE_DUP", f"svtype = 'DUP' and {_SIZE} between 50000 and 200000 and cov_center < (cov_upstream + cov_downstream) * 0.665 and ({_SLOPE} or (cov_upstream > cov_downstream and ({_FALL} < 0.5 or cov_center < cov_downstream)) or (cov_upstream < cov_downstream and ({_RISE} < 0.5 or cov_center < cov_upstream)))"),
    ("COV_CHANGE_INS", "svtype = 'INS' and (cov_upstream < 1 or cov_downstream < 1)"),
    ("INLINE_SA", "svtype in ('INS', 'DEL') and sa_share > 0.8 and sa_count > 5 and support_sa = 0"),
    ("COV_VAR", "coverage_var >= 0.3"),
    *((f"COV_CHANGE_FRAC_{n}", f"abs(greatest({a}, 1) - greatest({b}, 1)) / greatest({a}, {b}, 1) > 0.8") for n, a, b in zip(("US", "SC", "CE", "ED"), ("cov_upstream", "cov_start", "cov_center", "cov_end"), ("cov_start", "cov_center", "cov_end", "cov_downstream"))),
    ("SUPPORT_MIN", "support < 3"),
]


def _first_sql(rules) -> str:
    return "case " + " ".join(f"when {c} then '{n}'" for n, c in rules) + " else 'PASS' end"


def _all_sql(rules) -> str:
    names = [n for n, _ in rules]
    listed = "concat_ws(';', " + ", ".join(f"case when {c} then '{n}' end" for n, c in rules) + ")"
    assert len(set(names)) == len(names)
    return f"coalesce(nullif({listed}, ''), 'PASS')"


@query("qc_ladder", f"{WITH_CALLS} select call_id, {_first_sql(RULES_SQL)} as filter from calls")
def qc_ladder(spark, d):
    return calls(spark, d).select("call_id", qc.first_filter(qc.call_rules(max_change=0.8) + qc.support_rule()).alias("filter"))


@query("qc_all_filters", f"{WITH_CALLS} select call_id, {_all_sql(RULES_SQL)} as filter from calls")
def qc_all_filters(spark, d):
    return calls(spark, d).select("call_id", qc.all_filters(qc.call_rules(max_change=0.8) + qc.support_rule()).alias("filter"))


@query("min_support_auto", f"{WITH_CALLS} select call_id, (case when svtype = 'INS' and svlen >= 2500 then round_even(support * (1.66 + 0.33 * svlen / 2500), 0) else support end) < round_even(1.5 + 0.1 * (0.75 * cov_center + 0.25 * cov_global), 0) as failed from calls")
def min_support_auto(spark, d):
    return calls(spark, d).select("call_id", (qc.first_filter(qc.support_rule(auto=True)) != "PASS").alias("failed"))


_NO_GT = "(gt_a is null or gt_a + gt_b < 2)"


def _gt_rules_sql(mosaic: bool) -> list[tuple[str, str]]:
    m, low = ("vaf <= 0.218" if mosaic else "false"), "vaf <= 0.218"
    one = "(fwd = 0 or rev = 0)"
    short = "not (svtype = 'INS' and svlen >= 2500)"
    return [
        ("COV_MIN_GT", f"cov_center < 1 and {_NO_GT} and svtype <> 'DEL' and abs(svlen) > 50000"),
        ("ALN_NM", f"{m} and nm > regional_nm * 1.66 and coalesce(gt_b, 0) = 0"),
        ("MOSAIC_VAF", f"({'false' if mosaic else low} and not (svtype = 'DUP' and vaf >= 1.0 / 6))"),
        ("SUPPORT_MIN", f"{m} and support < (case when svtype in ('BND', 'INV') or not precise or stdev_len is null or stdev_len / abs(svlen) > 0.1 or stdev_pos > 5 then 3 else 2 end)"),
        ("SVLEN_MAX_MOSAIC", f"{m} and svtype <> 'BND' and abs(svlen) > 50000"),
        ("STRAND", f"not ({m}) and svtype <> 'BND' and {short} and {one}"),
        ("STRAND_MOSAIC", f"{m} and svtype <> 'BND' and {short} and {one} and support >= 10"),
        ("SVLEN_MIN_MOSAIC", f"{m} and svtype in ('INV', 'DUP') and svlen < 500"),
        ("COV_MIN", f"cov_center < 1 and svtype not in ('DEL', 'INS') and not (svtype = 'INV' and svlen > 10000 and not ({m}))"),
        ("MOSAIC_VAF", f"{m} and (vaf < 0.05 or vaf > 0.218)"),
        ("NOT_MOSAIC_VAF", f"{str(mosaic).lower()} and vaf > 0.218"),
        ("MOSAIC_SV_CLOSE_EDGE", f"{m} and svtype not in ('BND', 'SINGLE_LEFT') and edge_reads / support >= 0.75"),
    ]


@query("qc_after_genotype", f"{WITH_CALLS} select call_id, {_first_sql(_gt_rules_sql(False))} as filter from calls")
def qc_after_genotype(spark, d):
    return calls(spark, d).select("call_id", qc.first_filter(qc.genotype_rules(strand=True)).alias("filter"))


@query("qc_mosaic", f"{WITH_CALLS} select call_id, {_first_sql(_gt_rules_sql(True))} as filter from calls")
def qc_mosaic(spark, d):
    return calls(spark, d).select("call_id", qc.first_filter(qc.genotype_rules(mosaic=True, strand=True)).alias("filter"))


# --- genotypes -----------------------------------------------------------------------------------


def _phred_sql(q: str) -> str:
    r = f"(({q} / nullif(q0 + q1 + q2, 0)) / nullif(best / nullif(q0 + q1 + q2, 0), 0))"
    return f"cast(least(60, trunc(case when {r} > 0 then -10 * log10({r}) else 0 end)) as integer)"


@query("genotype", f"with kn as (select l_partkey as part_id, 'DEL' as svtype, cast(count(*) filter (l_returnflag = 'R') as double) as k, count(*) as n from lineitem group by l_partkey){LIKELIHOOD} select part_id, case when alleles = 2 then 1 else 0 end as gt_a, case when alleles >= 1 then 1 else 0 end as gt_b, cast(n - k as bigint) as dr, cast(k as bigint) as dv, round(k / n, 6) as vaf, {_phred_sql('second')} as gq, {_phred_sql('q0')} as z, case when {_phred_sql('q0')} < 5 then 'GT' else 'PASS' end as gt_filter from o")
def genotype_(spark, d):
    x = view(spark, d, "select l_partkey as part_id, 'DEL' as svtype, 100L as svlen, count(*) as n, count_if(l_returnflag = 'R') as k from {lineitem} group by l_partkey")
    return rounded(genotype.genotyped(x, F.col("k"), F.col("n")).select("part_id", "gt_a", "gt_b", "dr", "dv", "vaf", "gq", "z", "gt_filter"), "vaf")


def _mean_sql(*xs: str) -> str:
    return f"round_even(list_avg(list_filter([{', '.join(f'cast({x} as double)' for x in xs)}], lambda x: x <> 0)), 0)"


@query("genotype_inputs", f"{WITH_CALLS}, k as (select *, case when svtype = 'INS' and svlen >= 2500 then round_even(support * (1.66 + 0.33 * svlen / 2500), 0) else support end as k from calls) select call_id, cast(k as bigint) as k, cast(case svtype when 'INS' then {_mean_sql('cov_center')} when 'DUP' then {_mean_sql('cov_start', 'cov_end')} + round_even(k * 0.75, 0) when 'INV' then {_mean_sql('cov_upstream', 'cov_downstream')} + round_even(k * 0.5, 0) when 'DEL' then {_mean_sql('cov_start + support_sa', 'cov_center + support_sa', 'cov_end + support_sa')} else {_mean_sql('cov_start', 'cov_center', 'cov_end')} end as bigint) as n from k")
def genotype_inputs(spark, d):
    k, n = genotype.observed()
    return calls(spark, d).select("call_id", k.cast("long").alias("k"), n.cast("long").alias("n"))


def _vote_sql(name: str) -> str:
    return f"{name}_c as (select contig, svtype, part_id, {name}, count(*) as n from votes group by all), {name}_r as (select *, row_number() over (partition by contig, svtype, part_id order by n desc, {name} desc) as r, sum(n) over (partition by contig, svtype, part_id) as total from {name}_c), {name}_t as (select contig, svtype, part_id, {name}, n as {name}_support, case when (total - n) / total < 0.1 then 'PASS' else 'FAIL' end as {name}_filter from {name}_r where r = 1)"


@query("phase_vote", f"{WITH_LEADS}, votes as (select contig, svtype, part_id, read_id, arg_max(cast(hap as varchar), lead_id) as hp, arg_max(cast(phase_set as varchar), lead_id) as ps from leads group by all), {_vote_sql('hp')}, {_vote_sql('ps')} select contig, svtype, part_id, hp || ',' || ps || ',' || hp_support || ',' || ps_support || ',' || hp_filter || ',' || ps_filter as phase, case when hp_filter = 'PASS' and hp in ('1', '2') then hp end as haplotype from hp_t join ps_t using (contig, svtype, part_id)")
def phase_vote(spark, d):
    return genotype.phase_votes(leads(spark, d), [*KEYS, "part_id"], "lead_id").select(*KEYS, "part_id", "phase", "haplotype")


@query("phase_rescue", f"{WITH_CALLS}, f as (select *, case when vaf <= 0.218 then 'MOSAIC_VAF' else 'PASS' end as filter, support + cov_start as hap_reads from calls) select call_id, case when hit then 'PASS' else filter end as filter, case when hit then 1 else gt_b end as gt_b from (select *, filter = 'MOSAIC_VAF' and support >= 3 and abs(svlen) <= 10000 and nm <= 0.05 and sa_count > 3 and support / hap_reads >= 0.75 as hit from f)")
def phase_rescue(spark, d):
    x = calls(spark, d).withColumns({"filter": F.when(F.col("vaf") <= P.mosaic_af_max, "MOSAIC_VAF").otherwise("PASS"), "hap_reads": F.col("support") + F.col("cov_start"), "hap_support": F.col("support"), "n_leads": F.col("sa_count")})
    return genotype.phase_rescued(x).select("call_id", "filter", "gt_b")


@query("genotype_string", f"{WITH_CALLS} select call_id, case when sample_id = 1 and gt_a = 0 and gt_b = 1 then '1|0' else coalesce(cast(gt_a as varchar), '.') || case when sample_id in (1, 2) and gt_a in (0, 1) and gt_b = 1 then '|' else '/' end || coalesce(cast(gt_b as varchar), '.') end || ':' || qual || ':' || cov_start || ':' || support || ':' || case when sample_id = 2 then '9' else '.' end as genotype from calls")
def genotype_string(spark, d):
    x = calls(spark, d).withColumns({"gq": F.col("qual"), "dr": F.col("cov_start"), "dv": F.col("support"), "haplotype": F.when(F.col("sample_id").isin(1, 2), F.col("sample_id").cast("string")), "phase_set": F.when(F.col("sample_id") == 2, "9")})
    return x.select("call_id", genotype.genotype_string().alias("genotype"))


# --- matching and combining ----------------------------------------------------------------------

TARGETS = "select p_partkey as target_id, case p_size % 3 when 0 then 'A' when 1 then 'N' else 'R' end as contig, case p_size % 5 when 0 then 'INS' when 1 then 'DEL' when 2 then 'DUP' when 3 then 'INV' else 'BND' end as svtype, p_partkey * 2000 + p_size * 3 as pos, cast(p_size * 20 as bigint) as svlen from {part}"


@query("forced_genotype_nearest", f"with calls as ({lens_text(CALLS)}), targets as ({lens_text(TARGETS)}), met as (select target_id, call_id, t.svtype, abs(t.pos - c.pos) as dp, abs(abs(t.svlen) - abs(c.svlen)) as dl, least(250 * sqrt(least(abs(t.svlen), abs(c.svlen))), 1000) as lim from targets t join calls c on t.contig = c.contig and t.svtype = c.svtype and c.pos between t.pos - 1000 and t.pos + 1000), near as (select target_id, call_id, case when svtype = 'BND' then dp else dp + dl end as distance from met where case when svtype = 'BND' then dp <= 1000 else dp + dl <= lim end), best as (select target_id, min(distance) as distance, arg_min(call_id, (distance, call_id)) as call_id from near group by target_id) select t.target_id, distance, call_id from targets t left join best using (target_id)")
def forced_genotype_nearest(spark, d):
    return combine.nearest(view(spark, d, TARGETS), calls(spark, d)).select("target_id", "distance", "call_id")


POPULATION = "select p_partkey as variant, 'v' || cast(p_partkey as string) as id, r.contig, case p_size % 5 when 0 then 'INS' when 1 then 'DEL' when 2 then 'DUP' when 3 then 'INV' else 'BND' end as svtype, p_partkey * 2000 + p_size as pos, cast(p_size * 20 as bigint) as svlen, cast(p_size as double) / 51 as af, cast(p_size as bigint) as genotyped_n from {part} cross join (select 'A' as contig union all select 'N' union all select 'R') r"


@query("population_annotate", f"with calls as ({lens_text(CALLS)}), population as ({lens_text(POPULATION)}), met as (select call_id, v.id, af, genotyped_n, abs(c.pos - v.pos) + abs(abs(c.svlen) - abs(v.svlen)) as dist, least(250 * sqrt(least(abs(c.svlen), abs(v.svlen))), 1000) as lim from calls c join population v on c.contig = v.contig and c.svtype = v.svtype and c.pos // 100000 = v.pos // 100000), best as (select call_id, arg_min(af, (dist, id)) as af, arg_min(genotyped_n, (dist, id)) as n from met where dist <= lim group by call_id) select c.call_id, round(coalesce(af, 0), 5) as population_af, coalesce(n, 0) as population_size from calls c left join best b on b.call_id = c.call_id")
def population_annotate(spark, d):
    x = combine.population_annotated(calls(spark, d), view(spark, d, POPULATION)).select("call_id", "population_af", "population_size")
    return x.withColumn("population_af", F.round(F.col("population_af").cast("double"), 5))


@query("population_sequences", f"with calls as ({lens_text(CALLS)}), population as ({lens_text(POPULATION)}), c as (select *, repeat('ACG', cast(abs(svlen) % 31 as int)) as alt from calls where svtype in ('INS', 'DEL')), v as (select *, repeat('ACT', cast(svlen % 23 as int)) as alt from population), met as (select call_id, v.id, af, abs(c.pos - v.pos) + abs(abs(c.svlen) - abs(v.svlen)) as dist, least(250 * sqrt(least(abs(c.svlen), abs(v.svlen))), 1000) as lim, c.svtype <> 'INS' or (v.svlen - levenshtein(c.alt, v.alt)) / v.svlen > 0.7 as fits from c join v on c.contig = v.contig and c.svtype = v.svtype and c.pos // 100000 = v.pos // 100000), best as (select call_id, arg_min(af, (dist, id)) as af from met where dist <= lim and fits group by call_id) select c.call_id, round(coalesce(af, 0), 5) as population_af from c left join best b on b.call_id = c.call_id")
def population_sequences(spark, d):
    x = calls(spark, d).where("svtype in ('INS', 'DEL')").withColumn("alt", F.expr("repeat('ACG', cast(abs(svlen) % 31 as int))"))
    variants = view(spark, d, POPULATION).withColumn("alt", F.expr("repeat('ACT', cast(svlen % 23 as int))"))
    found = combine.population_annotated(x, variants).select("call_id", "population_af")
    return found.withColumn("population_af", F.round(F.col("population_af").cast("double"), 5))


@query("population_af", "with g as (select l_partkey as variant_id, case when l_linenumber % 7 = 0 then null when l_returnflag = 'R' then 1 else 0 end as a, case when l_linenumber % 7 = 0 then null when l_linestatus = 'O' then 1 else 0 end as b from lineitem) select variant_id, round(sum(coalesce(a + b, 0)) / nullif(2 * count(a), 0), 6) as af, count(a) as genotyped_n, count(*) filter (coalesce(a + b, 0) > 0) as variant_n from g group by variant_id having count(a) / 30 >= 0.75")
def population_af(spark, d):
    x = view(spark, d, "select l_partkey as variant_id, case when l_linenumber % 7 = 0 then null when l_returnflag = 'R' then 1 else 0 end as gt_a, case when l_linenumber % 7 = 0 then null when l_linestatus = 'O' then 1 else 0 end as gt_b from {lineitem}")
    return rounded(combine.population_frequencies(x, 30), "af")


SAMPLE_CANDIDATES = f"{LEADS}"


def sample_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each sample: the center of its leads of a cluster."""
    x = clustered(spark, d).repartition(*call.KEYS)  # one exchange for the distinct reads too
    x = x.groupBy("sample_id", *call.KEYS).agg(F.min("ref_start").alias("pos"), F.max("svlen").alias("svlen"), F.count_distinct("read_id").alias("support"), F.count_if(F.col("strand") == "+").alias("fwd"), F.count_if(F.col("strand") == "-").alias("rev"), F.min("lead_id").alias("call_id"))
    return x.withColumns({"mate_contig": F.when(F.col("svtype") == "BND", F.col("contig")), "mate_pos": F.when(F.col("svtype") == "BND", F.col("pos") + 5000)})


SAMPLES_SQL = f"{WITH_LEADS}{CLUSTERS}, members as (select sample_id, contig, svtype, cluster, min(ref_start) as pos, max(svlen) as svlen, count(distinct read_id) as support, count(*) filter (strand = '+') as fwd, count(*) filter (strand = '-') as rev, min(lead_id) as call_id from clustered group by all), groups as (select contig, svtype, cluster, avg(pos) as pos_mean from members group by all), samples as (select distinct sample_id from leads)"


@query("sample_candidates", f"{SAMPLES_SQL} select sample_id, contig, svtype, cluster, pos, svlen, support from members")
def sample_candidates_(spark, d):
    return sample_candidates(spark, d).select("sample_id", *call.KEYS, "pos", "svlen", "support")


def sample_coverage(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "select l_suppkey % 4 as sample_id, l_returnflag as contig, cast(floor((l_partkey * 2000 + l_orderkey % 140) / 500) * 500 as bigint) as cov_bin, count(*) as depth from {lineitem} group by 1, 2, 3")


COVERAGE_SQL = "depths as (select l_suppkey % 4 as sample_id, l_returnflag as contig, cast(floor((l_partkey * 2000 + l_orderkey % 140) / 500) * 500 as bigint) as cov_bin, count(*) as depth from lineitem group by all)"


def grouped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    members = stored(sample_candidates(spark, d)).withColumn("group_id", F.concat_ws(":", "contig", "svtype", "cluster"))
    groups = members.groupBy("group_id", "contig").agg(F.avg("pos").alias("pos_mean"))
    return members, groups, leads(spark, d).select("sample_id").distinct()


@query("absent_sample_cov", f"{SAMPLES_SQL}, {COVERAGE_SQL} select g.contig || ':' || g.svtype || ':' || g.cluster as group_id, s.sample_id, coalesce(depth, 0) as depth from groups g cross join samples s left join depths d on d.sample_id = s.sample_id and d.contig = g.contig and d.cov_bin = cast(floor(pos_mean / 500) * 500 as bigint) where not exists (select 1 from members m where m.contig = g.contig and m.svtype = g.svtype and m.cluster = g.cluster and m.sample_id = s.sample_id)")
def absent_sample_cov(spark, d):
    members, groups, samples = grouped(spark, d)
    return combine.absent_coverage(groups, members, samples, sample_coverage(spark, d))


@query("sample_pivot_suppvec", f"{SAMPLES_SQL} select contig || ':' || svtype || ':' || cluster as group_id, count(distinct sample_id) as samples, cast(round_even(avg(support), 0) as bigint) as support, cast(sum(fwd) as bigint) as fwd, cast(sum(rev) as bigint) as rev, max((sample_id = 0)::int) || '' || max((sample_id = 1)::int) || max((sample_id = 2)::int) || max((sample_id = 3)::int) as supp_vec, arg_min(pos, (-support, call_id)) as pos, arg_min(svlen, (-support, call_id)) as svlen from members group by contig, svtype, cluster having count(distinct case when support >= 1 then sample_id end) > 0 and (abs(arg_min(svlen, (-support, call_id))) >= 45 or svtype = 'BND')")
def sample_pivot_suppvec(spark, d):
    members, _, samples = grouped(spark, d)
    members = members.withColumns({"end": F.col("pos"), "precise": F.lit(True), "gt_a": F.lit(0), "gt_b": F.lit(1), "passed": F.lit(True)})
    return combine.group_calls(members, sample_coverage(spark, d), samples).select("group_id", "samples", "support", "fwd", "rev", "supp_vec", "pos", "svlen")


#: Buffers by a fold over a block's bins, then calls one by one, each joined with the open groups of its contig and type; a group is named by its first call.
GROUPS_SQL = SAMPLES_SQL.replace("with ", "with recursive ", 1) + """,
    cands as (select *, case when svtype = 'BND' then contig end as mate_contig, case when svtype = 'BND' then pos + 5000 end as mate_pos, pos // 100 * 100 as bin, pos // 100000 as block from members),
    spots as (select *, row_number() over (partition by contig, svtype, block order by bin) as i from (select contig, svtype, block, bin, count(*) as n from cands group by all)),
    fold as (
        select contig, svtype, block, i, bin, n as held, 0 as no from spots where i = 1
        union all
        select b.contig, b.svtype, b.block, b.i, b.bin, case when f.held >= 25 then 0 else f.held end + b.n, f.no + (f.held >= 25)::int
        from fold f join spots b on b.contig = f.contig and b.svtype = f.svtype and b.block = f.block and b.i = f.i + 1),
    buffers as (select contig, svtype, bin, max(bin) over w as last_bin, count(*) over w as filled from fold window w as (partition by contig, svtype, block, no)),
    placed as (
        select *, row_number() over (partition by contig, svtype order by last_bin, support desc, pos, call_id) as i, last_bin is distinct from lead(last_bin) over (partition by contig, svtype order by last_bin, support desc, pos, call_id) as ends
        from cands join buffers using (contig, svtype, bin)),
    walk as (
        select contig, svtype, 0 as i, null::bigint as call_id, null::bigint as name, []::struct(name bigint, n bigint, pos double, size double, mate double, mate_contig varchar)[] as groups from (select distinct contig, svtype from placed)
        union all
        select contig, svtype, i, call_id, coalesce(groups[k].name, call_id),
            list_filter(case when k is null then list_append(groups, {'name': call_id, 'n': 1::bigint, 'pos': pos::double, 'size': abs(svlen)::double, 'mate': coalesce(mate_pos, 0)::double, 'mate_contig': mate_contig})
                else list_transform(groups, lambda g, j: case when j = k then {'name': g.name, 'n': g.n + 1, 'pos': g.pos + (pos - g.pos) / (g.n + 1), 'size': g.size + (abs(svlen) - g.size) / (g.n + 1), 'mate': g.mate + (coalesce(mate_pos, 0) - g.mate) / (g.n + 1), 'mate_contig': g.mate_contig} else g end) end,
                lambda g: not ends or abs(g.pos - last_bin) < greatest(50 * filled, 2500))
        from (
            select *, case when list_min(far) is not null then list_position(far, list_min(far)) end as k from (
                select r.contig, r.svtype, r.i, r.call_id, r.pos, r.svlen, r.mate_pos, r.mate_contig, r.ends, r.last_bin, r.filled, w.groups,
                    list_transform(w.groups, lambda g: case when r.svtype = 'BND' then case when g.mate_contig = r.mate_contig and abs(g.pos - r.pos) + abs(g.mate - r.mate_pos) <= 2000 then abs(g.pos - r.pos) + abs(g.mate - r.mate_pos) end
                        when least(g.size, abs(r.svlen)) > 0 and abs(g.pos - r.pos) + abs(g.size - abs(r.svlen)) <= least(250 * sqrt(least(g.size, abs(r.svlen))), 1000) then abs(g.pos - r.pos) + abs(g.size - abs(r.svlen)) end) as far
                from walk w join placed r on r.contig = w.contig and r.svtype = w.svtype and r.i = w.i + 1))),
    told as (select c.call_id, c.sample_id, contig, svtype, c.pos, c.svlen, c.support, c.mate_contig, c.mate_pos, contig || ':' || svtype || ':' || w.name as group_id from walk w join cands c using (contig, svtype, call_id))"""


@query("combine_groups", f"{GROUPS_SQL} select * from told")
def combine_groups(spark, d):
    x = sample_candidates(spark, d).select("call_id", "sample_id", "contig", "svtype", "pos", "svlen", "support", "mate_contig", "mate_pos")
    return combine.combined(stored(x), 4)


@query("majority_genotype", f"{WITH_CALLS}, c as (select contig || pos // 2000 as group_id, gt_a, gt_b, count(*) as n from calls where gt_a is not null group by all) select group_id, gt_a, gt_b from c qualify row_number() over (partition by group_id order by n desc, gt_a + gt_b desc, gt_b desc) = 1")
def majority_genotype(spark, d):
    return combine.majority_genotype(calls(spark, d).withColumn("group_id", F.concat("contig", F.floor(F.col("pos") / 2000).cast("string"))))


@query("edit_gate", "with t as (select item_id, text, lead(text) over (order by item_id) as other from benchmark), m as (select item_id, (length(text) + length(other)) / 2 as mean, abs(length(text) - length(other)) as gap, levenshtein(text, other) as d from t where other is not null) select item_id, coalesce((mean - gap) / nullif(mean, 0) > 0.7 and (mean - d) / nullif(mean, 0) > 0.7, false) as alike from m")
def edit_gate(spark, d):
    x = spark.read.parquet(f"{d}/benchmark.parquet")
    after = x.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other"))  # ids are consecutive
    return x.join(after, "item_id").select("item_id", combine.alike(F.col("text"), F.col("other")).alias("alike"))


# --- sequences and text --------------------------------------------------------------------------


@query("kmer_anchors", "with k as (select item_id, unnest(range(0, length(text) - 6, 3)) as p, text from benchmark where length(text) > 6), m as (select item_id, substr(text, p + 1, 6) as kmer, count(*) as n, min(p) as p from k group by all) select item_id, kmer, p as \"at\" from m where n = 1")
def kmer_anchors(spark, d):
    return longs(consensus.anchors(spark.read.parquet(f"{d}/benchmark.parquet"), "item_id", "text", skip=3), "at")


@query("consensus")
def consensus_(spark, d):
    x = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.col("text").alias("best"))
    others = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.concat(F.substring("best", F.lit(1), i * 7), F.lit("x"), F.substring(F.col("best"), i * 7 + 2, F.length("best"))))
    return consensus.with_consensus(x.withColumn("others", others)).drop("others")


@query("vcf_lines", f"{WITH_CALLS} select call_id, contig || chr(9) || greatest(pos, 1) || chr(9) || svtype || '.' || call_id || chr(9) || 'N' || chr(9) || '<' || svtype || '>' || chr(9) || qual || chr(9) || 'PASS' || chr(9) || case when precise then 'PRECISE' else 'IMPRECISE' end || ';SVTYPE=' || svtype || case when svtype <> 'BND' then ';SVLEN=' || svlen || ';END=' || case when precise and svtype = 'DEL' then greatest(pos, 1) + abs(svlen) else stop end else '' end || ';SUPPORT=' || support || ';COVERAGE=' || cov_upstream || ',' || cov_start || ',' || cov_center || ',' || cov_end || ',' || cov_downstream || ';STRAND=' || case when fwd > 0 then '+' else '' end || case when rev > 0 then '-' else '' end || coalesce(';STDEV_LEN=' || printf('%.3f', stdev_len), '') || ';STDEV_POS=' || printf('%.3f', stdev_pos) || ';SUPPORT_SA=' || support_sa || ';VAF=' || printf('%.3f', vaf) || chr(9) || 'GT:GQ:DR:DV' || chr(9) || './.' as line from calls")
def vcf_lines(spark, d):
    x = calls(spark, d).withColumns({"id": F.concat_ws(".", "svtype", F.col("call_id").cast("string")), "ref": F.lit("N"), "alt": F.concat(F.lit("<"), "svtype", F.lit(">")), "filter": F.lit("PASS")})
    x = x.withColumns({c: F.col(c).cast("double") for c in ("stdev_pos", "stdev_len", "vaf")})
    return text.vcf_lines(x, F.lit("./.")).select(F.split("id", r"\.")[1].cast("long").alias("call_id"), "line")


@query("vcf_parse", f"{WITH_CALLS} select call_id as line_index, contig, pos - 1 as pos, case when call_id % 2 = 0 then svtype when svlen >= 0 or quantity = 0 then 'INS' else 'DEL' end as svtype, case when call_id % 2 = 0 then case when svtype = 'DEL' then -abs(svlen) else svlen end else case when svlen >= 0 then quantity else -quantity end end as svlen from (select *, abs(svlen) % 50 as quantity from calls where svtype not like 'SINGLE%')")
def vcf_parse(spark, d):
    x = calls(spark, d).where("svtype not like 'SINGLE%'")
    size = (F.abs("svlen") % 50).cast("int")
    symbolic = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("x"), F.lit("N"), F.concat(F.lit("<"), "svtype", F.lit(">")), F.lit("9"), F.lit("PASS"), F.concat(F.lit("SVTYPE="), "svtype", F.lit(";PRECISE;SVLEN="), F.abs("svlen").cast("string")))
    grown, plain = F.concat(F.lit("A"), F.repeat(F.lit("C"), size)), F.lit("A")
    explicit = F.concat_ws("\t", "contig", F.col("pos").cast("string"), F.lit("x"), F.when(F.col("svlen") >= 0, plain).otherwise(grown), F.when(F.col("svlen") >= 0, grown).otherwise(plain), F.lit("9"), F.lit("PASS"), F.lit("."))
    lines = x.select(F.col("call_id").alias("line_index"), F.when(F.col("call_id") % 2 == 0, symbolic).otherwise(explicit).alias("value"))
    return readers.parse_vcf(lines).select("line_index", "contig", "pos", "svtype", "svlen")


@query("vcf_rewrite", f"{WITH_CALLS} select call_id as line_index, concat_ws(chr(9), 'c', pos, 'i', 'N', svtype, 1, 'PASS', 'X', 'GT:GQ:DR:DV:PS', case when sample_id = 0 then '0/1:1:2:3:4' else './.:0:0:0:.' end) as line from calls")
def vcf_rewrite(spark, d):
    x = calls(spark, d)
    lines = x.select(F.col("call_id").alias("line_index"), F.concat_ws("\t", F.lit("c"), F.col("pos").cast("string"), F.lit("i"), F.lit("N"), "svtype", F.lit("1"), F.lit("PASS"), F.lit("X"), F.lit("GT"), F.lit("old")).alias("line"))
    return text.rewritten(lines, x.where("sample_id = 0").select(F.col("call_id").alias("line_index"), F.lit("0/1:1:2:3:4").alias("genotype")))


@query("candidates_csv", f"{WITH_CALLS} select call_id, concat_ws(',', svtype, case when svtype = 'BND' and precise then '+' when svtype = 'BND' then '-' else '+' end, contig, pos, case when svtype = 'BND' and sample_id = 0 then '+' else '-' end, case when svtype = 'BND' then 'M' else contig end, case when svtype = 'BND' then pos + 7 else stop end, 'PASS', support, support_sa, cov_center) as line from calls")
def candidates_csv(spark, d):
    x = calls(spark, d).withColumns({"id": F.col("call_id"), "is_first": F.col("precise"), "is_reverse": F.col("sample_id") == 0, "mate_contig": F.lit("M"), "mate_pos": F.col("pos") + 7, "filter": F.lit("PASS"), "support_inline": F.col("support"), "support_split": F.col("support_sa"), "support_ref": F.col("cov_center")})
    return text.candidates_csv(x).select(F.col("id").alias("call_id"), "line")


@query("emitted_calls", f"{WITH_CALLS} select call_id from calls where svtype not like 'SINGLE%' and not (svtype = 'INS' and abs(svlen) % 97 < 50) and not (svtype = 'DEL' and sample_id * 10 > 0.5 * (sample_id * 10 + 15)) and sample_id <> 3")
def emitted_calls(spark, d):
    x = calls(spark, d).withColumns({"alt": F.repeat(F.lit("A"), (F.abs("svlen") % 97).cast("int")), "ref": F.concat(F.repeat(F.lit("N"), (F.col("sample_id") * 10).cast("int")), F.repeat(F.lit("C"), F.lit(15))), "supp_vec": F.when(F.col("sample_id") == 3, "000").otherwise("010")})
    return qc.emitted(x).select("call_id")


@query("cluster_bed", f"{WITH_LEADS}{CLUSTERS} select contig, cluster as start, max(ref_start // 100 * 100) + 100 as \"end\", svtype || ':' || count(*) as name from clustered group by contig, svtype, cluster")
def cluster_bed(spark, d):
    x = clustered(spark, d).withColumn("cluster_end", grid.bin_of("ref_start") + 100)
    return text.clusters_bed(x)


@query("bed_regions", f"with repeats as ({lens_text(REPEATS)}) select contig, start, stop as \"end\" from repeats")
def bed_regions(spark, d):
    x = view(spark, d, REPEATS)
    lines = x.select(F.explode(F.array(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), F.lit("name")), F.concat(F.lit("# "), "contig"), F.lit("junk line here"), F.lit(""))).alias("value"))
    return readers.parse_bed(lines)


@query("event_windows", "select cast(epoch(date_trunc('hour', ts)) as bigint) as start, event_type as contig, cast(floor(floor(epoch(ts)) / 100) * 100 as bigint) as bin, count(*) as n, round(sum(value), 4) as value from events group by all")
def event_windows(spark, d):
    x = spark.read.parquet(f"{d}/events.parquet").select("ts", F.col("event_type").alias("contig"), F.unix_timestamp("ts").alias("ref_start"), "value")
    return windowed.windowed_leads(x).withColumns({"start": F.unix_timestamp("start"), "value": F.round("value", 4)})


# --- the entries, over the lenses; tests/engine/test_pipelines.py holds them against planted variants ----------


def entry_alignments(spark: SparkSession, d: str) -> DataFrame:
    return alignments(spark, d).withColumns({"hp": F.col("hap").cast("int"), "ps": F.lit(None).cast("string"), "seq": F.lit(None).cast("string")})


@query("entry_call")
def entry_call(spark, d):
    found = pipelines.call_sample(entry_alignments(spark, d), spark.sql(CONTIGS), repeats=view(spark, d, REPEATS), keep_failed=True)
    return found.select("contig", "svtype", "pos", "end", "svlen", "support", "id", "alt", "filter", "gt_a", "gt_b", "gq", "dr", "dv", "phase")


@query("entry_force")
def entry_force(spark, d):
    given = view(spark, d, TARGETS).select(F.col("target_id").alias("line_index"), "contig", "svtype", "pos", "svlen", (F.col("pos") + F.col("svlen")).alias("end"))
    return pipelines.genotype_variants(entry_alignments(spark, d), spark.sql(CONTIGS), given)


@query(
    "entry_combine",
    GROUPS_SQL.replace("mate_pos, pos // 100 * 100 as bin, pos // 100000 as block from members", "mate_pos, pos // 100 * 100 as bin, pos // 100000 as block from members where support >= 3")
    + f""", {COVERAGE_SQL}, known as (select t.*, m.fwd, m.rev from told t join members m using (call_id)),
    met as (
        select group_id, contig, svtype, arg_min(pos, (-support, call_id)) as pos, arg_min(svlen, (-support, call_id)) as svlen, count(distinct sample_id) as samples, cast(round_even(avg(support), 0) as bigint) as support,
            sum(fwd)::bigint as fwd, sum(rev)::bigint as rev, coalesce(stddev_samp(pos), 0) as stdev_pos, coalesce(stddev_samp(abs(svlen)), 0) as stdev_len, avg(pos) as pos_mean
        from known group by group_id, contig, svtype),
    cells as (
        select g.group_id, s.sample_id, exists (select 1 from known k where k.group_id = g.group_id and k.sample_id = s.sample_id) as has, coalesce(d.depth, 0) >= 5 as deep
        from met g cross join samples s left join depths d on d.sample_id = s.sample_id and d.contig = g.contig and d.cov_bin = cast(floor(pos_mean / 500) * 500 as bigint)),
    wide as (select group_id, string_agg(has::int, '' order by sample_id) as supp_vec, string_agg(case when has then '0/1' when deep then '0/0' else './.' end, chr(9) order by sample_id) as genotypes from cells group by group_id)
    select group_id, contig, svtype, pos, pos as "end", svlen, samples, support, fwd, rev, true as precise, round(stdev_pos, 6) as stdev_pos, round(stdev_len, 6) as stdev_len, supp_vec, genotypes, samples as ac, 'PASS' as filter
    from met join wide using (group_id) where abs(svlen) >= 45 or svtype = 'BND'""",
)
def entry_combine(spark, d):
    members = stored(sample_candidates(spark, d)).withColumns({"end": F.col("pos"), "precise": F.lit(True), "gt_a": F.lit(0), "gt_b": F.lit(1), "passed": F.lit(True)})
    return rounded(pipelines.combine_samples(members, sample_coverage(spark, d), members.select("sample_id").distinct()), "stdev_pos", "stdev_len")
