"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, langid, lm_scoring, packing, quality, repair, simhash, substring, topk, warc, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **how) -> DataFrame:
    """Packed with the ids of the public 50k byte-level vocabulary."""
    import public_tokenizers

    ranks, listed = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("tiktoken", "json"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, packing.added_tokens(listed), **how)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"), window=50)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score(table(spark, sf_dir, "documents"), good)


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.rotated(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("conv_id", "speaker", "segment", "part", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("mask"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(table(spark, sf_dir, "pages"), least=1000))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.cross_fitted(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.summary(spark, *centroids.clustered(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.damaged(table(spark, sf_dir, "conversations")), present_col="present")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_simhash": op4_simhash,
    "op5_chat_rotation": op5_chat_rotation,
    "op6_top_k": op6_top_k,
    "op7_warc": op7_warc,
    "op8_quality": op8_quality,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_language_id": op10_language_id,
    "op11_centroids": op11_centroids,
    "op12_word_bpe": op12_word_bpe,
    "op13_repair": op13_repair,
}


def _clusters_sql(rounds: int) -> str:
    """Assignment and means, written once for each round."""
    near = """near{i} as (
            select r, cluster, distance from (
                select r, cluster, distance, row_number() over (partition by r order by distance, cluster) as place from (
                    select v.r, c.cluster, list_sum(list_transform(list_zip(v.v, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as distance from vectors v, c{i} c)) where place = 1)"""
    means = """c{j} as (
            select c.cluster, coalesce(m.c, c.c) as c from c{i} c left join (
                select cluster, list((s - ((s % n) + n) % n) // n order by d) as c from (
                    select cluster, d, sum(x)::bigint as s, count(*) as n from (
                        select cluster, unnest(v) as x, unnest(range(1, 65)) as d from near{i} join vectors using (r)) group by cluster, d) group by cluster) m using (cluster))"""
    steps = [x.format(i=i, j=i + 1) for i in range(rounds) for x in (near, means)] + [near.format(i=rounds)]
    return f"""
        with vectors as materialized (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
            where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        c0 as (select row_number() over (order by sha256('2:' || vec_id) nulls last, v) - 1 as cluster, v as c from vectors qualify cluster < 40),
        {", ".join(steps)}
        select vec_id, cluster::integer as cluster, distance, sum(distance) over (partition by cluster)::bigint as cluster_inertia,
            sum(distance) over ()::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256
        from near{rounds} join c{rounds} using (cluster) join vectors using (r)
    """


ORACLE_SQL = {
    "op11_centroids": _clusters_sql(5),
    "op5_chat_rotation": """
        with said as (
            select conv_id, turn, coalesce(turn // 64, -1) as segment,
                replace(case when trim(role) <> '' then role else 'unknown' end, '<|', '< |') as role,
                replace(coalesce(text, ''), '<|', '< |') as said
            from conversations),
        rows as (select *, (row_number() over (partition by conv_id, segment order by turn nulls first, role, said) - 1) // 64 as part from said),
        speakers as (select distinct conv_id, role as speaker from rows where role <> 'system'),
        pieces as (
            select r.conv_id, s.speaker, r.segment, r.part, r.turn, r.role, r.said, r.role = s.speaker as own,
                case when r.role = 'system' then '<|system|>' || chr(10) when r.role = s.speaker then '<|assistant|>' || chr(10)
                    else '<|user name=' || r.role || '|>' || chr(10) end as head
            from rows r join speakers s on r.conv_id is not distinct from s.conv_id),
        placed as (
            select *, head || said || '<|end|>' || chr(10) as piece,
                row_number() over (partition by conv_id, speaker, segment, part order by turn nulls first, role, said) as n,
                sum(length(head) + length(said) + 8) over (partition by conv_id, speaker, segment, part order by turn nulls first, role, said rows unbounded preceding) as stop
            from pieces)
        select conv_id, speaker, cast(segment as bigint) as segment, cast(part as bigint) as part, count(*) as n_turns, string_agg(piece, '' order by n) as text,
            coalesce(string_agg(cast(stop - length(said) - 8 as bigint) || '-' || cast(stop as bigint), ',' order by n) filter (where own), '') as mask
        from placed group by conv_id, speaker, segment, part
    """,
    "op13_repair": r"""
        with recursive crcs as (select list(list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, b) order by b) as t from range(256) x(b)),
        named as (select *, dense_rank() over (order by conv_id nulls first) as c, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
        hit as (
            select *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 20 as fault
            from named, crcs),
        damaged as (
            select c, turn, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
                case when fault = 1 then '' when fault = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as said
            from (select *, unnest(range(case when fault = 3 then 2 else 1 end)) from hit where fault <> 0)),
        placed as (select *, row_number() over (partition by c order by turn nulls first, role, said) - 1 as i, left(role, 1) as k from damaged),
        looked as (
            select *, right(rtrim(said, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as mark, row_number() over (partition by c, role, said order by i) as nth,
                lag(k) over (partition by c order by i) as before from placed),
        judged as (select *, case when mark = '' then 'blank' when nth > 1 then 'duplicate' when mark in ('.', '!', '?') then '' else 'truncated' end as fault from looked),
        grammar(p, r, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        inserts(p, q, cost, edits, lines) as (
            select distinct p, p, 0, '', '' from grammar
            union all select p, q, 3, 'I', chr(10) || case r when 'u' then 'user:' else 'assistant:' end from grammar where r <> 's'
            union all values (0, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
        edits(p, q, what, r, cost) as (
            select p, q, 'K', r, 0 from grammar union all select p, q, 'R', r, 3 from grammar where r <> 's' union all select distinct p, p, 'D', '', 4 from grammar),
        paths(c, i, s, cost, audit, lines) as (
            select c, 0::bigint, 0, 0::bigint, '', '' from (select distinct c from named)
            union all
            select c, i, s, best.cost, best.audit, best.lines from (
                select j.c, j.i + 1 as i, e.q as s, min({
                    'cost': x.cost + n.cost + e.cost + case when e.what <> 'D' and j.fault = 'truncated' then 3 else 0 end, 'audit': x.audit || n.edits || e.what,
                    'lines': x.lines || n.lines || case e.what when 'D' then '' else chr(10) || case when e.what = 'K' then j.role when e.r = 'u' then 'user' else 'assistant' end || ':' || j.said end}) as best
                from paths x join judged j on j.c = x.c and j.i = x.i join inserts n on n.p = x.s join edits e on e.p = n.q
                where e.what = 'D' or (j.fault in ('', 'truncated') and (e.what = 'R' or e.r = j.k))
                group by j.c, j.i, e.q)),
        lengths as (select c, count(*) as n from judged group by c),
        ended as (
            select c, min({'cost': x.cost + n.cost, 'audit': x.audit || n.edits, 'lines': x.lines || n.lines}) as best
            from paths x left join lengths l using (c) join inserts n on n.p = x.s where x.i = coalesce(l.n, 0) and n.q in (0, 3) group by c),
        counted as (
            select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
                count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where (before || k) not in ('su', 'ua', 'au')) as illegal
            from judged group by c)
        select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
            coalesce(illegal, 0)::bigint as illegal, best.cost::bigint as cost, best.audit as audit, sha256(substr(best.lines, 2)) as repaired_sha256
        from (select distinct c, conv_id from named) join ended using (c) left join counted using (c)
    """,
    "op2_decontamination": r"""
        with fold as (select 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' as big, 'abcdefghijklmnopqrstuvwxyz' as small),
        docs as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as words from documents, fold),
        items as (select cast(item_id as varchar) as item_id, regexp_extract_all(translate(text, big, small), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark, fold),
        sized as (select item_id, words, least(len(words), 10) as size from items where len(words) > 0),
        item_windows as (select distinct item_id, size, words[i:i + size - 1] as w from (select *, unnest(range(1, len(words) - size + 2)) as i from sized)),
        doc_windows as (select r, i, size, words[i:i + size - 1] as w from (select *, unnest(range(1, len(words) - size + 2)) as i from docs, (select distinct size from sized))),
        found as (select r, i, d.size, item_id from doc_windows d join item_windows t on d.size = t.size and d.w = t.w),
        hit as (select r, count(distinct place) as n_hit from (select r, unnest(range(i, i + size)) as place from found) group by r),
        named as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct r, item_id from found where item_id is not null) group by r)
        select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
        from docs left join hit using (r) left join named using (r)
    """,
    "op6_top_k": """
        with vectors as (
            select row_number() over () as r, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scores as (
            select q.r, q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
            from vectors q join vectors c on len(q.v) = len(c.v) and c.r <> q.r where q.vec_id % 50 = 0),
        ranked as (select *, row_number() over (partition by r order by score desc, vec_id nulls last) as rank from scores)
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
    """,
    "op7_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        m as (select *, max(page_id) over (partition by payload_digest) as top from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 1000 and page_id < top then top end as refers_to
        from m
    """,
    "op9_substring_dedup": r"""
        with docs as (select doc_id, row_number() over () as r, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as words from documents),
        windows as (select r, doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as w from (select *, unnest(range(1, len(words) - 48)) as i from docs where doc_id is not null)),
        firsts as (select w, min(doc_id) as first from windows group by w),
        covered as (select distinct r, unnest(range(i, i + 50)) as place from windows join firsts using (w) where first < doc_id),
        each as (select r, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from docs),
        kept as (select r, string_agg(word, ' ' order by place) as kept, count(*) as n from each anti join covered using (r, place) group by r)
        select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join kept using (r)
    """,
}
