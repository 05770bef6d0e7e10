"""The registered queries of this subpackage: thin calls of the operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, ctph, decontaminate, divergence, language, packing, quality, sharding, simhash, token_counts, topk, warc
from ._common import scratch, table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctph.edited_likeness(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit_text_model(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), 3, 200)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_document_fingerprints, op3_token_counts, op4_sharding, op5_language_id,
        op6_exact_top_k, op7_bpe_round_trip, op8_quality_classifier, op9_warc, op10_best_fit_packing,
        op11_cross_tokenizer_alignment, op12_benchmark_decontamination, op13_source_divergence_audit,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op6_exact_top_k": """
        with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
                   where vec_id is not null and embedding is not null
                     and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
        s as (select q.vec_id as query_id, c.vec_id as vec_id,
                     cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
              from v q join v c on c.vec_id <> q.vec_id and len(q.v) = len(c.v) where q.vec_id % 50 = 0),
        r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
        select query_id, rank, vec_id, score from r where rank <= 5""",
    "op9_warc": """
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
        t as (select *, max(page_id) over (partition by h) as top from p)
        select page_id, cast(strlen(html) as bigint) as payload_bytes,
               list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((cast('0x' || substr(h, cast(i * 5 + 1 as integer), 5) as bigint) >> s) & 31) + 1 as integer), 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
               case when page_id is null or page_id = top then 'response' else 'revisit' end as record_type,
               case when page_id <> top then top end as refers_to
        from t""",
    "op12_benchmark_decontamination": r"""
        with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
        i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
        win as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[cast(j as bigint):cast(j as bigint) + least(len(w), 10) - 1], ' ') as s
                from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as j from i where len(w) > 0)),
        ks as (select distinct k from win),
        sp as (select r, k, j, array_to_string(w[cast(j as bigint):cast(j as bigint) + k - 1], ' ') as s
               from (select r, w, k, unnest(range(1, len(w) - k + 2)) as j from d join ks on len(w) >= k)),
        m as (select r, j, sp.k, item_id from sp join win on sp.s = win.s and sp.k = win.k),
        hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(j, j + k)) as p from m) group by r),
        it as (select r, count(*) as n_items, string_agg(x, ',' order by x) as l from (select distinct r, coalesce(cast(item_id as varchar), '') as x from m) group by r)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join hit using (r) left join it using (r)""",
    "op13_source_divergence_audit": r"""
        with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
        t as (select r, lang, source, unnest(w) as term from d),
        k as (select lang, term, count(*) as c from t group by 1, 2 having count(distinct r) >= 3),
        g as (select distinct lang, source from d),
        v as (select lang, count(term) as v, coalesce(sum(c), 0) as n from (select distinct lang from d) left join k using (lang) group by lang),
        c as (select lang, source, term, count(*) as c from t semi join k using (lang, term) group by 1, 2, 3),
        gn as (select g.lang, g.source, coalesce(sum(c), 0) as n from g left join c using (lang, source) group by 1, 2),
        p as (select gn.lang, gn.source, k.term, coalesce(c.c, 0) as c, 1 + (1000000000::hugeint * (coalesce(c.c, 0) + 1)) // (gn.n + v.v) as p,
                     1 + (1000000000::hugeint * (k.c + 1)) // (v.n + v.v) as q
              from gn join v using (lang) join k using (lang) left join c on c.lang = gn.lang and c.source = gn.source and c.term = k.term),
        s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
              from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
        pr as (select a.lang, a.source, b.source as item, cast(coalesce(value, 0) as bigint) as value
               from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source),
        tm as (select lang, source, term as item, cast((p - q) * (p - q) // q as bigint) as value from p where c > 0 and p > q),
        u as (select lang, source, 'pair' as part, item, value from pr union all select lang, source, 'term', item, value from tm),
        x as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from u)
        select lang, source, part, item, value, rank from x where part = 'pair' or rank <= 200""",
}
