"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import alignment, byte_bpe, embedding_dedup, html_text, language_id, mixing, packing, simhash, substring_dedup, suffix_dedup, token_store, topk_search, whitening
from .common import table


def op1_substring_dedup(spark, sf_dir):
    found = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), words=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash(spark, sf_dir):
    found = simhash.simhash_groups(table(spark, sf_dir, "documents"), budget=2, width=3, seed=42)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_language_id(spark, sf_dir):
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3).drop("source")


def op6_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.expr("vec_id % 100 = 0"), k=10, scale=1024)


def op7_embedding_dedup(spark, sf_dir):
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"), threshold=0.93)


def op8_token_store(spark, sf_dir):
    return token_store.token_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op9_byte_bpe(spark, sf_dir):
    return byte_bpe.bpe_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_html_text(spark, sf_dir):
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op11_token_alignment(spark, sf_dir):
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.withColumn("groups_sha256", digest).drop("groups")


def op12_best_fit_packing(spark, sf_dir):
    return packing.packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=0, capacity=2048)


def op13_whitening(spark, sf_dir):
    found = whitening.whiten(table(spark, sf_dir, "embeddings"), most=16, scale=64, shift=1_000_000)
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def queries():
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


def oracle_sql():
    return {"op1_substring_dedup": OP1_SQL, "op4_suffix_dedup": OP4_SQL, "op6_topk_search": OP6_SQL, "op7_embedding_dedup": OP7_SQL}


OP1_SQL = """
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents
), g as (
  select doc_id, i, array_to_string(w[i:i + 12], ' ') as s
  from (select doc_id, w, unnest(generate_series(1, len(w) - 12)) as i from d where len(w) >= 13)
), m as (
  select s, min(doc_id) as least from g group by s
), gone as (
  select distinct doc_id, unnest(generate_series(i, i + 12)) as i from g join m using (s) where least < doc_id
), k as (
  select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as i from d where len(w) > 0
), kept as (
  select k.doc_id, string_agg(k.word, ' ' order by k.i) as t from k left join gone using (doc_id, i) where gone.i is null group by 1
), n as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n.n, 0) as bigint) as n_removed, sha256(coalesce(kept.t, '')) as kept_sha256
from d left join kept using (doc_id) left join n using (doc_id)
"""

_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
OP6_SQL = f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v from embeddings where {_FINITE}
), s as (
  select q.vec_id as query_id, v.vec_id, cast(list_inner_product(q.v, v.v) as bigint) as score
  from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id
)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10
"""
OP7_SQL = f"""
with recursive v as (
  select vec_id, label, cast(embedding as double[]) as v from embeddings
  where label is not null and {_FINITE} and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.93
), r as (
  select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a
), c as (select a as vec_id, min(b) as component_id from r group by 1),
n as (select a as vec_id, count(*) as n_links from l group by 1)
select e.vec_id, cast(coalesce(n.n_links, 0) as bigint) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join c using (vec_id) left join n using (vec_id)
"""
OP4_SQL = """
with d as (
  select doc_id, hex(encode(coalesce(text, ''))) as h from documents
), g as (
  select doc_id, i, h[2 * i + 1:2 * i + 200] as s
  from (select doc_id, h, unnest(generate_series(0, len(h) // 2 - 100)) as i from d where len(h) >= 200)
), r as (
  select doc_id, i, row_number() over (partition by md5(s) order by doc_id, i) > 1 as later from g
), e as (
  select doc_id, i as x, 1 as step from r where later union all select doc_id, i + 100, -1 from r where later
), c as (
  select doc_id, x, sum(sum(step)) over (partition by doc_id order by x) as depth from e group by doc_id, x
), m as (
  select doc_id, x, depth, lag(depth, 1, 0) over (partition by doc_id order by x) as before from c
), b as (
  select doc_id, x, before = 0 as opens from m where (before = 0) <> (depth = 0)
), spans as (
  select doc_id, x as a, nxt as z from (select *, lead(x) over (partition by doc_id order by x) as nxt from b) where opens
), l as (
  select doc_id, list(a order by a) as a, list(z order by a) as z, sum(z - a) as lost, count(*) as n from spans group by doc_id
)
select d.doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(l.lost, 0) as bigint) as n_removed, cast(coalesce(l.n, 0) as bigint) as n_spans,
  sha256(unhex(case when l.a is null then d.h else array_to_string(list_transform(list_zip(list_prepend(0, l.z), list_append(l.a, len(d.h) // 2)),
    lambda p: d.h[2 * p[1] + 1:2 * p[2]]), '') end)) as kept_sha256
from d left join l using (doc_id)
"""
