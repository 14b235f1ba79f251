"""Registered queries of the operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, extract, lexical, licenses, lm_scores, mixing, nearest, neardup, quality, repair, sharding, token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).drop("text")


OP2_SQL = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as k
  from documents),
src as (select source, sum(size)::bigint as source_size from sized group by 1),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w,
             source_size::double * 2 as cap, (sum(source_size) over ())::double * 1.5 as share from src),
c as (select *, (share - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0))
             / sum(w) over (o rows between current row and unbounded following) >= cap / w as capped
      from w window o as (order by cap / w, source nulls last)),
t as (select source, source_size,
             case when capped then cap else (share - sum(case when capped then cap else 0 end) over ())
               / sum(case when capped then 0 else w end) over () * w end as target from c),
b as (select *, floor(target + 0.5)::bigint as budget from t),
p as (select s.doc_id, s.size, b.source_size, b.target, b.budget,
             case when b.source_size > 0 then b.budget // b.source_size else 0 end as epochs,
             (sum(s.size) over (partition by s.source order by k, doc_id, size rows unbounded preceding) - s.size)::bigint as first
      from sized s join b on s.source is not distinct from b.source)
select doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - first)))::bigint as taken
from p
"""


@query("op2_mix_sources", OP2_SQL)
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: Shards of the production layout.
N_SHARDS = 256


@query("op6_shard_table")
def op6_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", sharding.shard_names(N_SHARDS)).select("doc_id", "slot", "shard")


OP9_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n as (select *, coalesce(lag(role) over o, 'start') || '>' || role as step, lead(role) over o is null as final
      from t window o as (partition by conv_id order by turn nulls first, role, text)),
e as (select *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|'))
               + length('<|turn|>') + length('<|text|>') + length('<|end|>') + 1 as formatted from n)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(formatted)::bigint as formatted_chars,
       bool_and(step in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')
                and (not final or role = 'assistant')) as is_valid
from e group by conv_id
"""


@query("op9_chat_format", OP9_SQL)
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    kinds = dict(conv.dtypes)
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = chat.format_conversations(conv.union(extra))
    back = out.select("conv_id", "is_valid", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
                      chat.loss_text(F.col("segments")).alias("loss"))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss").cast("bigint").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("bigint").alias("formatted_chars"), "is_valid")


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs).drop("text")


#: The vocabulary file of the production tokenizer.
TOKENIZER = "word_bpe_49k.json"


@query("op4_token_binary")
def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, public_tokenizers.path(TOKENIZER))


@query("op7_decontaminate")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text")).drop("text")


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, shingle=2)


@query("op8_extract_content")
def op8_extract_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op5_gru_score")
def op5_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP11_SQL = r"""
with words as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
d as (select r, doc_id, ts, len(ts)::bigint as n from words where len(ts) > 0),
c as (select count(*)::bigint as all_docs, sum(n)::bigint as all_words from d),
tf as (select r, t, count(*)::bigint as tf from (select r, unnest(ts) as t from d) group by 1, 2),
w as (select t, floor(1000 * ln((2 * all_docs + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, c group by t, all_docs),
q as (select i, item_id, t, count(*)::bigint as times from (
        select row_number() over () as i, item_id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark) group by 1, 2, 3),
s as (select i, item_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * all_docs) // all_words))))::bigint as score
      from q join tf using (t) join w using (t) join d using (r), c group by 1, 2, 3),
k as (select item_id, row_number() over (partition by i order by score desc, doc_id nulls last) as rank, doc_id, score
      from s join d using (r) where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 10
"""


@query("op11_ranked_search", OP11_SQL)
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents").select("doc_id", "text"),
                                 table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(conv, repair.damaged(conv))


@query("op12_nearest_neighbours")
def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)
