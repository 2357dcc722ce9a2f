"""The registered queries of this package: each operator with its production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.llm import chat, html, lines, near_dup, packing, permutation, pieces, secret_scan, topk, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
), n as (
  select *, row_number() over w as i, count(*) over (partition by conv_id) as k,
    length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '\', '\\'), chr(10), '\n')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 as shown
  from t window w as (partition by conv_id order by turn nulls first, role, text)
), e as (
  select *, sum(shown) over (partition by conv_id order by i) as prefix from n
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(case when role = 'assistant' then length(text) end), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' or i = k then prefix end) as bigint) as formatted_chars,
  count(case when role = 'assistant' or i = k then 1 end) as n_examples
from e group by conv_id
"""


@query(CHAT_SQL)
def op1_prefix_target_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = chat.END + chat.START + "assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.examples(turns))


@query()
def op2_differencing_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


LINES_SQL = """
with l as (
  select doc_id, unnest(range(len(x))) as i, unnest(x) as line from (select doc_id, string_split(coalesce(text, ''), chr(10)) as x from documents)
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), hot as (
  select key, max(doc_id) as keeper from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), m as (
  select k.doc_id, k.i, k.line, hot.key is not null and k.doc_id <> hot.keeper as gone from k left join hot on k.key = hot.key
)
select doc_id, count(*) as n_lines, count(case when gone then 1 end) as n_dropped,
  sha256(coalesce(string_agg(case when not gone then line end, chr(10) order by i), '')) as kept_sha256
from m group by doc_id
"""


@query(LINES_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


TOP_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.vec_id % 20 = 0 and c.vec_id <> q.vec_id
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
from s qualify rank <= 20
"""


@query(TOP_SQL)
def op4_norm_bucketed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = topk.scaled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return topk.top_k(v, v.where("id % 20 = 0"), 20).withColumn("score", F.col("score").cast("long"))


@query()
def op5_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every document, decodes it again from the ids, and compares."""
    out = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_ids", F.crc32("ids").alias("ids_crc32"), "n_bytes", "decoded_sha256", "exact")


@query()
def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return permutation.search(e, e.where("vec_id % 20 = 0"), 20)


@query()
def op9_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.fit(docs, toxicity.training_labels(table(spark, sf_dir, "labels")))


@query()
def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query()
def op8_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.sha2(F.array_join("secrets", "\n"), 256).alias("secrets_sha256"), F.sha2("text", 256).alias("redacted_sha256"))


@query()
def op3_order_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(table(spark, sf_dir, "documents"))
