"""The operators as queries over the corpus tables, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bit_sliced, packing, pii, piece_codec, sharding, simhash, token_transducer, toxicity, url_filter, weighted_sampling
from .common import read_table

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return token_transducer.token_counts(docs, tokenizer_path("word_bpe_49k.json"))


def op2_top_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return bit_sliced.top_inner_products(vectors, F.col("vec_id") % 50 == 0)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read_table(spark, sf_dir, "pages"), RULES)


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op6_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shards(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    coded = piece_codec.encode_documents(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_xxh64"), F.char_length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, ~toxicity.is_held_out("doc_id"))
    rows = docs.select("doc_id", F.coalesce(toxicity.is_held_out("doc_id"), F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprints(read_table(spark, sf_dir, "documents"))


def listed(spans: str):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.detect(docs, pii.train(docs))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_top_inner_products, op3_best_fit_packing, op4_url_filter, op5_simhash_near_duplicates, op6_feistel_sharding, op7_sentencepiece_codec, op8_toxicity, op9_weighted_fingerprints, op10_personal_data)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


OP2_SQL = """
with quantised as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as query_id, b.vec_id,
    cast(list_inner_product(cast(a.q as double[]), cast(b.q as double[])) as bigint) as score
  from quantised a join quantised b on a.vec_id <> b.vec_id
  where a.vec_id % 50 = 0
), ranked as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score
  from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_inner_products": OP2_SQL}
