"""The registered queries of the training-data operators, with their production parameters, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, chat, collocations, linededup, media, mixing, ngramjoin, resampling, secretscan, sharding, sstable, toxicity
from .common import scratch, small_batches

#: Weights of documents of high and of low quality: in the query, where about nine tenths are of high quality before; in the pipeline.
MIX_TARGETS, PIPELINE_TARGETS = {1: 0.6, 0: 0.4}, {1: 0.9, 0: 0.1}
SHARD_BYTES = 2 * 1024 * 1024


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-shards")
    sstable.write_token_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    rows = sstable.read_token_shards(spark, path).select("key", "shard", "shard_start", F.expr("cast(length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return rows.join(sstable.shard_offsets(spark, path), "shard").select(F.col("key").alias("doc_id"), (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.parse(chat.format_chats(chat.turn_events(rows.unionByName(extra)))))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), removed="n_removed")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = mixing.document_rates(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), MIX_TARGETS)
    return rates.select("doc_id", "n_tokens", F.round(F.get("p", F.lit(0)), 6).alias("p_high"), F.round("rate", 6).alias("rate"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "media")
    media.write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return media.digests(media.with_features(media.read_archives(spark, path)))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.with_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARD_BYTES)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "group_id", "n_links", "first")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_shards": prepared(op1_token_shards),
    "op2_ann": prepared(op2_ann),
    "op3_toxicity": prepared(op3_toxicity),
    "op4_chat": prepared(op4_chat),
    "op5_bpe": prepared(op5_bpe),
    "op6_line_dedup": prepared(op6_line_dedup),
    "op7_mixing": prepared(op7_mixing),
    "op8_media": prepared(op8_media),
    "op9_sharding": prepared(op9_sharding),
    "op10_ngram_join": prepared(op10_ngram_join),
    "op11_collocations": prepared(op11_collocations),
    "op12_secrets": prepared(op12_secrets),
    "op13_resampling": prepared(op13_resampling),
}

ORACLE_SQL: dict[str, str] = {
    "op2_ann": ann.ORACLE_SQL,
    "op4_chat": chat.ORACLE_SQL,
    "op7_mixing": mixing.oracle_sql(MIX_TARGETS),
    "op9_sharding": sharding.ORACLE_SQL.format(limit=SHARD_BYTES),
    "op11_collocations": collocations.ORACLE_SQL,
    "op13_resampling": resampling.ORACLE_SQL,
}
