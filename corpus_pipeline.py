"""The corpus pipeline: toxicity, line dedup, near copies, mixing and encoding, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moteflow.llm import bpe, linededup, mixing, ngramjoin, toxicity
from moteflow.llm.common import scratch, small_batches
from moteflow.llm.queries import PIPELINE_TARGETS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from labelled rows that are not held out and are still there."""
    small_batches(spark)
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines go from the texts; n_chars follows the text. No document goes."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that similarities of 0.8 or more join, the document with the smallest id stays."""
    small_batches(spark)
    return ngramjoin.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; those of the scarcer quality repeat as their rates say."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), PIPELINE_TARGETS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and token_ids of each row; the ids decode to the row's text."""
    small_batches(spark)
    rows = bpe.with_token_ids(docs.select("doc_id", "source", "text")).drop("text")
    return rows.select("doc_id", "source", F.expr("cast(length(token_ids) / 4 as long)").alias("n_tokens"), "token_ids")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("near copies", drop_near_copies), ("mixing", mix_sources), ("encoding", encode)]

#: No SQL: a trained model scores the texts and tokens follow a merge list. tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
