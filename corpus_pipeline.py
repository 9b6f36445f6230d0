"""A corpus pipeline of five operators; each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe_tree, exchange, language_id, order_minhash, string_tiling, suffix_tree

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go."""
    docs = docs.select(*COLUMNS)
    model = language_id.train(docs, "doc_id", "text", "lang")
    return language_id.classify(docs, model, "text").where(~F.col("lang_rejected")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, and of rows that repeat it one."""
    docs = docs.select(*COLUMNS)
    found = order_minhash.near_duplicates(docs).where("id is not null")
    found = exchange.checkpoint(found.groupBy(F.col("id").alias("doc_id")).agg(F.max("kept").alias("keep"), F.count("*").alias("n")).where("keep").select("doc_id", "n"))
    kept = docs.join(found.where("n = 1"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    again = found.where("n > 1")
    return kept if again.isEmpty() else kept.unionByName(docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words within passages of 35 words that occur again anywhere go; the other words stay."""
    found = suffix_tree.substring_dedup(docs.select(*COLUMNS))
    changed = F.col("dedup_n_removed") > 0
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    found = string_tiling.decontaminate(docs.select(*COLUMNS), exchange.read(spark, sf_dir, "benchmark"))
    return found.where(~F.col("leak_contaminated")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers), and the text that they decode to."""
    found = bpe_tree.bpe_encode(docs.select(*COLUMNS), decode=True)
    return found.select(*COLUMNS, F.expr("length(token_ids) div 4").cast("long").alias("n_tokens"), "token_ids", F.col("decoded").cast("string").alias("decoded_text"))


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = exchange.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
