"""The queries of the training-data operators: each applies one operator, with production parameters, to its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, license_scan, linededup, media, mixing, neardup, pii, sharding, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """Where the public tokenizer's file is on the driver; executors get its text from there."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "similarity", "word_start", "word_end")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "license", "coverage", "matched_words", "word_start", "word_end", "char_start", "char_end")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.select("doc_id", F.col("_size").alias("size"), crc.alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neardup.classes(_table(spark, sf_dir, "documents"), words=3, radius=2)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.encode_corpus(_table(spark, sf_dir, "documents"), tokenizer_path())
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, where=toxicity.learns_from)
    scored = toxicity.score(docs, model)
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (op1_decontaminate, op2_license_scan, op3_mixing, op4_sharding, op5_media, op6_simhash, op7_tokens, op8_line_dedup, op9_toxicity, op10_pii)
    return {f.__name__: f for f in fs}
