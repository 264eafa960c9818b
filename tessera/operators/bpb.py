"""Bits per byte and its coverage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formulas import divided

#: Control tokens, whose ids follow the 256 bytes (fixed values).
SPECIALS = ("<|bos|>", "<|user_start|>", "<|user_end|>", "<|assistant_start|>", "<|assistant_end|>", "<|python_start|>", "<|python_end|>", "<|output_start|>", "<|output_end|>")


def byte_lengths(spark: SparkSession) -> DataFrame:
    """``token_id, n_bytes`` of the byte vocabulary: 1 for a byte, 0 for a control token; 265 rows."""
    return spark.range(256 + len(SPECIALS)).select(F.col("id").cast("int").alias("token_id"), F.when(F.col("id") < 256, 1).otherwise(0).alias("n_bytes"))


def with_bytes(losses: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``n_bytes`` of the target; the vocabulary is small by nature, so it is broadcast."""
    return losses.join(F.broadcast(lengths.withColumnRenamed("token_id", "target")), "target", "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))


def counted() -> Column:
    """Targets that count: not ignored, not masked, and of at least one byte."""
    return (F.col("target") >= 0) & F.col("mask") & (F.col("n_bytes") > 0)


def masked_bpb(losses: DataFrame, lengths: DataFrame, group: list[str]) -> DataFrame:
    """Nats, tokens, bytes and bits per byte of counted targets; ``losses``: target, loss_nats, mask."""
    kept = with_bytes(losses, lengths).where(counted())
    sums = kept.groupBy(*group).agg(F.sum("loss_nats").alias("nats"), F.count(F.lit(1)).alias("tokens"), F.sum("n_bytes").cast("long").alias("bytes"))
    return sums.withColumn("bpb", divided(F.col("nats"), F.col("bytes") * math.log(2)))


def source_coverage(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Documents, tokens and bytes of all tokens of the source; ``docs``: doc_id, ids."""
    each = docs.select("doc_id", F.explode_outer("ids").alias("target"))
    return with_bytes(each, lengths).agg(F.countDistinct("doc_id").alias("documents"), F.count("target").alias("tokens"), F.sum("n_bytes").cast("long").alias("bytes"))


def retention(coverage: DataFrame) -> DataFrame:
    """Adds what was left out and the share that was kept; ``coverage``: unique_count, source_count."""
    return coverage.withColumns({"discarded": F.col("source_count") - F.col("unique_count"), "retained": divided(F.col("unique_count"), F.col("source_count"))})


def unique_prefix(rows: DataFrame) -> DataFrame:
    """Tokens that were seen at least once: the longest prefix of each document; ``rows``: doc_id, prefix."""
    return rows.groupBy("doc_id").agg(F.max("prefix").alias("longest")).agg(F.count(F.lit(1)).alias("documents"), F.sum("longest").cast("long").alias("unique_tokens"))


def mask_targets(targets: str | Column, mask: str | Column) -> Column:
    """Targets with -1 wherever the mask is false."""
    return F.zip_with(targets, mask, lambda t, m: F.when(m, t).otherwise(-1))


def weighted_loss(batches: DataFrame, group: list[str]) -> DataFrame:
    """Loss over all targets: the mean of batch losses weighted by their targets."""
    return batches.groupBy(*group).agg(F.sum("n_targets").cast("long").alias("targets"), divided(F.sum(F.col("loss") * F.col("n_targets")), F.sum("n_targets")).alias("loss"))
