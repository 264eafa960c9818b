"""Tokenized datasets: written by split and shard, with a manifest that later readers check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .manifests import overlap, token_width, totals

Encoder = Callable[[DataFrame], DataFrame]


class Unsound(ValueError):
    """A dataset that isn't what its manifest says."""


def write(docs: DataFrame, encode: Encoder, path: str, vocab_size: int) -> None:
    """Encodes ``docs`` (split, shard_index, doc_id, text) and publishes payload and manifest under ``path``.

    One pass: the manifest is an aggregate of what was written. The payload comes first, so a directory
    with a manifest is whole. A source in both splits is an error.
    """
    spark = docs.sparkSession
    ids = encode(docs.select("doc_id", "text"))
    rows = docs.select("split", "shard_index", "doc_id").join(ids.select("doc_id", "ids"), "doc_id")
    rows.repartition("split", "shard_index").sortWithinPartitions("split", "shard_index", "doc_id").write.partitionBy("split", "shard_index").parquet(f"{path}/tokens")
    there = spark.read.parquet(f"{path}/tokens")
    if not overlap(there.select("split", F.col("doc_id").alias("source")).distinct()).isEmpty():
        raise Unsound("a document is in both splits")
    manifest(there, vocab_size).write.parquet(f"{path}/manifest")


def manifest(rows: DataFrame, vocab_size: int) -> DataFrame:
    """Documents, tokens, bytes, and a content identity by shard, by split and overall."""
    each = rows.select("split", "shard_index", "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")).cast("binary"), 256).alias("h"))
    sums = totals(each, vocab_size)
    # order-free, so any partitioning gives the same: the XOR of documents' hashes
    content = each.groupBy("split", "shard_index").agg(F.bit_xor(F.conv(F.substring("h", 1, 15), 16, 10).cast("long")).alias("content"))
    return sums.join(content, ["split", "shard_index"], "left").withColumn("width", F.lit(token_width(vocab_size)))


def faults(path: str, spark: SparkSession, vocab_size: int) -> DataFrame:
    """Shards whose tokens aren't what the manifest says, and ids outside the vocabulary; none in a sound dataset."""
    rows = spark.read.parquet(f"{path}/tokens")
    said, found = spark.read.parquet(f"{path}/manifest"), manifest(rows, vocab_size)
    names = [c for c in found.columns if c not in ("split", "shard_index")]
    both = said.join(found.select("split", "shard_index", *[F.col(c).alias(f"_{c}") for c in names]), ["split", "shard_index"], "full_outer")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    wrong = both.where(~same).select("split", "shard_index", F.lit("differs from the manifest").alias("fault"))
    outside = rows.where(F.exists("ids", lambda x: (x < 0) | (x >= vocab_size))).select("split", F.col("shard_index").cast("int").alias("shard_index"), F.lit("an id is outside the vocabulary").alias("fault")).distinct()
    return wrong.union(outside)


def read(spark: SparkSession, path: str, vocab_size: int) -> DataFrame:
    """``split, shard_index, doc_id, ids`` of a dataset that was checked first."""
    if (bad := faults(path, spark, vocab_size).orderBy(F.desc("shard_index")).first()) is not None:
        raise Unsound(f"shard {bad['shard_index']} of {bad['split']}: {bad['fault']}")
    return spark.read.parquet(f"{path}/tokens").select("split", "shard_index", "doc_id", "ids")


def retokenised(stored: DataFrame, docs: DataFrame, encode: Encoder) -> DataFrame:
    """Documents whose stored ids aren't what encoding them again gives."""
    again = encode(docs.select("doc_id", "text")).select("doc_id", F.col("ids").alias("again"))
    return stored.join(again, "doc_id", "full_outer").where(~F.col("ids").eqNullSafe(F.col("again"))).select("doc_id")
