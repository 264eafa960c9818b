"""Manifests of tokenized datasets: totals, metrics and consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_width(vocab_size: int) -> int:
    """Bytes an id: two as long as every id and the size itself fit."""
    return 2 if vocab_size <= 65_535 else 4


def totals(docs: DataFrame, vocab_size: int) -> DataFrame:
    """Tokens, documents and bytes by shard, by split and overall; ``docs``: split, shard_index, n_tokens."""
    out = docs.rollup("split", "shard_index").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").cast("long").alias("tokens"))
    return out.select(F.coalesce("split", F.lit("total")).alias("split"), F.coalesce("shard_index", F.lit(-1)).alias("shard_index"), "documents", "tokens", (F.col("tokens") * token_width(vocab_size)).alias("bytes"))


def as_metrics(row: DataFrame, prefix: str) -> DataFrame:
    """Columns as (name, value) rows; nulls are left out."""
    names = row.columns
    pairs = ", ".join(f"'{prefix}{n}', cast(`{n}` as double)" for n in names)
    return row.selectExpr(f"stack({len(names)}, {pairs}) as (name, value)").where("value is not null")


def preparation_metrics(docs: DataFrame, vocab_size: int) -> DataFrame:
    """Named scalars of a prepared dataset; ``docs``: split, shard_index, n_tokens, text."""
    def of(split: str) -> Column:
        return F.col("split") == split

    return as_metrics(docs.agg(
        F.countDistinct(F.when(of("train"), F.col("shard_index"))).alias("train_shards"), F.count_if(of("train")).alias("train_documents"), F.coalesce(F.sum(F.when(of("train"), F.col("n_tokens"))), F.lit(0)).alias("train_tokens"),
        F.countDistinct(F.when(of("val"), F.col("shard_index"))).alias("validation_shards"), F.count_if(of("val")).alias("validation_documents"), F.coalesce(F.sum(F.when(of("val"), F.col("n_tokens"))), F.lit(0)).alias("validation_tokens"),
        F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text")).alias("utf8_bytes"), (F.sum("n_tokens") * token_width(vocab_size)).alias("payload_bytes"),
    ), "data/")


def reused(sources: DataFrame) -> DataFrame:
    """Sources that occur in more than one place; ``sources``: split, source."""
    return sources.groupBy("source").agg(F.countDistinct("split").alias("splits"), F.count(F.lit(1)).alias("uses")).where("uses > 1")


def overlap(sources: DataFrame) -> DataFrame:
    """Sources that both splits use; must be none in a sound dataset."""
    return sources.where("split = 'train'").select("source").intersect(sources.where("split = 'val'").select("source"))


def unreferenced(present: DataFrame, referenced: DataFrame) -> DataFrame:
    """Payloads that are there but that no manifest names."""
    return present.join(referenced, "name", "left_anti")


def reconciled(manifest: DataFrame, statistics: DataFrame) -> DataFrame:
    """Document counts of two sources side by side, and whether they agree; a missing side agrees with nothing."""
    m, s = manifest.withColumnRenamed("documents", "manifest_documents"), statistics.withColumnRenamed("documents", "statistics_documents")
    return m.join(s, ["split", "shard_index"], "full_outer").withColumn("agrees", F.col("manifest_documents").eqNullSafe(F.col("statistics_documents")))
