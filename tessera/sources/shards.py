"""Text shards and their split into training and validation data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; only Spark's readers open the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(shard_index: Column, validation_index: int) -> Column:
    """One fixed shard validates; the others train."""
    return F.when(shard_index == validation_index, F.lit("val")).otherwise(F.lit("train"))


def with_split(docs: DataFrame, key: str, shards: int) -> DataFrame:
    """Adds ``shard_index`` and ``split`` to a table that isn't sharded: key modulo the number of shards."""
    index = F.pmod(F.col(key), F.lit(shards)).cast("int")
    return docs.withColumns({"shard_index": index, "split": split_of(index, shards - 1)})
