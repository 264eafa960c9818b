"""Cached shards: what is in a directory, and whether it is what a manifest says."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = r"^shard_([0-9]+)\.parquet$"


def listed(spark: SparkSession, directory: str) -> DataFrame:
    """``file_name, shard_index, n_bytes`` of shards, by number; two files of one number raise when read."""
    files = spark.read.format("binaryFile").load(directory).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"))
    known = files.where(F.col("file_name").rlike(NAME)).withColumn("shard_index", F.regexp_extract("file_name", NAME, 1).cast("int"))
    one = known.groupBy("shard_index").agg(F.min("file_name").alias("file_name"), F.min("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n"))
    sole = F.when(F.col("n") == 1, F.col("shard_index")).otherwise(F.raise_error(F.concat(F.lit("several files for shard "), F.col("shard_index").cast("string"))))
    return one.select("file_name", sole.alias("shard_index"), "n_bytes")


def identities(spark: SparkSession, directory: str) -> DataFrame:
    """``file_name, n_bytes, identity`` of all files, the identity being the SHA-256 of their bytes."""
    files = spark.read.format("binaryFile").load(directory)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("identity"))


def faults(present: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed; none in a sound cache. Both: file_name, n_bytes, identity."""
    m = manifest.select("file_name", F.col("n_bytes").alias("m_bytes"), F.col("identity").alias("m_identity"))
    both = present.join(m, "file_name", "full_outer")
    fault = F.when(F.col("identity").isNull(), "missing").when(F.col("m_identity").isNull(), "unexpected").when(~(F.col("n_bytes").eqNullSafe(F.col("m_bytes")) & (F.col("identity") == F.col("m_identity"))), "changed")
    return both.select("file_name", fault.alias("fault")).where("fault is not null")


def text_column(df: DataFrame, name: str | None = None) -> DataFrame:
    """The one text column, by name or as the only string column; nulls raise when read, empty texts stay."""
    strings = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    own = [name] if name is not None else strings
    if len(own) != 1 or df.columns.count(own[0]) != 1 or own[0] not in strings:
        raise ValueError(f"expected one text column, found {strings}")
    return df.select(F.when(F.col(own[0]).isNotNull(), F.col(own[0])).otherwise(F.raise_error(F.lit("null text"))).alias("text"))
