"""Strides, plans, spans and lookups over shards and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .budget import running


def select_train_prefix(docs: DataFrame, shards: int) -> DataFrame:
    """The first ``shards`` training shards by numeric index, and the validation shard."""
    train = docs.where("split = 'train'").select("shard_index").distinct().withColumn("file_rank", F.row_number().over(W.orderBy("shard_index")) - 1)  # a row a shard
    return docs.join(F.broadcast(train.where(F.col("file_rank") < shards)), "shard_index", "left").where("split = 'val' or file_rank is not null").drop("file_rank")


def stride(docs: DataFrame, start: int, step: int) -> DataFrame:
    """Every ``step``-th training shard from ``start``, as a rank of several readers takes them."""
    ranks = docs.where("split = 'train'").select("shard_index").distinct().withColumn("file_rank", F.row_number().over(W.orderBy("shard_index")) - 1)
    mine = ranks.where((F.col("file_rank") >= start) & (F.pmod(F.col("file_rank") - start, F.lit(step)) == 0))
    return docs.join(mine, "shard_index")


def shard_plan(spark: SparkSession, train_shards: int, validation_index: int | None) -> DataFrame:
    """The shards to fetch: 0 to n - 1, and the validation shard; names are padded to five digits."""
    if validation_index is not None and validation_index < train_shards:
        raise ValueError("the validation shard is among the training shards")
    if not train_shards and validation_index is None:
        raise ValueError("nothing to fetch")
    plan = spark.range(train_shards).select(F.col("id").cast("int").alias("shard_index"), F.lit("train").alias("split"))
    if validation_index is not None:
        plan = plan.union(spark.range(1).select(F.lit(validation_index).alias("shard_index"), F.lit("val").alias("split")))
    return plan.withColumn("file_name", F.concat(F.lit("shard_"), F.lpad(F.col("shard_index").cast("string"), 5, "0"), F.lit(".parquet")))


def indexed(docs: DataFrame, shard: str, row: str) -> DataFrame:
    """Adds ``row_index``, which counts over all shards in order, from 0."""
    return running(docs.withColumn("_one", F.lit(1)).withColumn("_all", F.lit(0)), "_one", ["_all"], shard, [row]).withColumnRenamed("rank_before", "row_index").drop("sum_before", "_one", "_all")


def indexed_within(docs: DataFrame, group: str, row: str, name: str) -> DataFrame:
    """Adds the number of a row in its group, from 0."""
    return docs.withColumn(name, (F.row_number().over(W.partitionBy(group).orderBy(row)) - 1).cast("long"))


def logical_slice(indexed_rows: DataFrame, start: int, stop: int, step: int) -> DataFrame:
    """Rows ``start:stop:step`` of an order given by ``row_index``."""
    at = F.col("row_index")
    return indexed_rows.where((at >= start) & (at < stop) & (F.pmod(at - start, F.lit(step)) == 0))


def spans(counts: DataFrame) -> DataFrame:
    """Half-open token spans of documents in their shard; ``counts``: shard_index, doc_id, n_tokens."""
    order = W.partitionBy("shard_index").orderBy("doc_id")
    stop = F.sum("n_tokens").over(order.rowsBetween(W.unboundedPreceding, 0))
    return counts.select("shard_index", "doc_id", (stop - F.col("n_tokens")).alias("start_tok"), stop.alias("stop_tok"))


def valid_starts(counts: DataFrame, length: int) -> DataFrame:
    """Per shard, how many windows of ``length`` + 1 tokens begin there, and how many before it; a row a shard."""
    per = counts.groupBy("shard_index").agg(F.greatest(F.sum("n_tokens") - length, F.lit(0)).alias("starts"))
    through = F.sum("starts").over(W.orderBy("shard_index"))
    return per.select("shard_index", (through - F.col("starts")).alias("first_offset"), through.alias("end_offset"))


def offset_to_shard(offsets: DataFrame, starts: DataFrame) -> DataFrame:
    """The shard and local start of global offsets; offsets beyond the last start are left out.

    Offsets and shards meet in bins as wide as a mean shard, so the join is on a key: shards fill at most twice as many bins as there are shards.
    """
    width = starts.agg(F.greatest(F.ceil(F.max("end_offset") / F.count(F.lit(1))), F.lit(1)).cast("long").alias("width"))  # one row
    bin_of = lambda c: F.floor(c / F.col("width"))
    own = starts.where("first_offset < end_offset").crossJoin(F.broadcast(width))
    own = own.withColumn("bin", F.explode(F.sequence(bin_of(F.col("first_offset")), bin_of(F.col("end_offset") - 1)))).drop("width")
    met = offsets.crossJoin(F.broadcast(width)).withColumn("bin", bin_of(F.col("global_offset"))).join(own, "bin")
    hit = (F.col("global_offset") >= F.col("first_offset")) & (F.col("global_offset") < F.col("end_offset"))
    return met.where(hit).select("global_offset", "shard_index", (F.col("global_offset") - F.col("first_offset")).alias("local_offset"))
