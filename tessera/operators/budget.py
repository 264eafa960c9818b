"""Prefix budgets over ordered shards, without a global single-task window.

Running sums go in two steps: totals of shards are summed in shard order (a row a shard), then each
shard continues from its base. A shard is a file of bounded size, so no window grows with the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, value: str, group: list[str], shard: str, order: list[str]) -> DataFrame:
    """Adds ``rank_before`` and ``sum_before``: rows and sum of ``value`` before each row of its group."""
    totals = df.groupBy(*group, shard).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_s"))
    earlier = W.partitionBy(*group).orderBy(shard).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*group, shard, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"))
    own = W.partitionBy(*group, shard).orderBy(*order)
    rows = df.join(base, [*group, shard])
    sums = F.coalesce(F.sum(value).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"rank_before": F.col("_n0") + F.row_number().over(own) - 1, "sum_before": F.col("_s0") + sums}).drop("_n0", "_s0")


def char_cap(df: DataFrame, cap: int, text: str = "text") -> DataFrame:
    """Texts cut to ``cap`` code points."""
    return df.withColumn(text, F.substring(text, 1, cap))


def bounded_prefix(docs: DataFrame, max_documents: int, max_characters: int, cap: int) -> DataFrame:
    """Per split and in order: capped documents until either budget is used up; the last is cut to fit exactly.

    ``docs``: split, shard_index, doc_id, text.
    """
    capped = char_cap(docs, cap).withColumn("chars", F.length("text"))
    seen = running(capped, "chars", ["split"], "shard_index", ["doc_id"])
    kept = seen.where((F.col("rank_before") < max_documents) & (F.col("sum_before") < max_characters))
    return kept.withColumn("text", F.expr(f"substring(text, 1, cast({max_characters} - sum_before as int))")).select("split", "shard_index", "doc_id", "text")


def bounded_bpe_corpus(docs: DataFrame, max_documents: int, max_characters: int, cap: int) -> DataFrame:
    """As ``bounded_prefix``, but nothing follows a document that the character budget cut; zero budgets give nothing."""
    return bounded_prefix(docs, max_documents, max_characters, cap) if max_documents > 0 and max_characters > 0 else docs.limit(0).select("split", "shard_index", "doc_id", "text")
