"""Evaluation runs put together from smaller operators: tokenizers, bits per byte, tasks, comparisons."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formulas import divided
from . import bpb, runs, scoring

Encoder = Callable[[DataFrame], DataFrame]

#: Short texts of kinds that corpora lack; our own words.
SAMPLES = {
    "prose": "A small boat left the harbour at dawn, and by noon no one could see it.",
    "code": "def area(r):\n    return 3.14159 * r ** 2\n\nfor k in range(3):\n    print(area(k))\n",
    "numbers": "In 1987, 12,450 of 98,001 tickets (12.7 %) were sold for 3.50 each.",
    "scripts": "Grüße, Καλημέρα, Привет, 你好, こんにちは, 안녕하세요",
    "symbols": "a² + b² = c²; ∑ x_i ≤ ∫ f(t) dt 🚀 — “quoted”",
}


def corpora(spark: SparkSession, bounded: dict[str, DataFrame]) -> DataFrame:
    """``category, doc_id, text``: the samples, and bounded collections by name."""
    out = spark.createDataFrame([(k, i, v) for i, (k, v) in enumerate(SAMPLES.items())], "category string, doc_id long, text string")
    for name, docs in bounded.items():
        out = out.union(docs.select(F.lit(name).alias("category"), "doc_id", "text"))
    return out


def tokenizer_report(texts: DataFrame, encode: Encoder, decode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """By category: bytes, tokens, bytes a token, and whether decoding gives the texts again.

    ``encode`` turns ``doc_id, text`` into ``doc_id, ids``; ``decode`` turns that into ``doc_id, text``.
    """
    numbered = texts.withColumn("key", F.xxhash64("category", "doc_id"))
    ids = encode(numbered.select(F.col("key").alias("doc_id"), "text"))
    back = decode(ids).select(F.col("doc_id").alias("key"), F.col("text").alias("again"))
    joined = numbered.join(ids.select(F.col("doc_id").alias("key"), F.size("ids").alias("n")), "key").join(back, "key")
    return joined.groupBy("category").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("n").alias("tokens"), F.bool_and(F.col("text") == F.col("again")).alias("round_trip")).withColumn("bytes_per_token", divided(F.col("bytes"), F.col("tokens")))


def assistant_bpb(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """Bits per byte of supervised assistant tokens; ``rows``: labels and losses (arrays), n_conversations."""
    each = rows.select(F.explode(F.arrays_zip("labels", "losses")).alias("x")).select(F.col("x.labels").alias("target"), F.col("x.losses").alias("loss_nats"), F.lit(True).alias("mask"), F.lit(1).alias("_g"))
    return bpb.masked_bpb(each, lengths, ["_g"]).drop("_g").crossJoin(F.broadcast(rows.agg(F.sum("n_conversations").alias("conversations"))))


def task_accuracy(results: DataFrame, baselines: DataFrame, most: int | None = None) -> DataFrame:
    """Accuracy and centered score of each task, of its first ``most`` examples by order if bounded; ``results``: task, example, correct."""
    first = results if most is None else results.withColumn("_r", F.row_number().over(W.partitionBy("task").orderBy("example"))).where(F.col("_r") <= most).drop("_r")
    return scoring.centered_scores(scoring.accuracy(first, ["task"]), baselines).withColumn("bounded", F.lit(most is not None))


def compared_runs(log: DataFrame, config: DataFrame, metric: str, identity: list[str]) -> DataFrame:
    """Runs with their latest metric, rank, change against the first by name, and blockers.

    ``config``: run, status, max_steps, evaluated, complete and the identity columns. Ranks are given only
    if no run is blocked and all share one identity; equal values share a rank. A row a run.
    """
    values = runs.latest(log.where(F.col("name") == metric)).select("run", "value")
    steps = log.groupBy("run").agg(F.max("step").alias("latest_step"))
    why = runs.blockers(F.col("status"), F.col("latest_step"), F.col("max_steps"), F.col("evaluated"), F.col("complete"))
    joined = config.join(steps, "run", "left").join(values, "run", "left").withColumn("blockers", why)
    every = W.partitionBy()  # a row a run
    rankable = F.bool_and((F.size("blockers") == 0) & F.col("value").isNotNull()).over(every) & (F.size(F.collect_set(F.to_json(F.struct(*identity))).over(every)) == 1)
    base = F.first("value").over(W.orderBy("run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rank = F.when(rankable, F.rank().over(W.orderBy("value")))
    return joined.select("run", "value", "blockers", rank.alias("rank"), (F.col("value") - base).alias("delta"))


def report(rows: DataFrame, order: list[str]) -> dict[str, Any]:
    """A small result as a JSON-ready report; for rows that a fixed list (runs, tasks, categories) bounds."""
    return {"columns": rows.columns, "rows": [list(r) for r in rows.orderBy(*order).collect()]}
