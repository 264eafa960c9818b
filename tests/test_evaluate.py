"""Evaluation runs on small inputs."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage, bpb, evaluate, row_packing, scoring
from tessera.operators.byte_pairs import byte_encode


def encode(docs):
    return docs.select("doc_id", byte_encode(F.col("text")).alias("ids"))


def decode(ids):
    text = F.decode(F.unhex(F.array_join(F.transform("ids", lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")), "utf-8")
    return ids.select("doc_id", text.alias("text"))


def test_tokenizer_report(spark):
    texts = evaluate.corpora(spark, {"mine": spark.createDataFrame([(0, "é"), (1, "")], "doc_id long, text string")})
    rows = {r.category: r for r in evaluate.tokenizer_report(texts, encode, decode).collect()}
    assert set(rows) == {*evaluate.SAMPLES, "mine"} and all(r.round_trip and r.bytes_per_token == 1 for r in rows.values()) and rows["mine"].bytes == 2


def test_masked_vector(spark):
    rows = list(zip((0, 1, 3, 2, 1, -1), (0.5, 1.0, 99.0, 1.5, 88.0, 77.0), (True, True, True, False, False, True)))
    losses = spark.createDataFrame([(*r, 1) for r in rows], "target int, loss_nats double, mask boolean, g int")
    lengths = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "token_id int, n_bytes int")
    got = bpb.masked_bpb(losses, lengths, ["g"]).first()
    assert (got.nats, got.tokens, got.bytes) == (1.5, 2, 3) and abs(got.bpb - 1.5 / math.log(2) / 3) < 1e-12


def test_full_documents(spark):
    docs = spark.createDataFrame([(0, i, list(range(i * 3))) for i in range(8)], "shard_index int, doc_id long, ids array<int>").selectExpr("*", "size(ids) as n_tokens")
    plan = row_packing.best_fit_rows(docs, 7, "shard_index")
    rows = row_packing.materialised(plan, docs.select("shard_index", "doc_id", "ids"), 7, 256, "shard_index")
    losses = rows.select(F.explode(F.arrays_zip("targets", "mask")).alias("x")).select(F.col("x.targets").alias("target"), F.lit(0.5).alias("loss_nats"), F.col("x.mask").alias("mask"))
    sweep = lambda p: coverage.coverage(p, docs, "shard_index")
    got = coverage.full_document_bpb(losses, sweep(plan), bpb.byte_lengths(spark)).first()
    assert (got.documents, got.tokens, got.supervised) == (8, sum(3 * i for i in range(8)), sum(3 * i + 1 for i in range(8))) and abs(got.bpb - 0.5 / math.log(2)) < 1e-12
    with pytest.raises(Exception, match="1 documents are not covered once; the first is 5: missing tokens"):
        coverage.full_document_bpb(losses, sweep(plan.where("doc_id != 5 or start != 7")), bpb.byte_lengths(spark)).collect()


def test_assistant_bpb(spark):
    rows = spark.createDataFrame([([1, -1, 256], [0.2, 9.0, 9.0], 2), ([3], [0.4], 1)], "labels array<int>, losses array<double>, n_conversations int")
    got = evaluate.assistant_bpb(rows, bpb.byte_lengths(spark)).first()
    assert (got.tokens, got.conversations) == (2, 3) and abs(got.nats - 0.6) < 1e-12


def test_tasks(spark):
    results = spark.createDataFrame([("MMLU", i, i < 3) for i in range(4)], "task string, example int, correct boolean")
    base = spark.createDataFrame([("MMLU", 0.25)], "task string, baseline double")
    assert abs(evaluate.task_accuracy(results, base).first().centered - 2 / 3) < 1e-12
    assert evaluate.task_accuracy(results, base, 2).first().evaluated == 2
    with pytest.raises(Exception, match="no baseline"):
        scoring.with_baseline(results.withColumn("task", F.lit("other")), base).collect()


def test_nan_rule(spark):
    rows = [("a", 0, []), ("a", 1, [1.0]), ("b", 0, [2.0]), ("b", 1, []), ("b", 2, [1.0, 1.0]), ("c", 0, [1.0]), ("c", 1, [1.0])]
    got = scoring.predicted_option(scoring.mean_losses(spark.createDataFrame(rows, "example string, option int, losses array<double>")), ["example"])
    assert dict(map(tuple, got.collect())) == {"a": 0, "b": 2, "c": 0}


def test_compared_runs(spark):
    log = spark.createDataFrame([("x", 5, "bpb", 1.2), ("y", 5, "bpb", 1.0), ("z", 5, "bpb", 1.0), ("x", 1, "bpb", 0.1)], "run string, step long, name string, value double")
    config = spark.createDataFrame([(r, "completed", 5, True, True, "k") for r in "xyz"], "run string, status string, max_steps long, evaluated boolean, complete boolean, key string")
    rows = {r.run: r for r in evaluate.compared_runs(log, config, "bpb", ["key"]).collect()}
    assert [rows[r].rank for r in "xyz"] == [3, 1, 1] and abs(rows["y"].delta + 0.2) < 1e-12
    blocked = config.withColumn("status", F.when(F.col("run") == "y", "failed").otherwise(F.col("status")))
    rows = {r.run: r for r in evaluate.compared_runs(log, blocked, "bpb", ["key"]).collect()}
    assert all(r.rank is None for r in rows.values()) and rows["y"].blockers == ["status: failed"]
