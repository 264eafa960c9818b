"""Tokenized datasets and sinks: round trips, corruption, restarts."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import tokenized
from tessera.operators.byte_pairs import byte_encode
from tessera.streaming import logs, sinks

SCHEMA = "event_id long, run long, value double"


def encode(docs):
    return docs.select("doc_id", byte_encode(F.col("text")).alias("ids"))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("train" if i % 4 else "val", i % 4, i, "é" * i) for i in range(12)], "split string, shard_index int, doc_id long, text string")


def test_round_trip_and_corruption(spark, docs, tmp_path):
    path = str(tmp_path / "set")
    tokenized.write(docs, encode, path, 256)
    stored = tokenized.read(spark, path, 256)
    assert {r.doc_id: r.ids for r in stored.collect()} == {i: list(("é" * i).encode()) for i in range(12)}
    assert tokenized.retokenised(stored, docs, encode).isEmpty()
    total = spark.read.parquet(f"{path}/manifest").where("split = 'total'").first()
    assert (total.documents, total.tokens, total.bytes) == (12, 2 * sum(range(12)), 4 * sum(range(12)))
    with pytest.raises(tokenized.Unsound):
        tokenized.read(spark, path, 100)
    stored.where("doc_id = 5").selectExpr("doc_id", "array(1) as ids").write.mode("append").parquet(f"{path}/tokens/split=train/shard_index=1")
    with pytest.raises(tokenized.Unsound, match="shard 1"):
        tokenized.read(spark, path, 256)


def test_overlap_is_an_error(spark, docs, tmp_path):
    with pytest.raises(tokenized.Unsound, match="both splits"):
        tokenized.write(docs.union(spark.createDataFrame([("val", 0, 1, "x")], docs.schema)), encode, str(tmp_path / "set"), 256)


def test_sinks(spark, tmp_path):
    source, out, other = (str(tmp_path / n) for n in ("in", "out", "other"))
    for i in range(3):
        spark.createDataFrame([(k, k % 2, float(k)) for k in range(i * 4, i * 4 + 6)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):
        sinks.started(logs.replayed(spark, source, SCHEMA), sinks.fanned_out(sinks.appended(out), sinks.appended(other)), str(tmp_path / "checkpoint")).awaitTermination()
    for at in (out, other):
        assert sorted(r.event_id for r in spark.read.parquet(at).collect()) == list(range(14))
    bad = spark.createDataFrame([(3, 1, 99.0)], SCHEMA)
    with pytest.raises(ValueError, match="conflicting event 3"):
        sinks.fanned_out(sinks.appended(out), sinks.appended(other))(bad, 9)
