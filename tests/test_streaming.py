"""Streams give what their batch twins give."""

import pytest

from tessera.operators import runs
from tessera.streaming import logs

SCHEMA = "run long, name string, step long, event_id long, value double"


@pytest.fixture
def path(spark, tmp_path):
    rows = [(k % 3, "ab"[k % 2], k // 3, k, float(k * 37 % 101)) for k in range(120)]
    for i in range(4):
        spark.createDataFrame(rows[30 * i : 30 * i + 30] + rows[:3], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def drained(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_deduplicated(spark, path):
    got = drained(logs.deduplicated(logs.replayed(spark, path, SCHEMA, 2)), "dedup", "append")
    assert rows(got) == rows(runs.deduplicated(spark.read.parquet(path)).select(got.columns))


def test_latest(spark, path):
    assert rows(drained(logs.latest(logs.replayed(spark, path, SCHEMA, 2)), "latest", "complete")) == rows(runs.latest(spark.read.parquet(path)))


def test_running_minimum(spark, path):
    got = drained(logs.improvements(logs.replayed(spark, path, SCHEMA, 100)), "improve", "append")
    want = runs.improvements(runs.deduplicated(spark.read.parquet(path))).where("improved").select("run", "step", "value")
    assert rows(got) == rows(want)


def test_conflicts_raise(spark):
    log = spark.createDataFrame([(1, "a", 1, 1, 1.0), (1, "a", 1, 1, 2.0)], SCHEMA)
    with pytest.raises(Exception, match="conflicting event"):
        runs.deduplicated(log).collect()
    assert runs.merged_steps(log).first().conflict
