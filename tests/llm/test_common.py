"""Shared helpers."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tessera.llm.common import BATCH, possibly, written


def test_possibly(spark):
    r = random.Random(3)
    keys = {(r.randrange(1 << 40), r.choice("abc")) for _ in range(5000)}
    rows = [*keys, *((r.randrange(1 << 40), "d") for _ in range(5000)), (None, None)]
    have = spark.createDataFrame(sorted(keys), "k long, s string")
    docs = spark.createDataFrame(rows, "x long, y string")
    got = possibly(docs, have, {"k": F.col("x"), "s": F.col("y")}, "hit")
    assert got.columns == ["x", "y", "hit"] and got.count() == len(rows)
    hit = [(a, b) for a, b, h in got.collect() if h]
    assert keys <= set(hit) and len(hit) < len(keys) + 100
    assert possibly(docs, have.limit(0), {"k": F.col("x"), "s": F.col("y")}, "hit").where("hit").isEmpty()


def test_batches_of_a_write(spark):
    """A write may bound what workers are sent at a time; the session's own setting holds again after it, also after a failure."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    def fails(batches):
        raise ValueError("stop")
        yield

    df = spark.range(1000, numPartitions=1)
    seen = lambda **own: [r.n for r in written(df.mapInArrow(sizes, "n long"), "batches", **own).collect()]
    before = spark.conf.get(BATCH, None)
    assert seen() == [1000] and seen(rows=300) == [300, 300, 300, 100] and spark.conf.get(BATCH, None) == before
    with pytest.raises(Exception, match="stop"):
        written(df.mapInArrow(fails, "n long"), "batches", rows=300)
    assert spark.conf.get(BATCH, None) == before
    try:
        for own, got in (("250", [250] * 4), ("0", [500, 500]), ("5000", [500, 500])):  # the smaller bound holds; 0 is none
            spark.conf.set(BATCH, own)
            assert seen(rows=500) == got and spark.conf.get(BATCH) == own
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
