"""Metric logs as streams; each query gives what its batch twin in ``operators.runs`` gives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def replayed(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Files of a directory as a stream, some at a time, so memory stays bounded."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(log: DataFrame, key: str = "event_id") -> DataFrame:
    """The first record of each event."""
    return log.dropDuplicates([key])


def latest(log: DataFrame) -> DataFrame:
    """The value at the highest step, per run and name; for complete or update mode."""
    return log.where("value is not null").groupBy("run", "name").agg(F.max("step").alias("step"), F.max_by("value", F.struct("step", "value")).alias("value"))


def sessions(turns: DataFrame, session: str) -> DataFrame:
    """Turns and tokens by session; for complete or update mode."""
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))


class RunningMinimum(StatefulProcessor):
    """The least value of a run so far; emits each record that improves on it strictly."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        best = self.best.get()[0] if self.best.exists() else None
        out = []
        for step, value in sorted((s, v) for b in rows for s, v in zip(b["step"], b["value"], strict=True)):
            if best is None or value < best:
                best = value
                out.append((key[0], step, value))
        if out:
            self.best.update((best,))
        yield pd.DataFrame(out, columns=["run", "step", "value"])

    def close(self) -> None:
        pass


def improvements(log: DataFrame) -> DataFrame:
    """Records that improve on all before them; needs the RocksDB state store (see ``session.STREAMING``)."""
    return log.select("run", "step", "value").groupBy("run").transformWithStateInPandas(RunningMinimum(), "run long, step long, value double", "Append", "None")


def windowed(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extension: counts and sums by event-time window, with a watermark for late records."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
