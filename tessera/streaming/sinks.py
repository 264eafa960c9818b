"""Sinks of metric streams: exactly-once append, idempotent append of small logs, and fan-out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

Sink = Callable[[DataFrame, int], None]


class FirstOfEach(StatefulProcessor):
    """Passes on the first record of each event; state holds a hash of what was passed on, and another repeat stops the query.

    The last three columns of its input are event, digest and bucket.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "event string", "digest string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = []
            for i, (event, digest) in enumerate(zip(batch.iloc[:, -3], batch.iloc[:, -2], strict=True)):
                if not self.seen.containsKey((event,)):
                    self.seen.updateValue((event,), (digest,))
                    new.append(i)
                elif self.seen.getValue((event,))[0] != digest:
                    raise ValueError(f"conflicting event {event}")
            yield batch.iloc[new, :-3]

    def close(self) -> None:
        pass


def first_of_each(log: DataFrame, key: str = "event_id", buckets: int = 1024) -> DataFrame:
    """A stream's events, each once. Ids are looked up in a keyed state store, so a batch costs what its own events cost, however long the log is.

    Events are dealt into ``buckets`` by their ids; the number can't change for a checkpoint. Rows without an id raise.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema)
    event = F.when(F.col(key).isNotNull(), F.col(key).cast("string")).otherwise(F.raise_error(F.lit("an event without an id")))
    digest = F.sha2(F.to_json(F.struct(*log.columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    own = log.withColumns({"_event": event, "_digest": digest}).withColumn("_bucket", F.pmod(F.xxhash64("_event"), F.lit(buckets)))
    return own.groupBy("_bucket").transformWithStateInPandas(FirstOfEach(), schema, "Append", "None")


def appended_once(log: DataFrame, path: str, checkpoint: str, key: str = "event_id", buckets: int = 1024) -> StreamingQuery:
    """Appends a stream's new events as Parquet and ends. Neither a repeated batch nor a restart from the checkpoint adds an event again."""
    return first_of_each(log, key, buckets).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def appended(path: str, key: str = "event_id") -> Sink:
    """Appends events that ``path`` doesn't have yet, so a repeated batch adds nothing; a conflicting repeat raises.

    Reads what is there with every batch: for small logs and ``foreachBatch``; ``appended_once`` keeps state instead.
    """

    def write(batch: DataFrame, _: int) -> None:
        from ..operators.runs import deduplicated

        new = deduplicated(batch, key)
        spark = batch.sparkSession
        if _exists(spark, path):
            old = spark.read.parquet(path)
            rest = [c for c in old.columns if c != key]
            both = new.join(old.select(key, *[F.col(c).alias(f"_{c}") for c in rest]), key)
            differs = F.lit(False)
            for c in rest:
                differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
            if (bad := both.where(differs).select(key).first()) is not None:
                raise ValueError(f"conflicting event {bad[0]}")
            new = new.join(old.select(key), key, "left_anti")
        new.write.mode("append").parquet(path)

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def fanned_out(*sinks: Sink) -> Sink:
    """All sinks get each batch; the first error is raised once all have had their turn."""

    def write(batch: DataFrame, number: int) -> None:
        first: Exception | None = None
        for sink in sinks:
            try:
                sink(batch, number)
            except Exception as e:  # noqa: BLE001  each sink has its turn
                first = first or e
        if first is not None:
            raise first

    return write


def started(stream: DataFrame, sink: Sink, checkpoint: str) -> StreamingQuery:
    """Runs over what is there and ends; a restart goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
