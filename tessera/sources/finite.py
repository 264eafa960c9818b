"""Finite in-memory conversations as a Python data source, for plug-in sources."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Slice(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class ConversationSource(DataSource):
    """``spark.read.format("tessera_conversations").option("records", json_list).option("slices", n)``."""

    @classmethod
    def name(cls) -> str:
        return "tessera_conversations"

    def schema(self) -> str:
        return "conv_id long, turn int, role string, text string"

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(json.loads(self.options["records"]), int(self.options.get("slices", "1")))


class _Reader(DataSourceReader):
    def __init__(self, records: list, slices: int) -> None:
        self.records, self.slices = records, max(1, slices)

    def partitions(self) -> list[InputPartition]:
        step = max(1, -(-len(self.records) // self.slices))
        return [Slice(i, i + step) for i in range(0, max(1, len(self.records)), step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i, messages in enumerate(self.records[partition.start : partition.stop], partition.start):
            for turn, (role, text) in enumerate(messages):
                yield i, turn, role, text
