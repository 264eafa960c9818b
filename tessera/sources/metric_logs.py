"""Metric logs that are still being written, as a batch and a streaming source.

A run directory holds ``metrics.jsonl``: JSON lines, the first of which is the run's resolved configuration. The stream's offset is a byte
position a file, so only new bytes are read. A line without its line feed isn't complete and is withheld until
it is. Each line is strict JSON (no duplicate keys, no NaN); a file whose first record isn't the one configuration, an
unknown record, a bad metric or a step that moves backwards stops the query with the file and the byte of the line.

Files are opened through ``pyarrow.fs``, by workers; the driver only finds the last line feed of each. Files may grow, and new
ones may appear; one that shrinks is an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .jsonl import Invalid, strict_json

SCHEMA = "run_dir string, at long, event_id string, step long, name string, value double, text string"
NAME = "metrics.jsonl"
#: Bytes that are read at a time, and the most that one task is given unless a line is longer.
CHUNK, TASK = 1 << 16, 1 << 26


def _opened(path: str):
    """A file system and the path on it; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """The logs below a directory, and how many bytes each has."""
    from pyarrow import fs

    store, at = _opened(path)
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.base_name == NAME}


def _last_feed(store, path: str, low: int, high: int) -> int:
    """The position behind the last line feed of ``low .. high``; ``low`` if there is none."""
    with store.open_input_file(path) as f:
        while high > low:
            begin = max(low, high - CHUNK)
            f.seek(begin)
            if (at := f.read(high - begin).rfind(b"\n")) >= 0:
                return begin + at + 1
            high = begin
    return low


def _next_feed(store, path: str, low: int, high: int) -> int:
    """The position behind the first line feed of ``low .. high``; ``high`` if there is none."""
    with store.open_input_file(path) as f:
        f.seek(low)
        while low < high and (got := f.read(min(CHUNK, high - low))):
            if (at := got.find(b"\n")) >= 0:
                return low + at + 1
            low += len(got)
    return high


@dataclass
class Span(InputPartition):
    """Whole lines of a file; those of one file follow one another, and each begins behind a line feed."""

    path: str
    start: int
    end: int


def metric(name: str, value: Any, where: str) -> tuple[float | None, str | None]:
    """(number, text) of a scalar; a truth value is 0 or 1."""
    if value is None or isinstance(value, str):
        return None, value
    if not isinstance(value, (bool, int, float)):
        raise Invalid(f"metric {name} is not a scalar at {where}")
    if not math.isfinite(value):
        raise Invalid(f"metric {name} is not finite at {where}")
    return float(value), None


def _text(record: dict[str, Any], key: str, where: str) -> str | None:
    if key not in record:
        return None
    if not isinstance(record[key], str) or not record[key].strip():
        raise Invalid(f"{key} must be a text that isn't blank at {where}")
    return record[key]


KEYS = {"config": ({"config"}, set()), "metrics": ({"metrics"}, {"event_id", "step"}), "artifact": ({"name", "path", "type"}, {"event_id"})}


def record_of(line: bytes, first: bool, where: str) -> dict[str, Any]:
    """A sound record; the configuration comes first and only there."""
    try:
        record = strict_json(line.decode("utf-8"))
    except (UnicodeDecodeError, Invalid) as e:
        raise Invalid(f"{e} at {where}") from e
    kind = record.get("record_type") if isinstance(record, dict) else None
    if (kind == "config") != first:
        raise Invalid(f"a configuration comes first and only there, at {where}")
    if kind not in KEYS:
        raise Invalid(f"unknown record type at {where}")
    needed, allowed = KEYS[kind]
    if not needed <= record.keys() - {"record_type"} <= needed | allowed:
        raise Invalid(f"a {kind} record has other keys at {where}")
    _text(record, "event_id", where)
    if kind == "artifact":
        for key in needed:
            _text(record, key, where)
    step = record.get("step")
    if step is not None and (isinstance(step, bool) or not isinstance(step, int) or step < 0):
        raise Invalid(f"a step is a whole number from 0 at {where}")
    if kind == "metrics" and not isinstance(record["metrics"], dict):
        raise Invalid(f"metrics must be an object at {where}")
    return record


def _lines_back(f, end: int) -> Iterator[bytes]:
    """Lines before ``end``, the last first."""
    tail: list[bytes] = []  # what is known of a line, its last piece first
    while end > 0:
        begin = max(0, end - CHUNK)
        f.seek(begin)
        first, *whole = f.read(end - begin).split(b"\n")
        end = begin
        if whole:
            tail.append(whole.pop())
            yield from (x for x in (b"".join(reversed(tail)), *reversed(whole)) if x)
            tail = []
        tail.append(first)
    if line := b"".join(reversed(tail)):
        yield line


def read_span(span: Span) -> Iterator[tuple]:
    store, path = _opened(span.path)
    run_dir = path.rstrip("/").split("/")[-2]
    with store.open_input_file(path) as f:
        prior = None
        if span.start:
            for line in _lines_back(f, span.start):  # up to the last step before
                if (step := strict_json(line.decode()).get("step")) is not None:
                    prior = step
                    break
        f.seek(span.start)
        at, read, head = span.start, span.start, []  # ``head``: pieces of a line whose end isn't read
        while read < span.end and (got := f.read(min(CHUNK, span.end - read))):
            read += len(got)
            first, *whole = got.split(b"\n")
            head.append(first)
            if whole:
                whole.insert(0, b"".join(head))
                head = [whole.pop()]
            for line in whole:
                where = f"byte {at} of {path}"
                record = record_of(line, at == 0, where)
                step = record.get("step")
                if step is not None:
                    if prior is not None and step < prior:
                        raise Invalid(f"steps move backwards from {prior} to {step} at {where}")
                    prior = step
                if record["record_type"] == "metrics":
                    for name, value in record["metrics"].items():
                        yield (run_dir, at, record.get("event_id"), step, name, *metric(name, value, where))
                at += len(line) + 1


def spans(path: str, start: int, end: int) -> Iterator[Span]:
    """Parts of a file at line feeds, of about TASK bytes."""
    store, at = _opened(path)
    while start < end:
        stop = min(end, start + TASK)
        if stop < end:
            stop = _last_feed(store, at, start, stop)
            if stop == start:  # one line is longer
                stop = _next_feed(store, at, start + TASK, end)
        yield Span(path, start, stop)
        start = stop


class _Batch(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for path, size in _files(self.path).items():
            store, _ = _opened(path)
            out += spans(path, 0, _last_feed(store, path, 0, size))
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition) if partition.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path, self.known = path, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.known)
        for path, size in _files(self.path).items():
            low = out.get(path, 0)
            if size < low:
                raise Invalid(f"{path} has become shorter")
            store, _ = _opened(path)
            if (end := _last_feed(store, path, low, size)) > 0:
                out[path] = end
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [s for path, stop in sorted(end.items()) for s in spans(path, start.get(path, 0), stop)]

    def read(self, partition: Span) -> Iterator[tuple]:
        return read_span(partition)


class MetricLogs(DataSource):
    """``spark.read.format("metric_logs").load(directory)``, and ``readStream`` alike: a row a metric; ``at`` is the byte of its line."""

    @classmethod
    def name(cls) -> str:
        return "metric_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options["path"])

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MetricLogs)
