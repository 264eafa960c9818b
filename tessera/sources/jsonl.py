"""Strict JSON lines of conversations.

Spark's JSON reader drops duplicate keys and accepts more than the format does, so each line is checked in
Python, a batch at a time; a bad line gets an ``error`` instead of being dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("text", "python", "python_output")
SCHEMA = "line long, messages array<struct<role:string,parts:array<struct<type:string,text:string>>>>, error string"


class Invalid(ValueError):
    """A record that the format doesn't allow."""


def strict_json(line: str) -> Any:
    """JSON without duplicate keys and without NaN and infinities."""

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        out = dict(items)
        if len(out) != len(items):
            raise Invalid("duplicate key")
        return out

    def constant(name: str) -> Any:
        raise Invalid(f"{name} is not JSON")

    try:
        return json.loads(line, object_pairs_hook=pairs, parse_constant=constant)
    except json.JSONDecodeError as e:
        raise Invalid(f"not JSON: {e.msg}") from e


def exact_keys(record: Any, keys: set[str], what: str) -> dict[str, Any]:
    if not isinstance(record, dict):
        raise Invalid(f"{what} must be an object")
    if record.keys() != keys:
        raise Invalid(f"{what} lacks {sorted(keys - record.keys())} and has unexpected {sorted(record.keys() - keys)}")
    return record


def parts_of(content: Any, role: str) -> list[dict[str, str]]:
    if isinstance(content, str):
        return [{"type": "text", "text": content}]
    if role != "assistant" or not isinstance(content, list) or not content:
        raise Invalid("content must be a string, or a list of parts for an assistant")
    out = []
    for part in content:
        part = exact_keys(part, {"type", "text"}, "a part")
        if part["type"] not in PARTS or not isinstance(part["text"], str):
            raise Invalid("a part has a known type and a text")
        out.append({"type": part["type"], "text": part["text"]})
    return out


def conversation(record: Any) -> list[dict[str, Any]]:
    """Messages of a checked record: an optional system message, then user and assistant in turns."""
    record = exact_keys(record, {"schema_version", "messages"}, "a conversation")
    if type(record["schema_version"]) is not int or record["schema_version"] != 1:
        raise Invalid("schema_version must be 1")
    if not isinstance(record["messages"], list) or not record["messages"]:
        raise Invalid("messages must be a list that isn't empty")
    out = []
    for m in record["messages"]:
        m = exact_keys(m, {"role", "content"}, "a message")
        if m["role"] not in ("system", "user", "assistant"):
            raise Invalid("unknown role")
        out.append({"role": m["role"], "parts": parts_of(m["content"], m["role"])})
    turns = out[1:] if out[0]["role"] == "system" else out
    if not turns or any(m["role"] != ("user", "assistant")[i % 2] for i, m in enumerate(turns)):
        raise Invalid("roles must alternate from a user")
    return out


def parsed(lines: DataFrame) -> DataFrame:
    """``line, messages, error`` of text lines (columns line, value); an empty line is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for line, value in zip(b["line"], b["value"], strict=True):
                try:
                    rows.append((line, conversation(strict_json(value)) if value.strip() else None, None if value.strip() else "empty line"))
                except Invalid as e:
                    rows.append((line, None, str(e)))
            yield pd.DataFrame(rows, columns=["line", "messages", "error"])

    return lines.mapInPandas(run, SCHEMA)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversations of JSON-lines files, with the line's place in ``line`` (order within a file only)."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value")
    return parsed(lines)


def canonical(record: dict[str, Any]) -> str:
    """One line with sorted keys and no spaces."""
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def written_as(convs: DataFrame) -> DataFrame:
    """One canonical JSON line (column value) for each conversation of ``messages`` with parts."""
    plain = lambda m: (F.size(m["parts"]) == 1) & (m["parts"][0]["type"] == "text")
    content = lambda m: F.when(plain(m), F.to_json(F.struct(m["parts"][0]["text"].alias("c")))).otherwise(F.to_json(F.struct(F.transform(m["parts"], lambda p: F.struct(p["text"].alias("text"), p["type"].alias("type"))).alias("c"))))
    one = lambda m: F.concat(F.lit('{"content":'), F.regexp_replace(content(m), r'(?s)^\{"c":(.*)\}$', "$1"), F.lit(',"role":"'), m["role"], F.lit('"}'))
    return convs.select(F.concat(F.lit('{"messages":['), F.array_join(F.transform("messages", one), ","), F.lit('],"schema_version":1}')).alias("value"))
