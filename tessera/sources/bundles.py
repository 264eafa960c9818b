"""Evaluation bundles and run directories; small files by nature, read on the driver."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import zipfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .jsonl import Invalid, exact_keys, strict_json


class Bundle:
    """A zip of task files, pinned by its SHA-256; a member that occurs twice is an error."""

    def __init__(self, raw: bytes, sha256: str | None = None) -> None:
        if sha256 is not None and hashlib.sha256(raw).hexdigest() != sha256:
            raise Invalid("the bundle isn't the pinned one")
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        names = self.zip.namelist()
        if len(set(names)) != len(names):
            raise Invalid("a member occurs twice")
        if bad := [n for n in names if not safe_path(n)]:
            raise Invalid(f"unsafe member names: {bad}")

    def text(self, name: str) -> str:
        return self.zip.read(name).decode("utf-8")

    def baselines(self, name: str) -> dict[str, float]:
        """Chance accuracy of tasks as shares, from a CSV in per cent."""
        out: dict[str, float] = {}
        for row in csv.DictReader(io.StringIO(self.text(name))):
            task, pct = row["Eval Task"].strip(), float(row["Random baseline"])
            if task in out or not 0 <= pct < 100:
                raise Invalid(f"bad baseline of {task}")
            out[task] = 0.01 * pct
        return out

    def references(self, name: str) -> list[tuple[str, float, float]]:
        """Rows of accuracy and centered score of a reference model; the last is the mean."""
        rows = list(csv.reader(io.StringIO(self.text(name)), skipinitialspace=True))
        if [c.strip() for c in rows[0]] != ["Task", "Accuracy", "Centered"] or not rows[-1] or rows[-1][0].strip() != "CORE":
            raise Invalid("unexpected columns or no trailing mean")
        return [(r[0].strip(), float(r[1] or "nan"), float(r[2])) for r in rows[1:]]

    def examples(self, name: str, task_type: str) -> list[dict[str, Any]]:
        keys = {"multiple_choice": {"query", "choices", "gold"}, "schema": {"context_options", "continuation", "gold"}, "language_modeling": {"context", "continuation"}}[task_type]
        return [exact_keys(strict_json(line), keys, "an example") for line in self.text(name).splitlines() if line.strip()]


def safe_path(name: str) -> bool:
    """Relative, without going up and without control characters."""
    parts = name.replace("\\", "/").split("/")
    return bool(name) and not name.startswith(("/", "\\")) and ".." not in parts and ":" not in parts[0] and all(c.isprintable() for c in name)


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """``run_dir, record_type, event_id, step, name, value`` of metric-log files, a row a metric; only Spark opens them."""
    schema = "record_type string, event_id string, step long, metrics map<string,double>"
    raw = spark.read.schema(schema).json(path).selectExpr("element_at(split(_metadata.file_path, '/'), -2) as run_dir", "*")
    return raw.where("record_type = 'metrics'").selectExpr("run_dir", "record_type", "event_id", "step", "explode(metrics) as (name, value)")


def check_log(lines: list[str]) -> None:
    """A log begins with its one config record, and every line is strict JSON that ends with a line feed."""
    for i, line in enumerate(lines):
        if not line.endswith("\n"):
            raise Invalid(f"line {i + 1} is not complete")
        if (strict_json(line).get("record_type") == "config") != (i == 0):
            raise Invalid(f"line {i + 1}: a config record comes first and only there")


def save_json(value: Any) -> str:
    """Report text: sorted keys, two spaces, no NaN."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """A small table for a report; null is a dash, numbers have six digits."""
    show = lambda v: "—" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(show, r)) + " |" for r in [tuple(columns), tuple("---" for _ in columns), *rows]) + "\n"
