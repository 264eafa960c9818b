"""Identities: SHA-256 over canonical forms."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def identity(value: Any) -> str:
    """Of a JSON value: sorted keys, no spaces, UTF-8."""
    raw = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return "sha256:" + hashlib.sha256(raw.encode()).hexdigest()


def row_identity(**fields: Column) -> Column:
    """The same of strings and whole numbers in columns."""
    named = F.struct(*[c.alias(k) for k, c in sorted(fields.items())])
    return F.concat(F.lit("sha256:"), F.sha2(F.to_json(named, {"ignoreNullFields": "false"}).cast("binary"), 256))


def seed_of(value: Any) -> int:
    """A non-negative 63-bit seed from the first eight bytes of a JSON value's hash."""
    return int(identity(value)[7:23], 16) & (1 << 63) - 1


def cycle_seed(epoch: Column, source: Column, cycle: Column) -> Column:
    """A 32-bit seed from the first four bytes of a hash."""
    text = F.concat_ws(":", epoch.cast("string"), source.cast("string"), cycle.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
