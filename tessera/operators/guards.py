"""Guards and orders around runs and loaders: metrics that must be finite, lifecycles, replayed prefixes, conflicts, resumption."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def metric_fault(value: Column) -> Column:
    """Why a metric can't be published: null, not finite or negative; null for a sound one."""
    return F.when(value.isNull(), "missing").when(F.isnan(value) | (F.abs(value) == math.inf), "not finite").when(value < 0, "negative")


def checked_product(*factors: Column) -> Column:
    """The product of whole numbers, null where it or a part of it leaves 64 bits."""
    return reduce(F.try_multiply, [f.cast("long") for f in factors])


def checked_sum(*parts: Column) -> Column:
    """The sum of whole numbers, null where it or a part of it leaves 64 bits."""
    return reduce(F.try_add, [p.cast("long") for p in parts])


def content_free(rows: DataFrame, *texts: str) -> DataFrame:
    """``rows`` with counts and hashes in place of texts."""
    facts = [c for t in texts for c in (F.length(t).alias(f"{t}_chars"), F.sha2(F.col(t).cast("binary"), 256).alias(f"{t}_sha256"))]
    return rows.select(*[c for c in rows.columns if c not in texts], *facts)


def opted_in(rows: DataFrame, flags: dict[str, bool]) -> DataFrame:
    """``rows`` with columns nulled whose flag isn't set."""
    return rows.withColumns({c: F.col(c) if on else F.lit(None).cast(rows.schema[c].dataType) for c, on in flags.items()})


def lifecycles(events: DataFrame) -> DataFrame:
    """``run, status, sound`` of ``events`` (run, seq, status): a run starts once as running, and ends at most once, after that."""
    order = W.partitionBy("run").orderBy("seq")
    before = F.lag("status").over(order)
    ok = F.when(before.isNull(), F.col("status") == "running").otherwise((before == "running") & F.col("status").isin("completed", "failed"))
    return events.withColumn("ok", ok).groupBy("run").agg(F.max_by("status", "seq").alias("status"), F.bool_and("ok").alias("sound"))


def completed_prefix(events: DataFrame) -> DataFrame:
    """``run, done, in_order`` of ``events`` (run, seq, shard_index): whether the shards replayed are the first ones, in order."""
    at = F.row_number().over(W.partitionBy("run").orderBy("seq")) - 1
    return events.withColumn("ok", at == F.col("shard_index")).groupBy("run").agg(F.count(F.lit(1)).alias("done"), F.bool_and("ok").alias("in_order"))


def conflicts(there: DataFrame, new: DataFrame) -> DataFrame:
    """Names of reports that exist with another identity than the one to be written; both: name, identity."""
    return new.join(there.select("name", F.col("identity").alias("_there")), "name").where(~F.col("identity").eqNullSafe(F.col("_there"))).select("name")


def cache_key(repository: Column, subset: Column, split: Column, identity: Column) -> Column:
    """A readable name for a pinned dataset: its names and twelve digits of its identity's hash."""
    return F.concat_ws("-", F.regexp_replace(repository, "/", "--"), subset, split, F.substring(F.sha2(identity.cast("binary"), 256), 1, 12))


def consistent(result: dict[str, Column], context: dict[str, Column]) -> Column:
    """Whether every field of a result equals that of its context; nulls are equal."""
    return reduce(lambda a, b: a & b, [result[k].eqNullSafe(v) for k, v in sorted(context.items())])


def seeded_order(rows: DataFrame, seed: int, key: str, group: str) -> DataFrame:
    """``position`` of rows in their group, in an order that the seed and the key's hash give."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary"), 256)
    return rows.withColumn("position", F.row_number().over(W.partitionBy(group).orderBy(order, key)) - 1)


def batches(rows: DataFrame, size: int, order: str, group: str) -> DataFrame:
    """``batch``: which group of ``size`` rows, in order, a row of its shard belongs to."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def resumed(plan: DataFrame, cursors: DataFrame, group: str, position: str) -> DataFrame:
    """Rows of a deterministic plan that a loader hasn't given yet; ``cursors``: group, next (the first position to give). No cursor: all."""
    return plan.join(cursors.select(group, F.col("next").alias("_next")), group, "left").where(F.col(position) >= F.coalesce("_next", F.lit(0))).drop("_next")


def smaller_steps(batch: Column, accumulation: Column) -> Column:
    """After a run out of memory: half the batch and twice the accumulation, and so on while the batch is even; the tokens a step stay the same."""
    times = F.bit_count(batch.bitwiseAND(-batch) - 1)  # how often two divides the batch
    halvings = F.when((batch > 0) & (times > 0), F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return F.transform(halvings, lambda i: F.struct((batch / F.pow(F.lit(2), i)).cast("long").alias("batch"), (accumulation * F.pow(F.lit(2), i)).cast("long").alias("accumulation")))


def memory_advice(batch: Column, length: Column, width: Column, heads: Column, layers: Column, total: Column) -> Column:
    """What to make smaller after a run out of memory, the mildest first: ``priority, field, now, then, accumulation, total, kept``.

    Half the batch, half the length, half the width (a multiple of the heads), half the layers; what can't be halved is left out.
    For the first two, ``accumulation`` steps keep the ``total`` tokens of an update where that divides, else the
    largest total below it is given, and ``kept`` is false.
    """
    null = F.lit(None).cast("long")

    def step(priority: int, field: str, now: Column, then: Column, tokens: Column | None = None) -> Column:
        times = null if tokens is None else F.greatest(F.lit(1), F.floor(total / tokens)).cast("long")
        new = null if tokens is None else times * tokens
        kept = F.lit(None).cast("boolean") if tokens is None else F.pmod(total, tokens) == 0
        return F.when((then > 0) & (then < now), F.struct(F.lit(priority).alias("priority"), F.lit(field).alias("field"), now.cast("long").alias("now"), then.alias("then"), times.alias("accumulation"), new.cast("long").alias("total"), kept.alias("kept")))

    half = lambda c, of=1: (F.floor(F.floor(c / 2) / of) * of).cast("long")
    less, shorter = F.greatest(half(batch), F.lit(1)), F.greatest(half(length), F.lit(1))
    steps = (step(1, "batch", batch, less, less * length), step(2, "length", length, shorter, batch * shorter), step(3, "width", width, half(width, heads)), step(4, "layers", layers, F.greatest(half(layers), F.lit(1))))
    return F.array_compact(F.array(*steps))
