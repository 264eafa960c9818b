"""Summaries of benchmark samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import divided
from .quantiles import quantiles


def throughput(samples: DataFrame, group: list[str]) -> DataFrame:
    """All tokens over all seconds, never a mean of rates; ``samples``: tokens, seconds."""
    return samples.groupBy(*group).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("seconds").alias("seconds")).withColumn("tokens_per_second", divided(F.col("tokens"), F.col("seconds")))


def summary(samples: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Count, least, mean, largest and exact quantiles with linear interpolation; a group may hold all samples."""
    names = {"q0": "p50", "q1": "p90", "q2": "p95"}
    return quantiles(samples, value, group, (0.5, 0.9, 0.95)).withColumnsRenamed(names)


def memory(samples: DataFrame, group: list[str]) -> DataFrame:
    """The peak, or why there is none: the distinct reasons, sorted; ``mixed`` if only some samples have one. ``samples``: peak, reason."""
    reasons = F.array_join(F.array_sort(F.collect_set(F.when(F.col("peak").isNull(), F.col("reason")))), "; ")
    return samples.groupBy(*group).agg(F.max("peak").alias("peak"), reasons.alias("reasons"), (F.count("peak").between(1, F.count(F.lit(1)) - 1)).alias("mixed"))


def sessions(turns: DataFrame, session: str) -> DataFrame:
    """Turns, tokens, tokens a second, milliseconds a decoded token; ``turns``: tokens, seconds, decode_seconds."""
    more = F.greatest(F.col("tokens") - 1, F.lit(0))
    out = turns.groupBy(session).agg(F.count(F.lit(1)).alias("turns"), F.sum("tokens").cast("long").alias("tokens"), F.sum("seconds").alias("seconds"), F.sum(F.when(more > 0, F.col("decode_seconds"))).alias("_d"), F.sum(more).alias("_m"))
    return out.select(session, "turns", "tokens", divided(F.col("tokens"), F.col("seconds")).alias("tokens_per_second"), divided(1000 * F.col("_d"), F.col("_m")).alias("decode_ms"))


def against_baseline(variants: DataFrame, baseline: DataFrame, value: str) -> DataFrame:
    """Each variant with the one baseline row, and its absolute and relative change."""
    base = baseline.limit(1).select(F.col(value).alias("base_value"))  # one row, so it is broadcast
    joined = variants.crossJoin(F.broadcast(base))
    return joined.withColumns({"delta": F.col(value) - F.col("base_value"), "relative": F.try_divide(F.col(value) - F.col("base_value"), F.col("base_value"))})


def after_warmup(samples: DataFrame, step: str, warmup: int) -> DataFrame:
    return samples.where(F.col(step) >= warmup)


def paired(naive: DataFrame, cached: DataFrame, key: str = "iteration") -> DataFrame:
    """Two modes side by side, with the speed-up."""
    left, right = naive.withColumnRenamed("seconds", "naive_seconds"), cached.withColumnRenamed("seconds", "cached_seconds")
    return left.join(right, key).withColumn("speedup", divided(F.col("naive_seconds"), F.col("cached_seconds")))
