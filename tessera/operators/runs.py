"""Metric logs and comparison of runs; long tables ``run, step, name, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def deduplicated(log: DataFrame, key: str = "event_id") -> DataFrame:
    """One row an event; repeats must be equal, else reading them raises."""
    rest = [c for c in log.columns if c != key]
    same = F.count_distinct(F.struct(*rest)) == 1
    first = F.min(F.struct(*rest)).alias("_r")
    one = log.groupBy(key).agg(same.alias("_ok"), first)
    checked = F.when(F.col("_ok"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("conflicting event "), F.col(key).cast("string")))).alias(key)
    return one.select(checked, *[F.col(f"_r.{c}").alias(c) for c in rest])


def regressions(log: DataFrame, run: str, order: str, step: str) -> DataFrame:
    """Records whose step is below the one before; steps may repeat."""
    previous = F.lag(step).over(W.partitionBy(run).orderBy(order))
    return log.withColumn("previous_step", previous).where(F.col(step) < F.col("previous_step"))


def merged_steps(log: DataFrame) -> DataFrame:
    """One value a (run, step, name); null ``value`` and ``conflict`` where records disagree."""
    out = log.groupBy("run", "step", "name").agg(F.count_distinct("value").alias("_n"), F.max("value").alias("value"))
    return out.select("run", "step", "name", F.when(F.col("_n") == 1, F.col("value")).alias("value"), (F.col("_n") > 1).alias("conflict"))


def latest(log: DataFrame) -> DataFrame:
    """The value at the highest step, per run and name; nulls don't count."""
    return log.where("value is not null").groupBy("run", "name").agg(F.max("step").alias("step"), F.max_by("value", F.struct("step", "value")).alias("value"))


def improvements(log: DataFrame) -> DataFrame:
    """Adds the best value so far and whether a record improves on it; equal isn't better."""
    before = W.partitionBy("run").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    return log.withColumn("best_before", F.min("value").over(before)).withColumn("improved", F.col("best_before").isNull() | (F.col("value") < F.col("best_before")))


def ranked(runs: DataFrame) -> DataFrame:
    """Competition rank by value: equals share a rank, the next one skips. A row a run."""
    return runs.withColumn("rank", F.rank().over(W.orderBy("value")))


def aligned(log: DataFrame, runs: list[str]) -> DataFrame:
    """A row for every step of any run, a column a run; null where a run has none. ``log``: run, step, value."""
    return log.groupBy("step").pivot("run", runs).agg(F.max("value"))


def aligned_all(log: DataFrame) -> DataFrame:
    """A row for every step of any run: ``values``, an array of (run, value) by run, and ``n_runs``. An array is as long as there are runs."""
    each = log.groupBy("step", "run").agg(F.max("value").alias("value"))
    return each.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("run", "value"))).alias("values"), F.count(F.lit(1)).alias("n_runs"))


def differing(identities: DataFrame, fields: list[str]) -> DataFrame:
    """Fields with more than one value over runs (null counts as a value), and how many."""
    text = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("\0null"))
    counts = identities.agg(*[F.count_distinct(text(f)).alias(f) for f in fields])
    pairs = ", ".join(f"'{f}', `{f}`" for f in fields)
    return counts.selectExpr(f"stack({len(fields)}, {pairs}) as (field, n_values)").where("n_values > 1")


def deltas(values: DataFrame, base: str) -> DataFrame:
    """Value less that of the run ``base``, by name; null if either is missing. ``values``: run, name, value."""
    own = values.where(F.col("run") == base).select("name", F.col("value").alias("base_value"))
    return values.join(own, "name", "left").withColumn("delta", F.col("value") - F.col("base_value"))


def relative(value: Column, base: Column) -> tuple[Column, Column]:
    """(absolute, relative) change; no relative one from 0."""
    return value - base, F.try_divide(value - base, base)


def blockers(status: Column, latest_step: Column, max_steps: Column, evaluation: Column, complete: Column) -> Column:
    """Why a run can't be ranked, as an array; empty if it can."""
    reasons = F.array(
        F.when(status != "completed", F.concat(F.lit("status: "), status)),
        F.when(latest_step.isNull(), F.lit("no steps were logged")),
        F.when(latest_step < max_steps, F.concat(F.lit("too few steps: "), latest_step.cast("string"), F.lit(" < "), max_steps.cast("string"))),
        F.when(latest_step > max_steps, F.concat(F.lit("too many steps: "), latest_step.cast("string"), F.lit(" > "), max_steps.cast("string"))),
        F.when(~evaluation, F.lit("not evaluated")),
        F.when(evaluation & ~complete, F.lit("partly evaluated")),
    )
    return F.filter(reasons, lambda r: r.isNotNull())


def best_of(log: DataFrame, names: list[str]) -> DataFrame:
    """The least value under any of several names, per run."""
    return log.where(F.col("name").isin(names)).groupBy("run").agg(F.min("value").alias("best"))


def processed_tokens(log: DataFrame, tokens_per_step: int) -> DataFrame:
    return log.groupBy("run").agg((F.max("step") * tokens_per_step).alias("tokens"))


def missing_tasks(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Wanted (run, task) that aren't present."""
    return wanted.join(present, wanted.columns, "left_anti")


def protocol_metrics(metrics: DataFrame, known: DataFrame) -> DataFrame:
    """Metrics whose name is reserved for exactly their protocol; ``known``: protocol, name."""
    return metrics.join(F.broadcast(known), ["protocol", "name"])
