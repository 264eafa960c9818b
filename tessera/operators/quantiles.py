"""Exact quantiles by rank selection, without holding or sorting a group's values.

A value's place is found by histograms of ever finer steps: first by 64ths of octaves of its size, then twice by 4096ths of what a
bucket really spans. Each step counts rows by bucket (partial counts before the shuffle), and only buckets that a wanted rank falls into are
looked at again. An octave's 64th holds at most 2**46 doubles, so what is left after the steps has at most 2**22 distinct
values a bucket, whatever the rows; these are counted by value, as are buckets that hold few rows before that. So no task sees more than that, one group of all rows
included, and what is shuffled are counts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import Kept

FINE, STEPS = 4096, 2
#: Rows of a bucket that are counted by value without more steps.
FEW = 1 << 17
#: Above any step number of a finite double's size.
FAR = 1 << 20


def coarse(value: Column) -> Column:
    """A step number that never falls as the value grows; NaN comes last."""
    size = F.floor(F.log2(F.abs(value)) * 64).cast("int") + F.lit(FAR // 2)
    return F.when(F.isnan(value), 3 * FAR).when(value == math.inf, 2 * FAR).when(value == -math.inf, -2 * FAR).when(value == 0, 0).when(value > 0, size).otherwise(-size)


def fine(value: Column, low: Column, high: Column) -> Column:
    """One of FINE steps between two values, halved first so that the span stays finite."""
    span = high / 2 - low / 2
    return F.when((span > 0) & (span < math.inf), F.least(F.floor((value / 2 - low / 2) / span * FINE), F.lit(FINE - 1)).cast("int")).otherwise(0)


def _beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join by equal columns, nulls being equal; both sides may come from one table."""
    if not on:
        return left.crossJoin(right)  # without groups ``right`` has a row a rank, or one
    own = right.withColumnsRenamed({c: f"{c}_r" for c in on})
    return left.join(own, [F.col(c).eqNullSafe(F.col(f"{c}_r")) for c in on]).drop(*[f"{c}_r" for c in on])


def _hit(buckets: DataFrame, wanted: DataFrame, at: list[str], step: str) -> DataFrame:
    """For each wanted ``rank`` (from 0) within ``at`` the bucket that holds it, and its rank there."""
    marked = buckets.withColumn("_after", F.sum("_c").over(W.partitionBy(*at).orderBy(step)))
    both = _beside(marked, wanted, at).where((F.col("rank") < F.col("_after")) & (F.col("rank") >= F.col("_after") - F.col("_c")))
    return both.select(*at, step, "id", "p", "part", "_c", (F.col("rank") - F.col("_after") + F.col("_c")).alias("rank"), "_low", "_high")


def quantiles(rows: DataFrame, value: str, group: list[str], shares: Sequence[float]) -> DataFrame:
    """By group: ``n, least, mean, largest`` and ``q0, q1, …`` with linear interpolation between ranks; null values don't count.

    Histograms are written between steps, so each step reads the values once.
    """
    table = Kept(rows.sparkSession, "histogram")
    names = [f"_g{i}" for i in range(len(group))]
    own = rows.where(F.col(value).isNotNull()).select(*[F.col(g).alias(k) for g, k in zip(group, names, strict=True)], F.col(value).cast("double").alias("_v"))
    level = own.withColumn("_b0", coarse(F.col("_v")))
    counted = [F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high")]
    first = table.added(level.groupBy(*names, "_b0").agg(*counted, F.sum("_v").alias("_s")))
    totals = first.groupBy(*names).agg(F.sum("_c").alias("n"), F.min("_low").alias("least"), (F.sum("_s") / F.sum("_c")).alias("mean"), F.max("_high").alias("largest"))
    # each share needs the ranks around its place
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    asked = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(float(p)).alias("p"), F.lit(part).alias("part"), (F.floor(place(p)) if part == 0 else F.ceil(place(p))).cast("long").alias("rank")) for i, p in enumerate(shares) for part in (0, 1)])
    wanted = totals.where("n > 0").select(*names, F.explode(asked).alias("x")).select(*names, "x.*")
    found, at, done = table.added(_hit(first, wanted, names, "_b0")), [*names, "_b0"], []
    sure = (F.col("_low") == F.col("_high")) | (F.isnan("_low") & F.isnan("_high"))
    for k in range(1, STEPS + 2):
        done.append(found.where(sure))
        rest = found.where(~sure)
        largest = rest.agg(F.max("_c")).first()[0]
        if largest is None:
            break
        bounds = rest.groupBy(*at).agg(F.first("_low").alias("_l"), F.first("_high").alias("_h"))
        level = _beside(level, bounds, at)
        last = k > STEPS or largest <= FEW  # the last step is the value itself
        level = level.withColumn(f"_b{k}", F.col("_v") if last else fine(F.col("_v"), F.col("_l"), F.col("_h"))).drop("_l", "_h")
        found = table.added(_hit(level.groupBy(*at, f"_b{k}").agg(*counted), rest.select(*at, "id", "p", "part", "rank"), at, f"_b{k}"))
        at = [*at, f"_b{k}"]
        if last:
            done.append(found)
            break
    ends = reduce(DataFrame.unionByName, [x.select(*names, "id", "part", F.col("_low").alias("x")) for x in done])
    sides = [F.max(F.when((F.col("id") == i) & (F.col("part") == part), F.col("x"))).alias(f"_{i}_{part}") for i in range(len(shares)) for part in (0, 1)]
    both = _beside(totals, ends.groupBy(*names).agg(*sides), names)

    def between(i: int, p: float) -> Column:
        a, b, low = F.col(f"_{i}_0"), F.col(f"_{i}_1"), F.floor(place(p))
        return F.when(a == b, a).otherwise((low + 1 - place(p)) * a + (place(p) - low) * b)

    return both.select(*[F.col(k).alias(g) for g, k in zip(group, names, strict=True)], "n", "least", "mean", "largest", *[between(i, float(p)).alias(f"q{i}") for i, p in enumerate(shares)])
