"""Scores of benchmark tasks, from tables of model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.formulas import centered, divided

#: Accuracies that chance reaches (fixed values).
CHAT_BASELINES = {"ARC-Easy": 0.25, "ARC-Challenge": 0.25, "MMLU": 0.25, "GSM8K": 0.0, "HumanEval": 0.0}
CATEGORICAL = ("ARC-Easy", "ARC-Challenge", "MMLU")


def accuracy(results: DataFrame, group: list[str], correct: str = "correct") -> DataFrame:
    """Evaluated, correct and their share by group; rows of a null group are ignored."""
    kept = results.na.drop(subset=group) if group else results
    sums = kept.groupBy(*group).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(correct).alias("passed"))
    return sums.withColumn("accuracy", divided(F.col("passed"), F.col("evaluated")))


def with_baseline(tasks: DataFrame, baselines: DataFrame) -> DataFrame:
    """Tasks with their baselines; a task without one raises when it is read."""
    joined = tasks.join(F.broadcast(baselines.withColumn("_known", F.lit(True))), "task", "left")
    return joined.withColumn("baseline", F.when(F.col("_known"), F.col("baseline")).otherwise(F.raise_error(F.concat(F.lit("no baseline for task "), F.col("task"))))).drop("_known")


def centered_scores(accuracies: DataFrame, baselines: DataFrame) -> DataFrame:
    """Adds ``centered``; ``accuracies``: task, accuracy; ``baselines``: task, baseline (shares, not per cent)."""
    return with_baseline(accuracies, baselines).withColumn("centered", centered(F.col("accuracy"), F.col("baseline")))


def mean_over_tasks(scores: DataFrame) -> DataFrame:
    """The unweighted mean of tasks' centered scores."""
    return scores.agg(F.count(F.lit(1)).alias("tasks"), F.avg("centered").alias("metric"))


def chat_metrics(scores: DataFrame, bounded: bool = False) -> DataFrame:
    """The mean of all five tasks and of the categorical three; null unless all five are there. Published only if no bound held."""
    known = scores.where(F.col("task").isin(*CHAT_BASELINES))
    whole = F.countDistinct("task") == len(CHAT_BASELINES)
    three = F.avg(F.when(F.col("task").isin(*CATEGORICAL), F.col("centered")))
    out = known.agg(F.when(whole, F.avg("centered")).alias("metric"), F.when(whole, three).alias("categorical"), whole.alias("complete"))
    return out.withColumn("published", F.when(F.col("complete") & F.lit(not bounded), F.col("metric")))


def pass_any(samples: DataFrame, group: list[str]) -> DataFrame:
    """Share of problems that any sample solves."""
    per = samples.groupBy(*group, "problem").agg(F.bool_or("passed").alias("correct"))
    return accuracy(per, group)


def stop_counts(samples: DataFrame, group: list[str], end_id: int, bos_id: int) -> DataFrame:
    stopped = F.col("completion_reason") == "stop_token"
    return samples.groupBy(*group).agg(
        F.count_if(stopped & (F.col("stop_token_id") == end_id)).alias("end_stops"), F.count_if(stopped & (F.col("stop_token_id") == bos_id)).alias("bos_stops"),
        F.count_if(F.col("completion_reason") == "max_new_tokens").alias("length_stops"), F.count(F.lit(1)).alias("samples"),
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def response_diagnostics(samples: DataFrame, group: list[str], length: str = "generated_tokens", text: str = "text") -> DataFrame:
    """Visible lengths and blank responses."""
    blank = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"(?U)\s+", "") == ""
    out = samples.groupBy(*group).agg(F.min(length).alias("shortest"), F.avg(length).alias("mean_length"), F.max(length).alias("longest"), F.count_if(blank).alias("blank"), F.count(F.lit(1)).alias("samples"))
    return out.withColumn("blank_rate", divided(F.col("blank"), F.col("samples")))


def violation_rate(json_bad: Column, code_bad: Column) -> Column:
    return (json_bad.cast("int") + code_bad.cast("int")) / F.lit(2.0)


def argmax_label(logits: Column, labels: Column) -> Column:
    """The label of the largest logit, the first of equals."""
    return F.element_at(labels, F.array_position(logits, F.array_max(logits)).cast("int"))


def fitting_prefix(rows: DataFrame, order: str, fits: Column, most: int, group: list[str]) -> DataFrame:
    """Rows in order until ``most`` of them fit; those that don't are kept and marked."""
    before = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("fits", fits).withColumn("_n", F.coalesce(F.sum(F.col("fits").cast("int")).over(before), F.lit(0)))
    return seen.where(F.col("_n") < most).drop("_n")


def mean_losses(options: DataFrame) -> DataFrame:
    """Mean loss of each option's continuation; an option without one has NaN. ``options``: task, example, option, losses."""
    total = F.aggregate("losses", F.lit(0.0), lambda a, x: a + x)
    return options.withColumn("mean_loss", F.when(F.size("losses") > 0, total / F.size("losses")).otherwise(F.lit(float("nan"))))


def predicted_option(losses: DataFrame, keys: list[str]) -> DataFrame:
    """The option of least loss, the first of equals. NaN counts only as the first option, and then wins: nothing is less than it."""
    first = F.min_by("mean_loss", "option")
    best = F.min(F.when(~F.isnan("mean_loss"), F.struct("mean_loss", "option")))
    return losses.groupBy(*keys).agg(F.when(F.isnan(first), F.min("option")).otherwise(best["option"]).alias("predicted"))


def common_prefix(a: Column, b: Column) -> Column:
    """Leading elements that two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i >= n) | ~(F.get(a, i).eqNullSafe(F.get(b, i))))
    return F.get(differs, F.lit(0))


def common_suffix(a: Column, b: Column) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))


def left_truncated(ids: Column, start: Column, end: Column, most: int) -> dict[str, Column]:
    """The right end of ``ids``, with a span that moves along; null if the span is lost."""
    cut = F.greatest(F.size(ids) - most, F.lit(0))
    ok = start >= cut
    return {"ids": F.slice(ids, cut + 1, F.size(ids) - cut), "start": F.when(ok, start - cut), "end": F.when(ok, end - cut)}


def right_padded(ids: Column, width: Column, pad: int) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def language_model_correct(predicted: Column, actual: Column) -> Column:
    """All continuation tokens as predicted."""
    return predicted == actual
