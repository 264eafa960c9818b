"""Listings, guards and names of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import divided


def hub_shards(listing: DataFrame, dataset: str, config: str, split: str) -> DataFrame:
    """Shards of one split from a hub's listing; a partial or unfinished listing raises when read.

    ``listing``: partial, pending, failed, parquet_files (structs of dataset, config, split, url, filename, size).
    """
    whole = ~F.col("partial") & (F.size("pending") == 0) & (F.size("failed") == 0)
    each = listing.select(F.explode("parquet_files").alias("f"), whole.alias("ok")).select("f.*", "ok")
    mine = each.where((F.col("dataset") == dataset) & (F.col("config") == config) & (F.col("split") == split))
    name = F.when(F.col("ok"), F.col("filename")).otherwise(F.raise_error(F.lit("the listing is not complete")))
    return mine.select(name.alias("filename"), "url", "size").dropDuplicates(["filename", "url"])


def download_summary(targets: DataFrame) -> DataFrame:
    """Planned, ready, downloaded and skipped targets, and their bytes; ``targets``: status, n_bytes."""
    of = lambda s: F.count_if(F.col("status") == s)
    bytes_of = lambda s: F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n_bytes"))), F.lit(0)).cast("long")
    return targets.agg(F.count(F.lit(1)).alias("planned"), of("ready").alias("ready"), of("downloaded").alias("downloaded"), of("skipped").alias("skipped"), bytes_of("downloaded").alias("downloaded_bytes"), bytes_of("skipped").alias("skipped_bytes"))


def scope(bounded: Column, tasks: Column, all_tasks: int) -> Column:
    """How much of an evaluation ran: full, bounded, partial or both."""
    partial = tasks < all_tasks
    return F.when(bounded & partial, "bounded_partial").when(bounded, "bounded").when(partial, "partial").otherwise("full")


def scoped_metrics(metrics: DataFrame, prefix: str) -> DataFrame:
    """Public names for a full evaluation; else the scope is part of the name and aggregates are left out. ``metrics``: scope, name, is_aggregate, value."""
    full = F.col("scope") == "full"
    name = F.when(full, F.concat(F.lit(prefix + "/"), F.col("name"))).otherwise(F.concat(F.lit(prefix + "/"), F.col("scope"), F.lit("/"), F.col("name")))
    return metrics.where(full | ~F.col("is_aggregate")).select(name.alias("name"), "value")


def canonical_names(text: Column, known: tuple[str, ...]) -> Column:
    """A comma list as unique names in canonical order; null if one is unknown."""
    given = F.transform(F.split(text, ","), lambda x: F.trim(x))
    every = F.array(*[F.lit(k) for k in known])
    return F.when(F.size(F.array_except(given, every)) == 0, F.filter(every, lambda k: F.array_contains(given, k)))


def key_difference(present: Column, wanted: Column) -> dict[str, Column]:
    """Keys that lack and keys that shouldn't be there."""
    return {"missing": F.array_sort(F.array_except(wanted, present)), "unexpected": F.array_sort(F.array_except(present, wanted))}


def column_union(*lists: Column) -> Column:
    """Names of all lists in order, each once."""
    return F.array_distinct(F.concat(*lists))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once; must be none."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def ids_in_range(ids: Column, vocab: int) -> Column:
    return F.forall(ids, lambda x: (x >= 0) & (x < vocab))


def comparable(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether all required identities agree; null agrees with null."""
    out = F.lit(True)
    for k in a:
        out = out & a[k].eqNullSafe(b[k])
    return out


def estimate_gap(estimate: Column, observed: Column) -> tuple[Column, Column]:
    """(estimate less observed, why there is none)."""
    return estimate - observed, F.when(estimate.isNull(), "no estimate").when(observed.isNull(), "no observation")


def distinct_parameters(parameters: DataFrame, group: list[str]) -> DataFrame:
    """Elements of parameters, each shared object once; ``parameters``: object, elements."""
    return parameters.dropDuplicates([*group, "object"]).groupBy(*group).agg(F.count(F.lit(1)).alias("objects"), F.sum("elements").cast("long").alias("elements"))


def loader_statistics(items: DataFrame, length: int) -> DataFrame:
    """What a conversation loader saw, cropped, skipped and kept; ``items``: tokens, supervised."""
    seen = items.withColumn("crop", F.col("tokens") > length + 1)
    return seen.agg(F.count(F.lit(1)).alias("seen"), F.count_if("crop").alias("cropped"), F.count_if(F.col("supervised") == 0).alias("skipped"), F.coalesce(F.sum(F.when(F.col("supervised") > 0, F.least("tokens", F.lit(length + 1)))), F.lit(0)).cast("long").alias("kept_tokens"))


def category_totals(categories: DataFrame) -> DataFrame:
    """Bytes, tokens, their ratio, and whether all round trips passed; ``categories``: bytes, tokens, round_trip."""
    return categories.agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("tokens").cast("long").alias("tokens"), divided(F.sum("bytes"), F.sum("tokens")).alias("bytes_per_token"), F.bool_and("round_trip").alias("round_trip"))


def compared_totals(categories: DataFrame) -> DataFrame:
    """Saving over another tokenizer, if it was measured on all categories; ``categories``: tokens, base_tokens."""
    whole = F.count("base_tokens") == F.count(F.lit(1))
    base = F.when(whole, F.sum("base_tokens"))
    return categories.agg(F.sum("tokens").cast("long").alias("tokens"), base.cast("long").alias("base_tokens"), divided(base - F.sum("tokens"), base).alias("saving"))


def scoring_span(options: Column, task_type: Column) -> Column:
    """Where scored tokens begin: after what all options share in front (multiple choice), or the length of what they share behind (schema)."""
    shared = lambda xs: F.aggregate(F.slice(xs, 2, F.size(xs)), F.get(xs, F.lit(0)), lambda acc, x: _common(acc, x))
    return F.when(task_type == "schema", F.size(shared(F.transform(options, F.reverse)))).otherwise(F.size(shared(options)))


def _common(a: Column, b: Column) -> Column:
    from .scoring import common_prefix

    return F.slice(a, 1, common_prefix(a, b))
