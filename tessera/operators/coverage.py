"""Whether packed rows hold every token of every document once: a sweep over the pieces of each document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bpb


def coverage(plan: DataFrame, sizes: DataFrame, group: str) -> DataFrame:
    """A row a document: pieces, tokens that are missing, met twice or lie beyond its end, supervised positions, and ``fault``.

    ``plan`` has the pieces that ``row_packing.best_fit_rows`` gives (group, doc_id, start, n_tokens, is_continuation,
    is_end), ``sizes`` group, doc_id and n_tokens. Pieces are swept by their starts; what lies between the furthest end so far and the next
    start is missing, what begins before that end is met twice. ``fault`` is null, or the first of: no document,
    no piece, beyond the end, missing tokens, repeated tokens, marks (a piece must be marked as a continuation if it
    doesn't start the document, and as the end if it reaches its end).
    """
    at = [group, "doc_id"]
    known = sizes.select(*at, F.col("n_tokens").cast("long").alias("_size"))
    order = W.partitionBy(*at).orderBy("start", "_stop")
    stop = F.col("start").cast("long") + F.col("n_tokens")
    pieces = plan.select(*at, "start", "n_tokens", "is_continuation", "is_end", stop.alias("_stop")).join(known.withColumnRenamed("_size", "_n"), at, "left")
    swept = pieces.withColumn("_far", F.coalesce(F.max("_stop").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    none = F.lit(0).cast("long")
    inside = lambda c: F.least(c, F.coalesce("_n", c))  # noqa: E731  what lies beyond the end isn't missing
    each = swept.groupBy(*at).agg(
        F.count(F.lit(1)).alias("pieces"), F.sum(F.greatest(inside(F.col("start").cast("long")) - inside(F.col("_far")), none)).alias("_gaps"), F.sum(F.greatest(F.least("_far", "_stop") - F.col("start"), none)).alias("repeated"),
        F.max("_stop").alias("_end"), F.sum(F.col("n_tokens") + F.col("is_end").cast("int")).alias("supervised"),
        F.count_if(F.col("is_continuation") != (F.col("start") > 0)).alias("_starts"), F.count_if("is_end").alias("_ends"), F.count_if(F.col("is_end") & (F.col("n_tokens") == 0) & (F.col("start") > 0)).alias("_bare"), F.max(F.when(F.col("is_end"), F.col("_stop"))).alias("_marked"),
    )
    both = each.join(known, at, "full_outer")
    missing = F.coalesce("_gaps", none) + F.greatest(F.col("_size") - F.coalesce("_end", none), none)
    beyond = F.greatest(F.coalesce("_end", none) - F.col("_size"), none)
    marks = (F.col("_starts") > 0) | (F.col("_ends") != 1) | (F.col("_marked") != F.col("_end")) | (F.col("_bare") > 0)
    fault = F.when(F.col("_size").isNull(), "no document").when(F.col("pieces").isNull(), "no piece").when(beyond > 0, "beyond the end").when(missing > 0, "missing tokens").when(F.col("repeated") > 0, "repeated tokens").when(marks, "marks")
    number = lambda c: F.coalesce(F.col(c), none).alias(c)
    return both.select(*at, number("pieces"), F.coalesce(missing, none).alias("missing"), number("repeated"), F.coalesce(beyond, none).alias("beyond"), number("supervised"), fault.alias("fault"))


def row_faults(plan: DataFrame, length: int, group: str) -> DataFrame:
    """Rows whose pieces don't fit their ``length`` + 1 places or whose slots have gaps; none in a sound plan."""
    rows = plan.groupBy(group, "row").agg(F.sum(F.col("n_tokens") + 1).alias("places"), F.count(F.lit(1)).alias("pieces"), F.max("slot").alias("_last"), F.count_distinct("slot").alias("_slots"))
    fault = F.when(F.col("places") > length + 1, "too many tokens").when((F.col("_last") != F.col("pieces") - 1) | (F.col("_slots") != F.col("pieces")), "slots")
    return rows.select(group, "row", "places", "pieces", fault.alias("fault")).where("fault is not null")


def full_document_bpb(losses: DataFrame, covered: DataFrame, lengths: DataFrame) -> DataFrame:
    """Bits per byte over packed rows, of documents that are all covered once; anything else raises when read.

    ``losses``: target, loss_nats, mask, of all places of the rows; ``covered``: what ``coverage`` gives for their plan.
    """
    found = bpb.masked_bpb(losses.withColumn("_g", F.lit(1)), lengths, ["_g"])
    bad = covered.agg(F.count_if(F.col("fault").isNotNull()).alias("_bad"), F.min(F.when(F.col("fault").isNotNull(), F.struct("doc_id", "fault"))).alias("_first"), F.count(F.lit(1)).alias("documents"), F.sum("supervised").alias("supervised"))
    both = found.crossJoin(F.broadcast(bad))  # one row
    why = F.concat(F.col("_bad").cast("string"), F.lit(" documents are not covered once; the first is "), F.col("_first.doc_id").cast("string"), F.lit(": "), F.col("_first.fault"))
    return both.select("documents", "supervised", "nats", "tokens", "bytes", F.when(F.col("_bad") == 0, F.col("bpb")).otherwise(F.raise_error(why)).alias("bpb"))
