"""Queries over bytes, pairs, windows and bits per byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpb, byte_pairs
from ..registry import Registry
from ..sources.shards import table

BYTES = """SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS INT)) AS ids FROM documents"""
WORDS = """SELECT w, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w != '' GROUP BY w"""
PAIRS = f"""
    SELECT CAST('0x' || h[2*i+1:2*i+2] AS INT) AS left_id, CAST('0x' || h[2*i+3:2*i+4] AS INT) AS right_id, CAST(sum(n) AS BIGINT) AS pair_count
    FROM (SELECT hex(encode(w)) AS h, n, unnest(range(0, strlen(w) - 1)) AS i FROM ({WORDS}) WHERE strlen(w) > 1) GROUP BY ALL"""
#: Losses by position, as no model runs here: a fixed function of the line.
LOSSES = """SELECT l_orderkey AS row_id, l_linenumber AS pos, l_orderkey * 31 % 270 - 5 AS target, l_quantity / 10 AS loss_nats, l_linenumber % 3 != 0 AS mask FROM lineitem"""


def ids(s: SparkSession, d: str) -> DataFrame:
    """The bytes of whole texts."""
    return table(s, d, "documents").select("doc_id", byte_pairs.byte_encode(F.col("text")).alias("ids"))


def window_sums(s: SparkSession, d: str) -> DataFrame:
    """All windows of each document, told by their number and sums over their first inputs and last targets."""
    each = byte_pairs.sliding_windows(ids(s, d), 16).select("doc_id", F.col("inputs")[0].alias("first"), F.col("targets")[15].alias("last"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("first").alias("first_inputs"), F.sum("last").alias("last_targets"))


def losses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), (F.col("l_orderkey") * 31 % 270 - 5).alias("target"), (F.col("l_quantity") / 10).alias("loss_nats"), (F.col("l_linenumber") % 3 != 0).alias("mask"))


def register(r: Registry) -> None:
    joined = lambda c: F.array_join(c, ",")
    r.add("byte_encode", lambda s, d: ids(s, d).select("doc_id", joined("ids").alias("ids")), f"SELECT doc_id, array_to_string(ids, ',') AS ids FROM ({BYTES})")
    r.add("byte_pair_counts", lambda s, d: byte_pairs.pair_counts(byte_pairs.word_chunks(table(s, d, "documents"), least_bytes=2)), PAIRS)
    r.add("best_pair", lambda s, d: byte_pairs.best_pair(byte_pairs.pair_counts(byte_pairs.word_chunks(table(s, d, "documents"), least_bytes=2))), f"{PAIRS} ORDER BY pair_count DESC, left_id, right_id LIMIT 1")
    r.add("next_token_shift", lambda s, d: byte_pairs.next_token_shift(ids(s, d)).select("doc_id", joined("inputs").alias("inputs"), joined("targets").alias("targets")), f"""
        SELECT doc_id, array_to_string(ids[1:len(ids)-1], ',') AS inputs, array_to_string(ids[2:], ',') AS targets FROM ({BYTES})""")
    r.add("sliding_windows", window_sums, f"""
        SELECT doc_id, len(ids) - 16 AS windows, CAST(list_sum(ids[1:len(ids) - 16]) AS BIGINT) AS first_inputs, CAST(list_sum(ids[17:]) AS BIGINT) AS last_targets FROM ({BYTES}) WHERE len(ids) > 16""")
    r.add("token_byte_lookup", lambda s, d: bpb.with_bytes(losses(s, d), bpb.byte_lengths(s)).groupBy("n_bytes").agg(F.count(F.lit(1)).alias("targets")), f"""
        SELECT CAST(CASE WHEN target BETWEEN 0 AND 255 THEN 1 ELSE 0 END AS INT) AS n_bytes, count(*) AS targets FROM ({LOSSES}) GROUP BY 1""")
    r.add("source_coverage", lambda s, d: bpb.source_coverage(ids(s, d), bpb.byte_lengths(s)), f"SELECT count(DISTINCT doc_id) AS documents, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(len(ids)) AS BIGINT) AS bytes FROM ({BYTES})")
    nine = lambda c: F.round(c, 9).alias(c)
    r.add("masked_bpb", lambda s, d: bpb.masked_bpb(losses(s, d).withColumn("part", F.col("row_id") % 4), bpb.byte_lengths(s), ["part"]).select("part", nine("nats"), "tokens", "bytes", nine("bpb")), f"""
        SELECT part, round(sum(loss_nats), 9) AS nats, count(*) AS tokens, count(*) AS bytes, round(sum(loss_nats) / ln(2) / count(*), 9) AS bpb
        FROM (SELECT *, row_id % 4 AS part FROM ({LOSSES})) WHERE target BETWEEN 0 AND 255 AND mask GROUP BY part""")
    prefix = lambda s, d: table(s, d, "documents").select((F.col("doc_id") % 300).alias("doc_id"), F.least("n_chars", F.lit(500) + F.col("doc_id") % 700).alias("prefix"))
    r.add("unique_prefix_coverage", lambda s, d: bpb.unique_prefix(prefix(s, d)), """
        SELECT count(*) AS documents, CAST(sum(m) AS BIGINT) AS unique_tokens FROM (SELECT doc_id % 300, max(least(n_chars, 500 + doc_id % 700)) AS m FROM documents GROUP BY 1)""")
    r.add("retention", lambda s, d: bpb.retention(table(s, d, "documents").groupBy("lang").agg(F.countDistinct("text").alias("unique_count"), F.count(F.lit(1)).alias("source_count"))).withColumn("retained", F.round("retained", 9)), """
        SELECT lang, count(DISTINCT text) AS unique_count, count(*) AS source_count, count(*) - count(DISTINCT text) AS discarded, round(count(DISTINCT text) / count(*), 9) AS retained FROM documents GROUP BY lang""")
    r.add("mask_targets", lambda s, d: ids(s, d).select("doc_id", joined(bpb.mask_targets("ids", F.transform("ids", lambda x: x % 3 != 0))).alias("targets")), f"""
        SELECT doc_id, array_to_string(list_transform(ids, lambda x: CASE WHEN x % 3 != 0 THEN x ELSE -1 END), ',') AS targets FROM ({BYTES})""")
    batches = lambda s, d: table(s, d, "lineitem").select("l_linenumber", F.col("l_discount").alias("loss"), F.col("l_quantity").cast("long").alias("n_targets"))
    r.add("weighted_loss", lambda s, d: bpb.weighted_loss(batches(s, d), ["l_linenumber"]).select("l_linenumber", "targets", nine("loss")), """
        SELECT l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS targets, round(sum(l_discount * CAST(l_quantity AS BIGINT)) / sum(CAST(l_quantity AS BIGINT)), 9) AS loss FROM lineitem GROUP BY 1""")
