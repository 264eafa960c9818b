"""Queries over raw text shards and tokenized datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import budget, manifests, shard_ops, stats
from ..registry import Registry
from ..sources import shards

#: Driver tables stand for shards: the last of eight is the validation shard.
PSEUDO = "SELECT *, CAST(doc_id % 8 AS INT) AS shard_index, CASE WHEN doc_id % 8 = 7 THEN 'val' ELSE 'train' END AS split FROM documents"
#: Words stand for tokens, so that any engine can count them.
COUNTED = f"SELECT *, len(string_split(text, ' ')) AS n_tokens FROM ({PSEUDO})"


def pseudo_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.with_split(shards.table(spark, sf_dir, "documents"), "doc_id", 8)


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_shards(spark, sf_dir).withColumn("n_tokens", F.size(F.split("text", " ", -1)).cast("long"))


def register(r: Registry) -> None:
    docs, tokens = pseudo_shards, counted
    r.add("stats_by_split", lambda s, d: stats.stats_by_split(docs(s, d)), f"""
        SELECT coalesce(split, 'total') AS split, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters,
               CAST(sum(strlen(text)) AS BIGINT) AS utf8_bytes
        FROM ({PSEUDO}) GROUP BY ROLLUP (split)""")
    r.add("bounded_prefix", lambda s, d: budget.bounded_prefix(docs(s, d), 200, 100_000, 3000).groupBy("split").agg(*stats.text_measures()), f"""
        WITH c AS (SELECT split, shard_index, doc_id, text[1:3000] AS t FROM ({PSEUDO})),
        w AS (SELECT *, row_number() OVER o AS rn, coalesce(sum(length(t)) OVER (PARTITION BY split ORDER BY shard_index, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
              FROM c WINDOW o AS (PARTITION BY split ORDER BY shard_index, doc_id)),
        k AS (SELECT split, t[1:CAST(100000 - used AS BIGINT)] AS t FROM w WHERE rn <= 200 AND used < 100000)
        SELECT split, count(*) AS documents, CAST(sum(length(t)) AS BIGINT) AS characters, CAST(sum(strlen(t)) AS BIGINT) AS utf8_bytes FROM k GROUP BY split""")
    r.add("stride_shards", lambda s, d: shard_ops.stride(docs(s, d), 1, 3).groupBy("shard_index").agg(F.count(F.lit(1)).alias("documents")), f"""
        WITH f AS (SELECT shard_index, row_number() OVER (ORDER BY shard_index) - 1 AS k FROM (SELECT DISTINCT shard_index FROM ({PSEUDO}) WHERE split = 'train'))
        SELECT shard_index, count(*) AS documents FROM ({PSEUDO}) JOIN f USING (shard_index) WHERE k >= 1 AND (k - 1) % 3 = 0 GROUP BY shard_index""")
    r.add("select_shards", lambda s, d: shard_ops.select_train_prefix(docs(s, d), 3).groupBy("split", "shard_index").agg(F.count(F.lit(1)).alias("documents")), f"""
        SELECT split, shard_index, count(*) AS documents FROM ({PSEUDO}) WHERE split = 'val' OR shard_index < 3 GROUP BY ALL""")
    r.add("shard_plan", lambda s, d: shard_ops.shard_plan(s, 12, 6542), """
        SELECT CAST(i AS INT) AS shard_index, 'train' AS split, 'shard_' || lpad(CAST(i AS VARCHAR), 5, '0') || '.parquet' AS file_name FROM range(12) t(i)
        UNION ALL SELECT 6542, 'val', 'shard_06542.parquet'""")
    r.add("indexed_rows", lambda s, d: shard_ops.indexed(docs(s, d), "shard_index", "doc_id").select("doc_id", "shard_index", F.col("row_index").cast("long").alias("row_index")), f"""
        SELECT doc_id, shard_index, row_number() OVER (ORDER BY shard_index, doc_id) - 1 AS row_index FROM ({PSEUDO})""")
    r.add("char_cap", lambda s, d: budget.char_cap(docs(s, d), 100).select("doc_id", "text", F.length("text").alias("chars")), """
        SELECT doc_id, text[1:100] AS text, CAST(length(text[1:100]) AS INT) AS chars FROM documents""")
    r.add("logical_slice", lambda s, d: shard_ops.logical_slice(shard_ops.indexed(docs(s, d), "shard_index", "doc_id"), 10, 500, 7).select("doc_id", F.col("row_index").cast("long").alias("row_index")), f"""
        SELECT doc_id, k AS row_index FROM (SELECT doc_id, row_number() OVER (ORDER BY shard_index, doc_id) - 1 AS k FROM ({PSEUDO})) WHERE k >= 10 AND k < 500 AND (k - 10) % 7 = 0""")
    r.add("document_spans", lambda s, d: shard_ops.spans(tokens(s, d)), f"""
        SELECT shard_index, doc_id, CAST(sum(n_tokens) OVER o - n_tokens AS BIGINT) AS start_tok, CAST(sum(n_tokens) OVER o AS BIGINT) AS stop_tok
        FROM ({COUNTED}) WINDOW o AS (PARTITION BY shard_index ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
    r.add("manifest_totals", lambda s, d: manifests.totals(tokens(s, d), 32_768), f"""
        SELECT coalesce(split, 'total') AS split, coalesce(shard_index, -1) AS shard_index, count(*) AS documents, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS bytes
        FROM ({COUNTED}) GROUP BY ROLLUP (split, shard_index)""")
    r.add("prep_metrics", lambda s, d: manifests.preparation_metrics(tokens(s, d), 32_768), f"""
        WITH a AS (SELECT count(DISTINCT shard_index) FILTER (split = 'train') AS train_shards, count(*) FILTER (split = 'train') AS train_documents, sum(n_tokens) FILTER (split = 'train') AS train_tokens,
                   count(DISTINCT shard_index) FILTER (split = 'val') AS validation_shards, count(*) FILTER (split = 'val') AS validation_documents, sum(n_tokens) FILTER (split = 'val') AS validation_tokens,
                   count(*) AS documents, sum(strlen(text)) AS utf8_bytes, 2 * sum(n_tokens) AS payload_bytes FROM ({COUNTED})),
        b AS (SELECT COLUMNS(*)::DOUBLE FROM a)
        SELECT 'data/' || name AS name, value FROM (UNPIVOT b ON COLUMNS(*) INTO NAME name VALUE value)""")
    r.add("provenance_overlap", lambda s, d: manifests.overlap(docs(s, d).select("split", "source")), f"""
        SELECT source FROM ({PSEUDO}) WHERE split = 'train' INTERSECT SELECT source FROM ({PSEUDO}) WHERE split = 'val'""")
    r.add("source_reuse", lambda s, d: manifests.reused(docs(s, d).select("split", "source")), f"""
        SELECT source, count(DISTINCT split) AS splits, count(*) AS uses FROM ({PSEUDO}) GROUP BY source HAVING count(*) > 1""")
    name = lambda: F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("name")
    r.add("unreferenced_payloads", lambda s, d: manifests.unreferenced(docs(s, d).select(name()), shards.table(s, d, "labels").select(name())), """
        SELECT 'doc-' || doc_id AS name FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")

    def reconcile(s: SparkSession, d: str) -> DataFrame:
        by = lambda df: df.groupBy("split", "shard_index").agg(F.count(F.lit(1)).alias("documents"))
        return manifests.reconciled(by(docs(s, d)), by(docs(s, d).where("shard_index != 2 and length(text) > 20")))

    r.add("reconcile", reconcile, f"""
        WITH m AS (SELECT split, shard_index, count(*) AS manifest_documents FROM ({PSEUDO}) GROUP BY ALL),
        s AS (SELECT split, shard_index, count(*) AS statistics_documents FROM ({PSEUDO}) WHERE shard_index != 2 AND length(text) > 20 GROUP BY ALL)
        SELECT split, shard_index, manifest_documents, statistics_documents, manifest_documents IS NOT DISTINCT FROM statistics_documents AS agrees FROM m FULL JOIN s USING (split, shard_index)""")

    def lookup(s: SparkSession, d: str) -> DataFrame:
        """Offsets all over the range of starts."""
        starts = shard_ops.valid_starts(tokens(s, d), 128)
        most = starts.agg(F.max("end_offset").alias("most"))  # one row
        offsets = docs(s, d).crossJoin(F.broadcast(most)).select((F.col("doc_id") * 2_654_435_761 % F.col("most")).alias("global_offset")).distinct()
        return shard_ops.offset_to_shard(offsets, starts)

    r.add("offset_to_shard", lookup, f"""
        WITH p AS (SELECT shard_index, greatest(sum(n_tokens) - 128, 0) AS n FROM ({COUNTED}) GROUP BY shard_index),
        q AS (SELECT shard_index, sum(n) OVER (ORDER BY shard_index) - n AS a, sum(n) OVER (ORDER BY shard_index) AS b FROM p),
        o AS (SELECT DISTINCT CAST(doc_id * 2654435761 % (SELECT sum(n) FROM p) AS BIGINT) AS g FROM documents)
        SELECT g AS global_offset, shard_index, CAST(g - a AS BIGINT) AS local_offset FROM o JOIN q ON g >= a AND g < b""")
