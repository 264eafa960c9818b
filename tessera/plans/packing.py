"""Queries over packed rows and BPE; sequential operators, so they have no SQL and are tested against models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpb, bpe, bpe_rounds, budget, conversations, coverage, draws, row_packing
from ..registry import Registry
from ..sources.shards import table
from .corpus import counted, pseudo_shards

LENGTH, BOS = 256, 256


def sizes(s: SparkSession, d: str) -> DataFrame:
    """Whole documents by their UTF-8 bytes; a null text is empty."""
    docs = pseudo_shards(s, d).select("shard_index", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("n_tokens", F.octet_length("text"))


def tokens(s: SparkSession, d: str) -> DataFrame:
    """The bytes of whole texts as ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):  # an id takes four times its byte
                part = b.slice(i, 500)
                offsets = np.concatenate([[0], np.cumsum(part["n_tokens"].to_numpy())]).astype("i4")
                ids = np.frombuffer("".join(part["text"].to_pylist()).encode(), dtype="u1").astype("i4")
                yield pa.RecordBatch.from_arrays([part["shard_index"], part["doc_id"], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], ["shard_index", "doc_id", "ids"])

    return sizes(s, d).mapInArrow(run, "shard_index int, doc_id long, ids array<int>")


def rows(s: SparkSession, d: str) -> DataFrame:
    return row_packing.materialised(plan(s, d), tokens(s, d), LENGTH, BOS, "shard_index")


def plan(s: SparkSession, d: str) -> DataFrame:
    return row_packing.best_fit_rows(sizes(s, d).drop("text"), LENGTH, "shard_index")


def conversation_sizes(s: SparkSession, d: str) -> DataFrame:
    m = F.col("messages")
    counts = conversations.render_counts(m)
    convs = conversations.gathered(table(s, d, "conversations")).where(conversations.valid_roles(m))
    return convs.select("conv_id", (F.col("conv_id") % 2).cast("string").alias("source"), *[c.alias(k) for k, c in counts.items()])


def register(r: Registry) -> None:
    flat = lambda df: df.withColumns({c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",") for c in ("inputs", "targets", "mask")})
    r.add("bestfit_rows", lambda s, d: row_packing.best_fit_rows(counted(s, d).select("shard_index", "doc_id", F.col("n_tokens").cast("int").alias("n_tokens")), LENGTH, "shard_index"))
    r.add("packed_batches", lambda s, d: flat(row_packing.padded_rows(rows(s, d), 8, LENGTH, BOS, "shard_index")))
    r.add("full_document_rows", lambda s, d: rows(s, d).groupBy("shard_index").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size(F.filter("mask", lambda x: x))).alias("supervised")))

    covered = lambda s, d, p: coverage.coverage(p, sizes(s, d), "shard_index")
    r.add("document_coverage", lambda s, d: covered(s, d, plan(s, d)), f"""
        SELECT CAST(doc_id % 8 AS INT) AS shard_index, doc_id, greatest((n + {LENGTH - 1}) // {LENGTH}, 1) AS pieces, 0::BIGINT AS missing, 0::BIGINT AS repeated, 0::BIGINT AS beyond, n + 1 AS supervised, NULL::VARCHAR AS fault
        FROM (SELECT doc_id, coalesce(strlen(text), 0) AS n FROM documents)""")

    def planted(s: SparkSession, d: str) -> DataFrame:
        """A sound plan with pieces taken out of every fifth document, and every seventh document's first piece met twice."""
        p = plan(s, d)
        return p.where(~((F.col("doc_id") % 5 == 0) & (F.col("start") % (3 * LENGTH) == LENGTH))).union(p.where("doc_id % 7 = 0 and start = 0"))

    r.add("coverage_faults", lambda s, d: covered(s, d, planted(s, d)).where("fault is not null"), f"""
        WITH d AS (SELECT CAST(doc_id % 8 AS INT) AS shard_index, doc_id, coalesce(strlen(text), 0) AS n FROM documents),
        p AS (SELECT *, {LENGTH} * i AS start, least(n - {LENGTH} * i, {LENGTH}) AS k FROM d, LATERAL (SELECT unnest(range(greatest((n + {LENGTH - 1}) // {LENGTH}, 1))) AS i)),
        kept AS (SELECT *, false AS twice FROM p WHERE NOT (doc_id % 5 = 0 AND start % {3 * LENGTH} = {LENGTH}) UNION ALL SELECT *, true FROM p WHERE doc_id % 7 = 0 AND start = 0),
        g AS (SELECT shard_index, doc_id, count(*) AS pieces, CAST(n - sum(k) FILTER (NOT twice) AS BIGINT) AS missing, CAST(coalesce(sum(k) FILTER (twice), 0) AS BIGINT) AS repeated, 0::BIGINT AS beyond,
              CAST(sum(k) + count(*) FILTER (start + k = n) AS BIGINT) AS supervised, count(*) FILTER (start + k = n) AS ends FROM kept GROUP BY shard_index, doc_id, n)
        SELECT * EXCLUDE (ends), CASE WHEN missing > 0 THEN 'missing tokens' WHEN repeated > 0 THEN 'repeated tokens' ELSE 'marks' END AS fault FROM g WHERE missing > 0 OR repeated > 0 OR ends != 1""")

    def whole_bpb(s: SparkSession, d: str) -> DataFrame:
        """Over all packed rows; losses are a fixed function of the target, as no model runs here."""
        places = rows(s, d).select(F.explode(F.arrays_zip("targets", "mask")).alias("x")).select(F.col("x.targets").alias("target"), ((F.col("x.targets") % 7 + 1) / 8).alias("loss_nats"), F.col("x.mask").alias("mask"))
        return coverage.full_document_bpb(places, covered(s, d, plan(s, d)), bpb.byte_lengths(s)).withColumns({c: F.round(c, 6) for c in ("nats", "bpb")})

    r.add("full_document_bpb", whole_bpb, """
        WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS INT)) AS ids FROM documents),
        n AS (SELECT sum(list_sum(list_transform(ids, lambda x: (x % 7 + 1) / 8))) AS nats, CAST(sum(len(ids)) AS BIGINT) AS k FROM b)
        SELECT (SELECT count(*) FROM documents) AS documents, k + (SELECT count(*) FROM documents) AS supervised, round(nats, 6) AS nats, k AS tokens, k AS bytes, round(nats / ln(2) / k, 6) AS bpb FROM n""")

    def shuffled(s: SparkSession, d: str) -> DataFrame:
        """Each shard's documents through a buffer of 100."""
        from ..operators import shard_ops

        docs = shard_ops.indexed_within(pseudo_shards(s, d), "shard_index", "doc_id", "row_index")
        order = draws.buffered_order(docs.groupBy("shard_index").agg(F.count(F.lit(1)).alias("n_rows")), 100, 17).drop("state")
        return order.join(docs.select("shard_index", "row_index", "doc_id"), ["shard_index", "row_index"])

    r.add("buffered_order", shuffled)

    def mix(s: SparkSession, d: str) -> DataFrame:
        return row_packing.mixture(conversation_sizes(s, d), {"0": 1, "1": 3}, 7, 0)

    r.add("conversation_mixture", lambda s, d: mix(s, d).select("conv_id", "source", F.col("cycle").cast("int").alias("cycle"), "order_key"), r.oracles["chat_render_counts"].replace("SELECT conv_id, CAST(1 +", "SELECT conv_id, CAST(conv_id % 2 AS VARCHAR) AS source, c AS cycle, sha256('7:0:' || (conv_id % 2) || ':' || c || ':' || conv_id) AS order_key FROM (SELECT conv_id, CAST(1 +") + ") CROSS JOIN LATERAL (SELECT CAST(i AS INT) AS c FROM range(1, CASE WHEN conv_id % 2 = 0 THEN 2 ELSE 4 END) t(i))")
    r.add("conversation_pack", lambda s, d: row_packing.packed_conversations(mix(s, d), 1024, 64, "source", "order_key"))

    def random_offsets(s: SparkSession, d: str) -> DataFrame:
        from ..operators import shard_ops

        starts = shard_ops.valid_starts(counted(s, d), 128)
        most = starts.agg(F.max("end_offset").alias("most"))  # one row
        drawn = s.range(500).crossJoin(F.broadcast(most)).select((F.conv(F.substring(F.sha2(F.concat(F.lit("11:"), F.col("id").cast("string")), 256), 1, 12), 16, 10).cast("long") % F.col("most")).alias("global_offset"))
        return shard_ops.offset_to_shard(drawn, starts)

    r.add("random_offsets", random_offsets)

    def buffered(s: SparkSession, d: str) -> DataFrame:
        """As many rows as one pass over a shard fills: each of its documents is taken once, and the last row is filled up with BOS."""
        import pandas as pd

        # sizes are whole; of its bytes, a row has no room for more than LENGTH of one document
        own = sizes(s, d).select("shard_index", "doc_id", "n_tokens", F.substring(F.encode("text", "utf-8"), 1, LENGTH).alias("head"))

        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("doc_id")
            docs, heads = [(i, range(n)) for i, n in enumerate(pdf["n_tokens"].tolist())], pdf["head"].tolist()
            source = (docs[i : i + 128] for i in range(0, len(docs), 128))
            packed = [kept for _, kept in row_packing.buffered(source, None, LENGTH, BOS, 1000)]
            ids = [[x for i, n in kept for x in (BOS, *heads[i][:n])] for kept in packed]
            return pd.DataFrame({"shard_index": key[0], "row": range(len(packed)), "n_documents": [len(k) for k in packed], "ids": [",".join(map(str, x + [BOS] * (LENGTH + 1 - len(x)))) for x in ids]})

        return own.groupBy("shard_index").applyInPandas(run, "shard_index int, row int, n_documents int, ids string")

    r.add("buffered_pack", buffered)

    def encoded(s: SparkSession, d: str) -> DataFrame:
        docs = pseudo_shards(s, d)
        merges = bpe.train_on(budget.bounded_bpe_corpus(docs.where("split = 'train'"), 500, 200_000, 2000), 256 + 200)
        return bpe.encoded(docs, merges).select("doc_id", F.size("ids").alias("tokens"), F.array_join("ids", ",").alias("ids"))

    r.add("bpe_encode", encoded)
    r.add("bpe_merges", lambda s, d: s.createDataFrame(bpe_rounds.train_over(table(s, d, "documents"), 256 + 256), "rank int, left int, right int, token int, count long"))
    r.add("bpe_chunk_counts", lambda s, d: bpe.chunk_counts(table(s, d, "documents")))
