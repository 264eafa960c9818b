"""Queries that write what they derive from the tables, and read it back: conversations, tokenized datasets, streams; checks of caches and decoded texts."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bpb, byte_pairs, evaluate, runs, tokenized
from ..registry import Registry
from ..session import STREAMING
from ..sources import cache, documents, jsonl
from ..sources.scratch import shared_dir
from ..sources.shards import table, with_split
from ..streaming import logs, sinks
from .evaluation import LOG, log
from .tokens import BYTES, ids

VOCABULARY = 265
SHARDS = f"SELECT CASE WHEN doc_id % 8 = 7 THEN 'val' ELSE 'train' END AS split, CAST(doc_id % 8 AS INT) AS shard_index, doc_id, ids FROM ({BYTES})"


def place(s: SparkSession, name: str) -> str:
    """A new folder; it stays until the shared folder is cleared, as results are read later."""
    return f"{shared_dir(s)}/tessera/{name}-{uuid.uuid4().hex}"


def messages(s: SparkSession, d: str) -> DataFrame:
    """Whole conversations; an assistant's text of even length is followed by a part of code."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    coded = lambda x: (x["role"] == "assistant") & (F.length(x["text"]) % 2 == 0)
    parts = lambda x: F.when(coded(x), F.array(part("text", x["text"]), part("python", F.lit("1+1")))).otherwise(F.array(part("text", x["text"])))
    turns = table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select("conv_id", F.transform("turns", lambda x: F.struct(x["role"].alias("role"), parts(x).alias("parts"))).alias("messages"))


def conversation_lines(s: SparkSession, d: str) -> DataFrame:
    """Conversations as JSON lines and back through the strict reader; two of eleven lines are spoilt on the way."""
    convs, kind = messages(s, d), F.col("conv_id") % 11
    lines = jsonl.written_as(convs.where(kind > 1))
    lines = lines.union(jsonl.written_as(convs.where(kind == 0)).select(F.expr("left(value, length(value) - 1)")))
    lines = lines.union(jsonl.written_as(convs.where(kind == 1)).select(F.regexp_replace("value", r'"schema_version":1\}$', '"schema_version":2}')))
    path = place(s, "conversations")
    lines.write.text(path)
    read = jsonl.read_conversations(s, path)
    flat = F.flatten(F.transform("messages", lambda m: F.transform(m["parts"], lambda p: F.concat(p["type"], F.lit("="), p["text"]))))
    return read.select(F.col("error").isNull().alias("sound"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.sha2(F.array_join(flat, "\n").cast("binary"), 256).alias("parts_sha256"))


def encode(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", byte_pairs.byte_encode(F.col("text")).alias("ids"))


def dataset(s: SparkSession, d: str) -> str:
    """All documents as a tokenized dataset of eight shards."""
    path = place(s, "tokenized")
    tokenized.write(with_split(table(s, d, "documents").select("doc_id", "text"), "doc_id", 8), encode, path, VOCABULARY)
    return path


def stored(s: SparkSession, d: str) -> DataFrame:
    """What a dataset would hold had some documents got an id more, and others been lost."""
    kept = encode(table(s, d, "documents")).where("doc_id % 17 != 0")
    return kept.withColumn("ids", F.when(F.col("doc_id") % 13 == 0, F.concat("ids", F.array(F.lit(0)))).otherwise(F.col("ids")))


def streamed(s: SparkSession, d: str) -> DataFrame:
    """Events, a tenth of them twice, as a stream of files that a sink appends once; the query ends and starts again with later files."""
    for k, v in STREAMING.items():
        s.conf.set(k, v)
    events = table(s, d, "events").select("event_id", "user_id", "event_type", "value")
    source, out, state = place(s, "events"), place(s, "appended"), place(s, "state")
    for part in (events.where("event_id % 3 != 0"), events.where("event_id % 3 = 0 OR event_id % 10 = 0")):
        part.write.mode("append").parquet(source)
        arriving = logs.replayed(s, source, "event_id long, user_id long, event_type string, value double", files_per_trigger=64)
        sinks.appended_once(arriving, out, state, buckets=32).awaitTermination()
    return s.read.schema(events.schema).parquet(out)


def snapshots(s: SparkSession, d: str) -> DataFrame:
    """A summary document for each run of the log, six of nine unsound in one field; every fourth run has an evaluation that isn't one."""
    u = F.col("run")
    kind = lambda *k: (u % 9).isin(*k)
    own = log(s, d).groupBy("run").agg(F.max("step").alias("step"))
    name, at = F.concat(F.lit("r"), u.cast("string")), F.concat(F.lit("/runs/"), u.cast("string"))
    run = F.struct(F.when(kind(0), "other").otherwise(name).alias("name"), F.when(kind(3), "/other").otherwise(F.concat(at, F.lit("/"))).alias("output_dir"), F.lit("base").alias("stage"))
    summary = F.to_json(F.struct(F.struct(F.lit(0.5).alias("loss")).alias("latest_metrics"), (F.col("step") + F.when(kind(1), 1).otherwise(0)).cast("long").alias("latest_step"), run.alias("run"), F.when(kind(2), 2).otherwise(1).alias("schema_version"), F.when(kind(5), "done").otherwise("completed").alias("status")))
    spoilt = F.when(kind(4), summary.substr(F.lit(1), F.length(summary) - 1)).otherwise(summary)
    evaluation = F.when(u % 4 == 0, F.lit('{"status":"completed"}'))
    rows = own.select(name.alias("run"), at.alias("run_dir"), spoilt.alias("summary"), evaluation.alias("evaluation"))
    found = documents.snapshots(rows, log(s, d).withColumn("run", name), "evaluation")
    return found.withColumn("fault", F.regexp_extract("fault", r"^(\S+ \S+)", 1))


def register(r: Registry) -> None:
    r.add("run_snapshots", snapshots, f"""
        SELECT 'r' || u AS run, CASE u % 9 WHEN 4 THEN NULL WHEN 5 THEN 'done' ELSE 'completed' END AS status, CASE u % 9 WHEN 4 THEN NULL WHEN 1 THEN step + 1 ELSE step END AS latest_step,
               CASE u % 9 WHEN 0 THEN 'summary $.run.name' WHEN 1 THEN 'summary $.latest_step' WHEN 2 THEN 'summary $.schema_version' WHEN 3 THEN 'summary $.run.output_dir' WHEN 4 THEN 'summary $' WHEN 5 THEN 'summary $.status' ELSE CASE WHEN u % 4 = 0 THEN 'evaluation $' END END AS fault
        FROM (SELECT run AS u, max(step) AS step FROM ({LOG}) GROUP BY run)""")
    r.add("conversation_lines", conversation_lines, """
        WITH t AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS r, list('text=' || text || CASE WHEN role = 'assistant' AND length(text) % 2 = 0 THEN chr(10) || 'python=1+1' ELSE '' END ORDER BY turn, role, text) AS p FROM conversations GROUP BY conv_id),
        u AS (SELECT *, CASE WHEN r[1] = 'system' THEN r[2:] ELSE r END AS turns FROM t),
        v AS (SELECT *, conv_id % 11 > 1 AND len(turns) > 0 AND len(list_filter(turns, lambda x, i: x != CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS sound FROM u)
        SELECT sound, CASE WHEN sound THEN array_to_string(r, ',') END AS roles, CASE WHEN sound THEN sha256(array_to_string(p, chr(10))) END AS parts_sha256 FROM v""")

    r.add("tokenized_manifest", lambda s, d: s.read.parquet(f"{dataset(s, d)}/manifest"), f"""
        WITH e AS (SELECT split, shard_index, len(ids) AS n, CAST('0x' || sha256(doc_id || ':' || coalesce(array_to_string(ids, ','), ''))[1:15] AS BIGINT) AS c FROM ({SHARDS}))
        SELECT *, tokens * 2 AS bytes, CAST(2 AS INT) AS width FROM (
            SELECT split, shard_index, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens, bit_xor(c) AS content FROM e GROUP BY ALL
            UNION ALL SELECT split, CAST(-1 AS INT), count(*), CAST(sum(n) AS BIGINT), NULL FROM e GROUP BY split
            UNION ALL SELECT 'total', CAST(-1 AS INT), count(*), CAST(sum(n) AS BIGINT), NULL FROM e)""")
    r.add("tokenized_rows", lambda s, d: tokenized.read(s, dataset(s, d), VOCABULARY).withColumn("ids", F.array_join("ids", ",")), f"SELECT split, shard_index, doc_id, array_to_string(ids, ',') AS ids FROM ({SHARDS})")
    r.add("retokenised", lambda s, d: tokenized.retokenised(stored(s, d), table(s, d, "documents"), encode), "SELECT doc_id FROM documents WHERE doc_id % 13 = 0 OR doc_id % 17 = 0")

    k = lambda: F.col("p_partkey")
    files = lambda s, d, n, more: table(s, d, "part").where(k() % n != 0).select(F.concat(F.lit("shard_"), k(), F.lit(".parquet")).alias("file_name"), (F.col("p_size") + F.when(k() % more == 0, 1).otherwise(0)).alias("n_bytes"), F.concat(F.lit("sha256:"), F.sha2(F.concat("p_name", F.when(k() % (more + 8) == 0, "!").otherwise("")).cast("binary"), 256)).alias("identity"))
    r.add("cache_faults", lambda s, d: cache.faults(files(s, d, 5, 3), files(s, d, 7, 4)), """
        SELECT 'shard_' || k || '.parquet' AS file_name, CASE WHEN k % 5 = 0 THEN 'missing' WHEN k % 7 = 0 THEN 'unexpected' ELSE 'changed' END AS fault FROM (SELECT p_partkey AS k FROM part)
        WHERE k % 5 != 0 AND k % 7 != 0 AND ((k % 3 = 0) != (k % 4 = 0) OR (k % 11 = 0) != (k % 12 = 0)) OR (k % 5 = 0) != (k % 7 = 0)""")

    r.add("byte_decode", lambda s, d: ids(s, d).select("doc_id", byte_pairs.byte_decode("ids").alias("text")), "SELECT doc_id, text FROM documents")
    decode = lambda rows: rows.select("doc_id", byte_pairs.byte_decode("ids").alias("text"))
    r.add("tokenizer_report", lambda s, d: evaluate.tokenizer_report(table(s, d, "documents").select(F.col("lang").alias("category"), "doc_id", "text"), encode, decode), """
        SELECT lang AS category, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(strlen(text)) AS BIGINT) AS tokens, true AS round_trip, 1.0::DOUBLE AS bytes_per_token FROM documents GROUP BY lang""")

    def assistant(s: SparkSession, d: str) -> DataFrame:
        """Bytes of assistant turns as labels, a third of them masked, with losses by value."""
        turns = table(s, d, "conversations").where("role = 'assistant'").select(byte_pairs.byte_encode(F.col("text")).alias("ids"))
        rows = turns.select(bpb.mask_targets("ids", F.transform("ids", lambda x: x % 3 != 0)).alias("labels"), F.transform("ids", lambda x: (x % 7 + 1) / F.lit(8.0)).alias("losses"), F.lit(1).alias("n_conversations"))
        return evaluate.assistant_bpb(rows, bpb.byte_lengths(s)).withColumns({c: F.round(c, 6) for c in ("nats", "bpb")})

    r.add("assistant_bpb", assistant, """
        WITH b AS (SELECT unnest(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(('0x' || x) AS INT))) AS x FROM conversations WHERE role = 'assistant'),
        n AS (SELECT sum((x % 7 + 1) / 8) AS nats, count(*) AS k FROM b WHERE x % 3 != 0)
        SELECT round(nats, 6) AS nats, k AS tokens, k AS bytes, round(nats / ln(2) / k, 6) AS bpb, (SELECT count(*) FROM conversations WHERE role = 'assistant') AS conversations FROM n""")

    def bounded(s: SparkSession, d: str) -> DataFrame:
        events = table(s, d, "events")
        results = events.select(F.col("event_type").alias("task"), F.col("event_id").alias("example"), (F.col("value") > 20).alias("correct"))
        baselines = events.groupBy(F.col("event_type").alias("task")).agg(F.lit(0.25).alias("baseline"))
        return evaluate.task_accuracy(results, baselines, most=50).withColumns({c: F.round(c, 9) for c in ("accuracy", "centered")})

    r.add("bounded_accuracy", bounded, """
        SELECT event_type AS task, count(*) AS evaluated, count(*) FILTER (value > 20) AS passed, round(count(*) FILTER (value > 20) / count(*), 9) AS accuracy, 0.25::DOUBLE AS baseline, round((count(*) FILTER (value > 20) / count(*) - 0.25) / 0.75, 9) AS centered, true AS bounded
        FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) WHERE i <= 50 GROUP BY event_type""")
    r.add("streamed_append", streamed, "SELECT event_id, user_id, event_type, value FROM events")

    def contents(start: np.ndarray, inputs: np.ndarray, targets: np.ndarray) -> dict[str, np.ndarray]:
        """All inputs and targets of windows, weighed by their place in it and by its start."""
        digest = lambda x: sum(x[:, p] * (p + 1) for p in range(x.shape[1]))
        return {"inputs": (start % 1000 + 1) * digest(inputs), "targets": (start % 1000 + 1) * digest(targets)}

    def windows(s: SparkSession, d: str) -> DataFrame:
        """Every window of 16, over the bytes of whole texts."""
        texts = table(s, d, "documents").select("doc_id", F.encode("text", "utf-8").alias("ids"))
        each = byte_pairs.summed_windows(texts, 16, contents, ["inputs", "targets"])
        return each.groupBy("doc_id").agg(*[F.sum(c).alias(c) for c in ("windows", "inputs", "targets")])

    r.add("window_contents", windows, f"""
        WITH t AS (SELECT doc_id, len(ids) AS n, unnest(ids) AS id, unnest(range(0, len(ids))) AS pos FROM ({BYTES}) WHERE len(ids) > 16)
        SELECT doc_id, max(n) - 16 AS windows, CAST(sum(CASE WHEN pos - p BETWEEN 0 AND n - 17 THEN ((pos - p) % 1000 + 1) * (p + 1) * id ELSE 0 END) AS BIGINT) AS inputs,
               CAST(sum(CASE WHEN pos - 1 - p BETWEEN 0 AND n - 17 THEN ((pos - 1 - p) % 1000 + 1) * (p + 1) * id ELSE 0 END) AS BIGINT) AS targets FROM t, range(16) r(p) GROUP BY doc_id""")

    def steps(s: SparkSession, d: str) -> DataFrame:
        return runs.aligned_all(log(s, d)).select("step", "n_runs", F.array_join(F.transform("values", lambda x: F.concat_ws("=", x["run"].cast("string"), F.round(x["value"] * 100).cast("long").cast("string"))), ",").alias("values"))

    r.add("step_alignment_all", steps, f"""
        SELECT step, count(*) AS n_runs, string_agg(run || '=' || CAST(round(value * 100) AS BIGINT), ',' ORDER BY run) AS values FROM (SELECT step, run, max(value) AS value FROM ({LOG}) GROUP BY ALL) GROUP BY step""")
