"""Queries over listings, guards and report names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters, formulas
from ..operators import bpb, manifests, reports, scoring
from ..registry import Registry
from ..sources.shards import table


def listing(s: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    file = F.struct(F.lit("set").alias("dataset"), F.col("lang").alias("config"), F.when(k % 8 == 7, "test").otherwise("train").alias("split"), F.concat(F.lit("u"), k.cast("string")).alias("url"), F.concat(F.lpad((k % 100).cast("string"), 4, "0"), F.lit(".parquet")).alias("filename"), F.col("n_chars").alias("size"))
    files = table(s, d, "documents").groupBy("source").agg(F.collect_list(file).alias("parquet_files"))
    return files.withColumns({"partial": F.lit(False), "pending": F.array().cast("array<string>"), "failed": F.array().cast("array<string>")})


def register(r: Registry) -> None:
    r.add("hub_shards", lambda s, d: reports.hub_shards(listing(s, d), "set", "en", "test"), """
        SELECT DISTINCT lpad(CAST(doc_id % 100 AS VARCHAR), 4, '0') || '.parquet' AS filename, 'u' || doc_id AS url, n_chars AS size FROM documents WHERE lang = 'en' AND doc_id % 8 = 7""")
    status = lambda: F.get(F.array(*[F.lit(x) for x in ("ready", "downloaded", "skipped", "planned")]), (F.col("doc_id") % 4).cast("int"))
    r.add("download_summary", lambda s, d: reports.download_summary(table(s, d, "documents").select(status().alias("status"), F.col("n_chars").alias("n_bytes"))), """
        SELECT count(*) AS planned, count(*) FILTER (doc_id % 4 = 0) AS ready, count(*) FILTER (doc_id % 4 = 1) AS downloaded, count(*) FILTER (doc_id % 4 = 2) AS skipped,
               CAST(sum(n_chars) FILTER (doc_id % 4 = 1) AS BIGINT) AS downloaded_bytes, CAST(sum(n_chars) FILTER (doc_id % 4 = 2) AS BIGINT) AS skipped_bytes FROM documents""")
    e = lambda: F.col("event_id")

    def scoped(s: SparkSession, d: str) -> DataFrame:
        named = table(s, d, "events").select(reports.scope(e() % 2 == 0, e() % 3 + 3, 5).alias("scope"), F.col("event_type").alias("name"), (e() % 5 == 0).alias("is_aggregate"), "value")
        return reports.scoped_metrics(named, "chat")

    r.add("scoped_metrics", scoped, """
        SELECT 'chat/' || CASE scope WHEN 'full' THEN '' ELSE scope || '/' END || event_type AS name, value FROM (SELECT *, CASE WHEN event_id % 2 = 0 AND event_id % 3 < 2 THEN 'bounded_partial' WHEN event_id % 2 = 0 THEN 'bounded' WHEN event_id % 3 < 2 THEN 'partial' ELSE 'full' END AS scope FROM events)
        WHERE scope = 'full' OR event_id % 5 != 0""")
    given = lambda: F.concat_ws(", ", F.when(e() % 2 == 0, "b"), F.lit("a"), F.when(e() % 3 == 0, "c"), F.when(e() % 7 == 0, "z"), F.lit("a"))
    r.add("canonical_names", lambda s, d: table(s, d, "events").select("event_id", F.array_join(reports.canonical_names(given(), ("a", "b", "c")), ",").alias("names")), """
        SELECT event_id, CASE WHEN event_id % 7 != 0 THEN concat_ws(',', 'a', CASE WHEN event_id % 2 = 0 THEN 'b' END, CASE WHEN event_id % 3 = 0 THEN 'c' END) END AS names FROM events""")
    words = lambda: F.array_distinct(F.split("text", " ", -1))
    wanted = lambda: F.array(F.lit("the"), F.lit("zz"), F.lit("of"))
    r.add("key_difference", lambda s, d: table(s, d, "documents").select("doc_id", *[(F.array_join(c, ",") if k == "missing" else F.size(c).cast("long")).alias(k) for k, c in reports.key_difference(words(), wanted()).items()]), """
        SELECT doc_id, array_to_string(list_sort(list_filter(['of', 'the', 'zz'], lambda x: NOT list_contains(w, x))), ',') AS missing, len(list_filter(w, lambda x: x NOT IN ('the', 'zz', 'of'))) AS unexpected
        FROM (SELECT doc_id, list_distinct(string_split(text, ' ')) AS w FROM documents)""")
    r.add("column_union", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(reports.column_union(F.array("p_brand", "p_type"), F.array(F.lit("x"), "p_brand")), ",").alias("names")), "SELECT p_partkey, p_brand || ',' || p_type || ',x' AS names FROM part WHERE p_brand != p_type AND p_brand != 'x' AND p_type != 'x'")
    r.add("repeated_keys", lambda s, d: reports.repeated(table(s, d, "documents"), "text"), "SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
    r.add("ids_in_range", lambda s, d: table(s, d, "part").select("p_partkey", reports.ids_in_range(F.array(F.lit(3), F.col("p_size")), 30).alias("ok")), "SELECT p_partkey, p_size < 30 AS ok FROM part")
    side = lambda k: {"size": F.col("p_size") % k, "brand": F.when(F.col("p_partkey") % k == 0, F.col("p_brand"))}
    r.add("comparability", lambda s, d: table(s, d, "part").select("p_partkey", reports.comparable(side(2), side(4)).alias("same")), """
        SELECT p_partkey, p_size % 2 = p_size % 4 AND (CASE WHEN p_partkey % 2 = 0 THEN p_brand END) IS NOT DISTINCT FROM (CASE WHEN p_partkey % 4 = 0 THEN p_brand END) AS same FROM part""")

    def gap(s: SparkSession, d: str) -> DataFrame:
        value, why = reports.estimate_gap(F.when(e() % 3 != 0, F.col("value")), F.when(e() % 5 != 0, F.lit(1.0)))
        return table(s, d, "events").select("event_id", value.alias("gap"), why.alias("reason"))

    r.add("estimate_gap", gap, "SELECT event_id, CASE WHEN event_id % 3 != 0 AND event_id % 5 != 0 THEN value - 1.0 END AS gap, CASE WHEN event_id % 3 = 0 THEN 'no estimate' WHEN event_id % 5 = 0 THEN 'no observation' END AS reason FROM events")
    r.add("distinct_parameters", lambda s, d: reports.distinct_parameters(table(s, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("object"), (F.col("l_partkey") * 3).alias("elements")), ["l_returnflag"]), """
        SELECT l_returnflag, count(*) AS objects, CAST(sum(l_partkey * 3) AS BIGINT) AS elements FROM (SELECT DISTINCT l_returnflag, l_partkey FROM lineitem) GROUP BY 1""")
    r.add("loader_statistics", lambda s, d: reports.loader_statistics(table(s, d, "documents").select(F.col("n_chars").alias("tokens"), (F.col("doc_id") % 6).alias("supervised")), 1024), """
        SELECT count(*) AS seen, count(*) FILTER (n_chars > 1025) AS cropped, count(*) FILTER (doc_id % 6 = 0) AS skipped, CAST(sum(least(n_chars, 1025)) FILTER (doc_id % 6 > 0) AS BIGINT) AS kept_tokens FROM documents""")
    cat = lambda s, d: table(s, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum("n_chars").alias("tokens"), F.lit(True).alias("round_trip"), F.when(F.first("lang") != "xx", F.count(F.lit(1)) * 5000).alias("base_tokens"))
    r.add("tokenizer_totals", lambda s, d: reports.category_totals(cat(s, d)).withColumn("bytes_per_token", F.round("bytes_per_token", 9)), """
        SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(n_chars) AS BIGINT) AS tokens, round(sum(strlen(text)) / sum(n_chars), 9) AS bytes_per_token, true AS round_trip FROM documents""")
    r.add("tokenizer_saving", lambda s, d: reports.compared_totals(cat(s, d)).withColumn("saving", F.round("saving", 9)), """
        SELECT CAST(sum(n_chars) AS BIGINT) AS tokens, CAST(count(*) * 5000 AS BIGINT) AS base_tokens, round((count(*) * 5000 - sum(n_chars)) / (count(*) * 5000), 9) AS saving FROM documents""")
    chars = lambda c: F.split(c, "")
    opts = lambda: F.array(chars(F.concat(F.lit("ab"), "p_brand")), chars(F.concat(F.lit("ab"), "p_type")), chars(F.concat(F.lit("ab"), "p_name")))
    r.add("scoring_spans", lambda s, d: table(s, d, "part").select("p_partkey", reports.scoring_span(opts(), F.lit("multiple_choice")).alias("start")), """
        SELECT p_partkey, CAST(2 + (SELECT count(*) FROM range(1, 60) t(i) WHERE i <= least(length(p_brand), length(p_type), length(p_name)) AND p_brand[1:i] = p_type[1:i] AND p_type[1:i] = p_name[1:i]) AS INT) AS start FROM part""")
    r.add("violation_rate", lambda s, d: table(s, d, "events").select("event_id", scoring.violation_rate(e() % 2 == 0, e() % 3 == 0).alias("rate")), "SELECT event_id, ((event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT) / 2.0::DOUBLE AS rate FROM events")
    r.add("token_byte_lengths", lambda s, d: bpb.byte_lengths(s), "SELECT CAST(i AS INT) AS token_id, CAST(CASE WHEN i < 256 THEN 1 ELSE 0 END AS INT) AS n_bytes FROM range(265) t(i)")
    r.add("payload_width", lambda s, d: s.range(3).select("id", F.when(F.col("id") == 0, manifests.token_width(65_535)).otherwise(manifests.token_width(65_536)).alias("width")), "SELECT i AS id, CAST(CASE WHEN i = 0 THEN 2 ELSE 4 END AS INT) AS width FROM range(3) t(i)")
    r.add("right_padding", lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(scoring.right_padded(F.sequence(F.lit(1), F.col("p_size").cast("int")), F.lit(30), 0), ",").alias("ids")), """
        SELECT p_partkey, array_to_string(list_concat(range(1, p_size + 1), list_transform(range(0, greatest(30 - p_size, 0)), lambda x: 0)), ',') AS ids FROM part""")

    def arc(s: SparkSession, d: str) -> DataFrame:
        w = F.slice(F.split("text", " ", -1), 1, 3)
        rows = table(s, d, "documents").select(F.col("text").alias("question"), F.struct(F.array(F.lit("A"), F.lit("B"), F.when(F.col("doc_id") % 3 == 0, "A").otherwise("C")).alias("label"), w.alias("text")).alias("choices"), F.when(F.col("doc_id") % 2 == 0, "B").otherwise("D").alias("answerKey"))
        return adapters.arc(rows).select("prompt", "answer", "error")

    r.add("arc_rows", arc, """
        SELECT CASE WHEN ok THEN 'Multiple Choice question: ' || text || chr(10) || array_to_string(list_transform(w, lambda c, i: '- ' || c || '=' || ['A','B','C'][i] || chr(10)), '') || chr(10) || 'Respond only with the letter of the correct answer.' END AS prompt,
               CASE WHEN ok THEN 'B' END AS answer, CASE WHEN NOT ok THEN 'malformed row' END AS error FROM (SELECT text, w, len(w) = 3 AND doc_id % 3 != 0 AND doc_id % 2 = 0 AS ok FROM (SELECT *, string_split(text, ' ')[1:3] AS w FROM documents))""")
    r.add("centered_formula", lambda s, d: table(s, d, "events").select("event_id", F.round(formulas.centered(F.col("value"), F.lit(0.25)), 9).alias("centered")), "SELECT event_id, round((value - 0.25) / 0.75, 9) AS centered FROM events")
