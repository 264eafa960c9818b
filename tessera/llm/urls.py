"""URL filter: rules first, then naive Bayes on segmented host names and path words.

Host names run words together. A unigram Viterbi search splits each distinct name into the most
likely words; word counts come from all URLs of the table (path words and what stands between dots and
hyphens in hosts) on top of a fixed lexicon. Substrings of names meet the counts in a join,
so the lexicon may be of any size. A multinomial naive Bayes model is then trained on tokens
of all URLs: a URL counts as unwanted in training if a segmented token is a seed word, and the
model extends this to words that keep their company. Token weights live in a fixed number of
hash buckets. Segmentations come back to the URLs by a join on (host, salt), so a host that
a third of all URLs share is dealt out.

Defined results: a null URL, or one without "://", has an empty host and path and is allowed unless
its tokens say otherwise (it has none); null and repeated ids and repeated rows are judged row by
row; of rules of equal length the first listed wins; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, record, table, written

#: (verdict, host and path of the rule)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: Words of unwanted sites, the seeds of training (fixed values).
SEEDS = ("adult", "ads", "bet", "bets", "betting", "casino", "porn", "xxx", "sex", "spam", "pills", "viagra", "poker", "slots", "track", "tracker", "malware", "phishing", "warez", "torrent", "jackpot", "escort")
#: Common words of host names beside the seeds (fixed values).
COMMON = ("free", "cheap", "win", "farm", "online", "news", "blog", "shop", "store", "example", "www", "mail", "best", "buy", "home", "world", "book", "books", "school", "health", "city", "data", "web", "site", "page", "live", "games", "game", "the", "and", "for", "page", "en", "de", "fr", "es", "m", "x", "a", "of", "my", "to", "in")
PRIOR_COUNT, LONGEST, BUCKETS, SALTS = 50, 24, 1 << 14, 16
#: Added to each count of a bucket; small, as most buckets stay empty.
SMOOTHING = 0.01


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    # the last alternative that is put in front is tried first: lengths ascend
    for said, name in sorted(reversed(rules), key=lambda r: len(r[1])):
        own, _, rest = name.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def runs(text: Column) -> Column:
    """Runs of small letters; numbers say nothing here."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def viterbi(name: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely words of a name; an unknown word of n letters costs as much as n + 1 rare ones."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get(name[start:end])
            cost = math.log(total / n) if n else (end - start + 1) * math.log(total)
            options.append((best[start][0] + cost, start))
        best.append(min(options))
    words, end = [], len(name)
    while end:
        start = best[end][1]
        words.append(name[start:end])
        end = start
    return words[::-1]


def segmented(urls: DataFrame) -> DataFrame:
    """``host, words`` for each distinct host of ``urls`` (columns host, path)."""
    spark = urls.sparkSession
    hosts = written(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where("host != ''"), "hosts")
    lexicon = spark.createDataFrame([(w, PRIOR_COUNT) for w in sorted({*SEEDS, *COMMON})], "word string, n long")
    words = urls.select(F.explode(runs(F.col("path"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    whole = hosts.select(F.explode(runs(F.col("host"))).alias("word"), F.lit(1).cast("long").alias("n"))
    counts = words.union(whole).union(lexicon).groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "url_words")
    total = float(counts.agg(F.sum("n")).first()[0])
    names = hosts.select(F.explode(F.array_distinct(runs(F.col("host")))).alias("name")).distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start")
    spans = names.select("name", starts).select("name", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("start") + 1)), lambda k: F.substring("name", F.col("start"), k))).alias("word")).distinct()
    # at most 24 substrings a letter, so a name's group is bounded by the name
    known = names.join(spans.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known")), "name", "left")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for name, own in zip(b["name"].to_pylist(), b["known"].to_pylist(), strict=True):
            # a whole name that nothing but its own host attests is no evidence for itself
            at_hand = {k["word"]: k["n"] for k in own or () if k["word"] != name or k["n"] > 1 or len(own) == 1}
            out.append(viterbi(name, at_hand, total))
        return record(name=b["name"], words=pa.array(out, pa.list_(pa.string())))

    split = arrow_map(known, run, "name string, words array<string>")
    parts = hosts.select("host", F.posexplode(runs(F.col("host"))).alias("at", "name")).join(split, "name")
    return parts.groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is the method's log odds of being unwanted."""
    url = F.col("url")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    base = base.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = segmented(base).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    joined = salted.join(hosts, ["host", "salt"], "left")
    tokens = F.concat(F.coalesce("words", F.array().cast("array<string>")), runs(F.col("path")))
    full = written(joined.select("page_id", "host", "path", tokens.alias("tokens")), "url_tokens")
    bad = F.exists("tokens", lambda t: t.isin(*seeds)).alias("bad")
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int").alias("bucket")
    counts = full.select(bad, F.explode("tokens").alias("token")).groupBy("bad", bucket).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 * BUCKETS rows
    classes = {r["bad"]: r["n"] for r in full.groupBy(bad).agg(F.count(F.lit(1)).alias("n")).collect()}
    table_ = np.full((2, BUCKETS), SMOOTHING)
    for r in counts:
        table_[int(r["bad"]), r["bucket"]] += r["n"]
    weights = np.log(table_[1] / table_[1].sum()) - np.log(table_[0] / table_[0].sum())
    prior = math.log((classes.get(True, 0) + 1) / (classes.get(False, 0) + 1))
    hashed = full.select("page_id", "host", "path", F.transform("tokens", lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")).alias("at"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        score = [prior + float(weights[x].sum()) if x else prior for x in b["at"].to_pylist()]
        return record(page_id=b["page_id"], host=b["host"], path=b["path"], score=pa.array(score, pa.float64()))

    scored = arrow_map(hashed, run, "page_id long, host string, path string, score double")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("score") > 0) & (F.col("host") != ""), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "score")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
