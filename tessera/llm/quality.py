"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

Symbols are the characters themselves, of any script; before a word that repeats the one before it, a
symbol of its own stands for the space. Counts of n-grams come from all documents that labels trust, but for those
held out; they are summed by n-gram over the cluster. Each order's discounts, contexts and interpolated
probabilities are aggregates and joins on n-grams, so the model may be of any size and grows with the
trusted text.

Documents meet the model a shard at a time. A shard holds what is needed after certain pairs of
characters, so each position of a text is scored in one shard, with all its back-off. A shard has a
bounded number of entries and is broadcast; a pass over the texts gives each document's part of the
log-likelihood, and the parts are summed. (Single characters and pairs go to every shard.)

A document is rejected when its perplexity exceeds its language's threshold, a quantile of the
perplexities of trusted documents of the language that were held out of training.

Defined results: null and empty texts have no symbols, perplexity null, and are kept (there is
nothing to hold against them); a null language, or one with fewer than ``LEAST_HELD`` documents held
out, has the threshold of all languages together; several labels for an id trust it if all do; a null id
is scored, never trained on; repeated rows are scored alike; texts may be of any length; without any
trusted document everything is kept, with perplexity null; an empty table gives an empty result;
other columns are kept by ``filtered``, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import released
from .common import ROWS, possibly, record, sliced, table, tidy, whole_rows, written

ORDER = 5
#: What stands before a text, and between a word and its repetition.
BOS, REPEAT = "\x02", "\x03"
PAD = BOS * (ORDER - 1)
#: Every FOLDS-th trusted document is held out for the thresholds.
FOLDS, QUANTILE, LEAST_HELD = 5, 0.99, 30
#: Characters at the trusted mean that are added to each document, so that a few words decide nothing.
SHRINK = 60
#: Entries of a shard, 12 bytes each; characters that a worker takes at a time.
SHARD, CHARS = 4_000_000, 300_000

#: Odd multipliers of characters by their distance from the last one, and of n-grams by their length.
_BY_PLACE = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(ORDER)], dtype="u8")
_BY_LENGTH = np.array([pow(0xD1342543DE82EF95, 2 * i + 3, 1 << 64) for i in range(ORDER + 1)], dtype="u8")


def symbols(text: str) -> str:
    """The text with ``REPEAT`` for the space before each word that repeats the one before it."""
    words = text.split(" ")
    if any(map(eq, words, words[1:])):
        return "".join([words[0], *((REPEAT if a == b and b else " ") + b for a, b in zip(words, words[1:], strict=False))])
    return text


class Windows:
    """Texts, padded and one after another, and the sums that identify the n-grams at each place."""

    def __init__(self, texts: Sequence[str]) -> None:
        self.text = "".join([PAD + t for t in texts])
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("u8") + np.uint64(1)
        size = np.array([len(t) for t in texts], dtype="i8")
        #: The places of symbols, and how many of them come before each text's end.
        self.places = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1) * len(PAD), size)
        self.ends = np.cumsum(size)
        self.codes = codes
        self.sums = [np.zeros(len(codes), dtype="u8")]
        for k in range(ORDER):
            own = codes * _BY_PLACE[k]
            own[k:] = own[: len(own) - k].copy()
            self.sums.append(self.sums[-1] + own)

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """(a place of each distinct window of ``ORDER`` symbols, the window of each symbol)."""
        found = pa.array(self.sums[ORDER][self.places]).dictionary_encode()
        of = found.indices.to_numpy()
        at = np.empty(len(found.dictionary), dtype="i8")
        at[of[::-1]] = self.places[::-1]
        return at, of

    def hashes(self, at: np.ndarray, length: int) -> np.ndarray:
        """Of the n-grams of ``length`` symbols that end at places."""
        return self.sums[length][at] * _BY_LENGTH[length] + _BY_LENGTH[length - 1]

    def shard(self, at: np.ndarray, shards: int) -> np.ndarray:
        """Where the symbols at places are scored: by the two symbols before them."""
        return shard_of(self.codes[at - 2], self.codes[at - 1], shards)


def shard_of(a: np.ndarray, b: np.ndarray, shards: int) -> np.ndarray:
    mixed = (a * _BY_PLACE[1] + b * _BY_PLACE[2]) * _BY_LENGTH[1]
    return ((mixed >> np.uint64(33)) % np.uint64(shards)).astype("i4")


def grouped(texts: Sequence[str]) -> Iterator[list[str]]:
    """Texts in lists of about ``CHARS`` characters."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


# training


def trusted_ids(labels: DataFrame) -> DataFrame:
    ok = F.coalesce(F.col("quality") == 1, F.lit(False)) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(ok).alias("ok")).where("ok").select(F.col("doc_id").cast("long").alias("id"))


def held_out(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FOLDS)) == 0


def top_counts(docs: DataFrame) -> DataFrame:
    """``gram, c``: how often each window of ``ORDER`` symbols occurs in ``docs`` (column text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 10_000):
            for texts in grouped([symbols(t) for t in b["text"].to_pylist() if t]):
                w = Windows(texts)
                at, of = w.distinct()
                yield record(gram=pa.array([w.text[i - ORDER + 1 : i + 1] for i in at.tolist()], pa.string()), n=pa.array(np.bincount(of), pa.int64()))

    return docs.select("text").mapInArrow(tidy(run), "gram string, n long").groupBy("gram").agg(F.sum("n").alias("c"))


def discounts(n: Sequence[int]) -> list[float]:
    """Discounts for counts 1, 2 and 3 or more, from how many n-grams occur once to four times."""
    if min(n) == 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3)]
    return [min(max(d, 0.05), k - 0.05) for k, d in enumerate(raw, 1)]


class Model(NamedTuple):
    """``entries``: gram, p (null for contexts of a beginning), g (the weight that its unseen continuations share; null if it never is a context)."""

    entries: DataFrame
    rows: int
    unknown: float


def estimated(counts: DataFrame) -> Model | None:
    """Probabilities of all orders from a written table of the highest order's counts; None without any."""
    tables = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # in how many contexts an n-gram occurs
        tables[k] = written(tables[k + 1].groupBy(F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c")), "kn_counts")
    rows, entries, below, unknown = 0, {}, None, 0.0
    for k in range(1, ORDER + 1):
        own = tables[k]
        facts = own.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.lit(1)).alias("rows"), F.sum("c").alias("total")).first()
        if not facts["rows"]:
            return None
        d = discounts([facts[f"n{i}"] for i in (1, 2, 3, 4)])
        rows += facts["rows"]
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        if k == 1:
            many = facts["rows"] - facts["n1"] - facts["n2"]
            left = (facts["n1"] * d[0] + facts["n2"] * d[1] + many * d[2]) / facts["total"]
            lowest = left / (facts["rows"] + 1)  # all symbols seen, and one for those that weren't
            unknown = math.log(lowest)
            p = own.select("gram", ((F.col("c") - cut) / float(facts["total"]) + lowest).alias("p"))
        else:
            contexts = written(own.groupBy(F.substring("gram", 1, k - 1).alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("left")).select("h", "total", (F.col("left") / F.col("total")).alias("g")), "kn_contexts")
            entries[k - 1] = below.join(contexts.select(F.col("h").alias("gram"), "g"), "gram", "full")  # no n-gram ends before a text begins, but contexts do
            cols = own.select("gram", "c", F.substring("gram", 1, k - 1).alias("h"), F.substring("gram", 2, k - 1).alias("s"))
            p = cols.join(contexts, "h").join(below.select(F.col("gram").alias("s"), F.col("p").alias("q")), "s").select("gram", ((F.col("c") - cut) / F.col("total") + F.col("g") * F.col("q")).alias("p"))
        below = written(p, "kn_order")
    entries[ORDER] = below.withColumn("g", F.lit(None).cast("double"))
    return Model(reduce(DataFrame.union, [entries[k].select("gram", "p", "g") for k in sorted(entries)]), rows, unknown)


# scoring


class Table(NamedTuple):
    """Sorted hashes with values."""

    keys: np.ndarray
    values: np.ndarray

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, its value or 0)."""
        if not len(self.keys):
            return np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        order = np.argsort(hashes)
        at = np.empty(len(hashes), dtype="i8")
        at[order] = np.minimum(np.searchsorted(self.keys, hashes[order]), len(self.keys) - 1)
        there = self.keys[at] == hashes
        return there, np.where(there, self.values[at], 0.0)


def scores(w: Windows, at: np.ndarray, p: Table, g: Table, unknown: float) -> np.ndarray:
    """-log P of the symbols at places, each given the symbols before it."""
    out, carried, open_ = np.full(len(at), unknown), np.zeros(len(at)), np.arange(len(at))
    for k in range(ORDER, 0, -1):
        there, value = p.found(w.hashes(at[open_], k))
        out[open_[there]] = carried[open_[there]] + value[there]
        open_ = open_[~there]
        if k > 1:
            carried[open_] += g.found(w.hashes(at[open_] - 1, k - 1))[1]
    out[open_] += carried[open_]
    return -out


SHARDED = "role int, shard int, hash long, value float"


def sharded(model: Model, shards: int) -> DataFrame:
    """Written entries by shard; shard -1 goes to all. Role 0: probabilities, role 1: back-off weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 50_000):
            grams, p, g = b["gram"].to_pylist(), b["p"].to_numpy(zero_copy_only=False), b["g"].to_numpy(zero_copy_only=False)
            size = np.array([len(x) for x in grams])
            w = Windows([])
            for role, value, shift in ((0, p, 1), (1, g, 0)):  # what comes after a context is scored where the context is
                hash_, shard = np.empty(len(grams), dtype="u8"), np.full(len(grams), -1, dtype="i4")
                for k in np.unique(size):
                    of = np.flatnonzero(size == k)
                    codes = np.frombuffer("".join([grams[i] for i in of]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype("u8").reshape(-1, k) + np.uint64(1)
                    sums = (codes[:, ::-1] * _BY_PLACE[:k]).sum(axis=1, dtype="u8")
                    w.sums = [sums] * (ORDER + 1)
                    hash_[of] = w.hashes(np.arange(len(of)), int(k))
                    if k - shift >= 2:
                        shard[of] = shard_of(codes[:, k - shift - 2], codes[:, k - shift - 1], shards)
                own = np.flatnonzero(~np.isnan(value))
                yield record(role=pa.array(np.full(len(own), role), pa.int32()), shard=pa.array(shard[own]), hash=pa.array(hash_[own].astype("i8")), value=pa.array(np.log(value[own]).astype("f4")))

    return written(model.entries.mapInArrow(tidy(run), SHARDED), "kn_shards")


PARTS = "id long, lang string, k1 long, k2 long, n long, nll double"


def likelihoods(base: DataFrame, model: Model, shard_rows: int = SHARD) -> DataFrame:
    """Written ``id, lang, k1, k2, n, nll`` of each distinct row of ``id, lang, k1, k2, text``, as often as it occurs in ``times``."""
    shards = max(1, math.ceil(2 * model.rows / shard_rows))
    entries, unknown, parts = sharded(model, shards), model.unknown, []
    for s in range(shards):  # one at a time, so driver and workers hold one shard
        own = entries.where(F.col("shard").isin(s, -1)).toArrow()
        role, hash_, value = (own[c].to_numpy() for c in ("role", "hash", "value"))
        tables = []
        for r in (0, 1):
            of = np.flatnonzero(role == r)
            keys = hash_[of].astype("u8")
            order = np.argsort(keys)
            tables.append((keys[order], value[of][order]))
        shared = base.sparkSession.sparkContext.broadcast(tables)

        def run(batches: Iterator[pa.RecordBatch], s=s, shared=shared) -> Iterator[pa.RecordBatch]:
            released()  # workers are used again, also after packing
            p, g = (Table(*t) for t in shared.value)
            for b in sliced(batches, 1000):
                n, nll = [], []
                for texts in grouped([symbols(t) for t in b["text"].to_pylist()]):
                    w = Windows(texts)
                    at, of = w.distinct()
                    mine = np.flatnonzero(w.shard(at, shards) == s)
                    each, counts = np.zeros(len(at)), np.zeros(len(at), dtype="i8")
                    each[mine], counts[mine] = scores(w, at[mine], p, g, unknown), 1
                    for out, x in ((nll, each), (n, counts)):
                        sums = np.concatenate([np.zeros(1, x.dtype), np.cumsum(x[of])])[np.append(0, w.ends)]
                        out += np.diff(sums).tolist()
                yield record(id=b["id"], lang=b["lang"], k1=b["k1"], k2=b["k2"], n=pa.array(n, pa.int64()), nll=pa.array(nll, pa.float64()))

        parts.append(written(base.select("id", "lang", "k1", "k2", "text").mapInArrow(tidy(run), PARTS), "kn_scores", rows=ROWS))
        shared.destroy()
    times = F.count(F.lit(1)) / F.lit(float(shards))  # equal rows have equal parts
    every = reduce(DataFrame.union, parts).groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("lang").alias("lang"), times.cast("long").alias("times"), F.sum("n").alias("n"), F.sum("nll").alias("nll"))
    return written(every.select("id", "lang", "k1", "k2", "times", (F.col("n") / F.col("times")).cast("long").alias("n"), (F.col("nll") / F.col("times")).alias("nll")), "perplexities")


def perplexity(mean: Column) -> Column:
    """exp of the mean negative log-likelihood, with ``SHRINK`` symbols at the language's mean added; null without symbols."""
    return F.when(F.col("n") > 0, F.exp((F.col("nll") + SHRINK * mean) / (F.col("n") + SHRINK)))


def limits(found: DataFrame, trusted: DataFrame, quantile: float) -> tuple[DataFrame, float, float]:
    """(``lang, mean, threshold`` of languages, and both of all languages together) from trusted documents held out."""
    held = written(found.where(held_out("id") & (F.col("n") > 0)).join(trusted, "id", "left_semi").select("lang", "n", "nll"), "held_out")
    mean = (F.sum("nll") / F.sum("n")).alias("mean")
    top = lambda m: F.percentile_approx(perplexity(m), F.lit(quantile), F.lit(10_000)).alias("threshold")
    all_mean = held.agg(mean).first()["mean"] or 0.0
    all_top = held.agg(top(F.lit(all_mean))).first()["threshold"]
    by_lang = held.where("lang is not null").groupBy("lang").agg(mean, F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= LEAST_HELD).drop("docs")
    own = held.join(by_lang, "lang").groupBy("lang").agg(F.first("mean").alias("mean"), top(F.col("mean")))
    return written(own, "limits"), all_mean, math.inf if all_top is None else all_top


def keyed(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id, lang, text`` and a key of 128 bits of all three."""
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return base.withColumns(dict(zip(("k1", "k2"), keys("id", "lang", "text"), strict=True)))


def keys(id_: Column | str, lang: Column | str, text: Column | str) -> tuple[Column, Column]:
    return F.xxhash64(id_, lang, text), F.xxhash64(F.lit(7), text, id_, lang)


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float, shard_rows: int) -> DataFrame:
    """``id, lang, k1, k2, times, n, perplexity, threshold, keep`` of each distinct row."""
    base, trusted = keyed(docs, id_col, text_col, lang_col), trusted_ids(labels)
    # only texts that may be trusted are sent to the join
    own = possibly(base.where(F.col("id").isNotNull() & ~held_out("id")), trusted, {"id": F.col("id")}, "named").where("named").select("id", "text").hint("shuffle_hash").join(trusted, "id", "left_semi")
    model = estimated(written(top_counts(own), "kn_counts"))
    if model is None:
        none = F.lit(None).cast("double")
        found = base.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("lang").alias("lang"), F.count(F.lit(1)).alias("times"), F.max(F.length("text")).cast("long").alias("n"))
        return found.select("id", "lang", "k1", "k2", "times", "n", none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("keep"))
    found = likelihoods(base, model, shard_rows)
    by_lang, all_mean, all_top = limits(found, trusted, quantile)
    both = found.join(by_lang, "lang", "left").withColumns({"mean": F.coalesce("mean", F.lit(all_mean)), "threshold": F.coalesce("threshold", F.lit(all_top))})
    both = both.withColumn("perplexity", perplexity(F.col("mean")))
    return both.select("id", "lang", "k1", "k2", "times", "n", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("keep"))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, shard_rows: int = SHARD) -> DataFrame:
    """``doc_id, lang, n_symbols, perplexity, threshold, keep`` for each row."""
    found = judged(docs, labels, id_col, text_col, lang_col, quantile, shard_rows)
    each = found.withColumn("_time", F.explode(F.sequence(F.lit(1), "times")))  # equal rows come back as often as they were there
    return each.select(F.col("id").alias("doc_id"), "lang", F.col("n").alias("n_symbols"), "perplexity", "threshold", "keep")


def filtered(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, shard_rows: int = SHARD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns.

    Rows whose key can't be among the rejected pass without a shuffle.
    """
    out = written(judged(docs, labels, id_col, text_col, lang_col, quantile, shard_rows).where("not keep").select("k1", "k2"), "rejected")
    own = lambda name: F.col("row").getField(name)
    k1, k2 = keys(own(id_col).cast("long"), own(lang_col).cast("string"), F.coalesce(own(text_col).cast("string"), F.lit("")))
    marked = possibly(whole_rows(docs).withColumns({"k1": k1, "k2": k2}), out, {"k1": F.col("k1"), "k2": F.col("k2")}, "hit")
    stay = marked.where("hit").join(out.hint("shuffle_hash"), ["k1", "k2"], "left_anti")
    return marked.where("not hit").select("row.*").union(stay.select("row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
