"""Mixing sources to target weights: exact block quotas through a splitting tree.

A source is the sequence of its documents' words, documents in a seeded order, cut into blocks of equal numbers of words (the
last may be shorter). A source's draw is its blocks in a seeded order, again in another order if the target exceeds
the source, and so on; it ends at the word that meets the target, so each source takes exactly the whole part of its target, and no
document is taken more often than the target needs, partly or wholly. Block numbers are ordered by a keyed permutation that is computed, not
stored.

How many blocks of each source an output shard gets is drawn down a binary tree over the shards: a node's quotas are split between its
halves by a multivariate hypergeometric draw whose generator is seeded by the node, so each shard walks from the root to
its leaf by itself and all agree. Along the walk it learns which places of each source's draw are its own, so shards
draw disjoint blocks without a word between them. Pieces are then shuffled within their shard.

What the driver holds is a row a source. More than ``MOST_SOURCES`` of them are refused, which bounds what is collected
and broadcast. Documents, blocks, pieces and shards stay in tables.

Defined results: null or empty text and text of white space only have size 0 and are never taken; a null source is a source, the last one; a
source without words has target 0; null and repeated ids and repeated rows are documents each; a document
of any length is a piece a block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, record, table, written

#: The words of the query's contract: white space is ASCII's.
WORDS = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, MOST_TIMES = (3, 1, 2), Fraction(3, 2), 2
#: Words of a block and, about, of an output shard.
BLOCK, SHARD = 8192, 1 << 18
#: numpy draws from at most 10**9 blocks; with more words than this many blocks hold, blocks grow.
MOST_BLOCKS = 1 << 28
#: Sources, and rows that a place within a source is computed from at a time, about.
MOST_SOURCES, GROUP, GROUPS = 100_000, 100_000, 128


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction = SHARE, most_times: int = MOST_TIMES) -> list[Fraction]:
    """Words for each source: shares by weight of ``share`` times all words, stopped at ``most_times`` the source's own; the excess is shared out again."""
    left, open_, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] > most_times * sizes[i] * total}
        for i in full or open_:
            out[i] = Fraction(most_times * sizes[i]) if full else left * weights[i] / total
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _keys(*of: object) -> np.ndarray:
    """Six words of a digest."""
    return np.frombuffer(hashlib.sha512(":".join(map(str, of)).encode()).digest()[:48], "<u8")


class Permutation:
    """A keyed order of ``0 .. n-1``: a Feistel network over the next square of two, walked until it lands inside."""

    def __init__(self, n: int, *of: object) -> None:
        self.n, self.keys = n, _keys(*of)
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)

    def _mixed(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _through(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            a, b = (b ^ self._mixed(a, key), a) if back else (b, a ^ self._mixed(b, key))
        return a << self.half | b

    def __call__(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        out = self._through(np.asarray(x, dtype="u8"), back)
        while len(at := np.flatnonzero(out >= self.n)):
            out[at] = self._through(out[at], back)
        return out.astype("i8")


class Source(NamedTuple):
    """One source's draw: ``full`` orders of all its blocks, then ``more`` blocks of another order, the last cut to ``last`` words."""

    number: int
    size: int
    blocks: int
    full: int
    more: int
    last: int

    @property
    def quota(self) -> int:
        return self.full * self.blocks + self.more


def draw(number: int, size: int, words: int, block: int, seed: int) -> Source:
    blocks = -(-size // block)
    if not size or not words:
        return Source(number, size, blocks, 0, 0, 0)
    full, rest = divmod(words, size)
    if not rest:
        return Source(number, size, blocks, full, 0, 0)
    lacks = blocks * block - size  # of the last block, which may come anywhere in the order
    place = int(Permutation(blocks, seed, number, full)(np.array([blocks - 1]), back=True)[0])
    before = lambda k: k * block - (lacks if place < k else 0)  # noqa: E731  words of the first k blocks
    more = -(-rest // block)
    more += before(more) < rest
    return Source(number, size, blocks, full, more, rest - before(more - 1))


def own_share(shard: int, shards: int, quotas: np.ndarray, seed: int, known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of blocks) of a shard for each source: a walk down the splitting tree. ``known`` keeps the path of the last walk."""
    total, low, high = int(quotas.sum()), 0, shards
    start, own = np.zeros_like(quotas), quotas
    path: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    while high - low > 1:
        mid = (low + high) // 2
        if (left := known.get((low, high))) is None:
            room = total * mid // shards - total * low // shards
            left = np.random.Generator(np.random.PCG64(_keys("split", seed, shards, low, high))).multivariate_hypergeometric(own, room) if room else np.zeros_like(own)
        path[low, high] = left
        if shard < mid:
            own, high = left, mid
        else:
            start, own, low = start + left, own - left, mid
    known.clear()
    known.update(path)
    return start, own


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


class Mix(NamedTuple):
    """``documents``: doc_id, source, source_no, size, start (words of the source before it); ``sources``: source_no,
    source_size, target; ``pieces``: shard, place (order in the shard), source_no, start, from_word, to_word (of the document), epoch."""

    documents: DataFrame
    sources: DataFrame
    pieces: DataFrame


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most_times: int = MOST_TIMES, block: int = BLOCK, shard: int = SHARD, seed: int = 0) -> Mix:
    """Sources in order of code points (null last) take their weights from ``weights`` in turn."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("long"), text).alias("_h"))
    sized = written(rows, "sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found.sort(key=lambda r: (r.source is None, r.source))
    aims = targets([r["size"] for r in found], [weights[i % len(weights)] for i in range(len(found))], share, most_times)
    block = max(block, -(-sum(map(math.floor, aims)) // MOST_BLOCKS))
    draws = [draw(i, r["size"], math.floor(t), block, seed) for i, (r, t) in enumerate(zip(found, aims, strict=True))]
    names = spark.createDataFrame([(r.source, i, r["size"], float(aims[i])) for i, r in enumerate(found)], "source string, source_no int, source_size long, target double")
    groups = max(GROUPS, sum(r["n"] for r in found) // GROUP)
    # a document's place among its source's words: groups of the order first, then the order in the group
    numbered = sized.join(F.broadcast(names.select(F.col("source").alias("_s"), "source_no")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_g", F.pmod(F.col("_h"), F.lit(groups)).cast("int"))
    base = numbered.groupBy("source_no", "_g").agg(F.sum("size").alias("_n"))
    base = base.select("source_no", "_g", (F.sum("_n").over(W.partitionBy("source_no").orderBy("_g")) - F.col("_n")).alias("_base"))
    within = F.sum("size").over(W.partitionBy("source_no", "_g").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = numbered.withColumn("_in", F.coalesce(within, F.lit(0))).join(base, ["source_no", "_g"]).select("doc_id", "source", "source_no", "size", (F.col("_base") + F.col("_in")).alias("start"))
    documents = written(placed, "placed")
    dropped(sized)
    return Mix(documents, names, _pieces(documents, draws, block, shard, seed))


def _drawn(spark: SparkSession, draws: list[Source], block: int, shards: int, seed: int) -> DataFrame:
    """``shard, source_no, block, epoch, words``: each shard's blocks, drawn by the shard itself."""
    some = [s for s in draws if s.quota]  # a row a source

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quotas, known = np.array([s.quota for s in some], "i8"), {}
        for b in batches:
            for shard in b["id"].to_pylist():
                for s, first, n in zip(some, *own_share(shard, shards, quotas, seed, known), strict=True):
                    if not n:
                        continue
                    place = np.arange(first, first + n)
                    epoch, at = place // s.blocks, np.empty(n, "i8")
                    for e in np.unique(epoch):
                        of = epoch == e
                        at[of] = Permutation(s.blocks, seed, s.number, e)(place[of] % s.blocks)
                    words = np.minimum(block, s.size - at * block)
                    if s.more:
                        words[place == s.quota - 1] = s.last
                    yield record(shard=pa.array(np.full(n, shard)), source_no=pa.array(np.full(n, s.number), pa.int32()), block=pa.array(at), epoch=pa.array(epoch), words=pa.array(words))

    return spark.range(0, shards, 1, max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, "shard long, source_no int, block long, epoch long, words long")


def _pieces(documents: DataFrame, draws: list[Source], block: int, shard: int, seed: int) -> DataFrame:
    words = sum(s.size * s.full + (s.more - 1) * block + s.last for s in draws if s.quota)
    drawn = _drawn(documents.sparkSession, draws, block, max(1, words // shard), seed)
    end = F.col("start") + F.col("size")
    parts = documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    own = parts.select("source_no", "start", "size", "block", F.greatest(F.col("block") * block, F.col("start")).alias("_from"), F.least((F.col("block") + 1) * block, end).alias("_to")).join(drawn.hint("merge"), ["source_no", "block"])  # Spark takes what is drawn for small
    cut = F.least("_to", F.col("block") * block + F.col("words"))
    own = own.where(cut > F.col("_from")).select("shard", "source_no", "start", (F.col("_from") - F.col("start")).alias("from_word"), (cut - F.col("start")).alias("to_word"), "epoch")
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source_no", "start", "from_word", "epoch"), "source_no", "start", "from_word", "epoch")
    return own.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def taken(mix: Mix) -> DataFrame:
    """Of each document: ``doc_id, size, source_size, target, taken, n_pieces``, and the shard and place of its first piece (null if it isn't taken)."""
    by = mix.pieces.groupBy("source_no", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.count(F.lit(1)).alias("n_pieces"), F.min(F.struct("shard", "place")).alias("first"))
    some = mix.documents.where("size > 0").join(by, ["source_no", "start"], "left")  # only documents with words have a start of their own
    none = mix.documents.where("size = 0").withColumns({"taken": F.lit(0), "n_pieces": F.lit(0), "first": F.lit(None).cast("struct<shard:long,place:long>")})
    both = some.unionByName(none).join(F.broadcast(mix.sources.drop("source")), "source_no")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "size", "source_size", "target", zero("taken"), zero("n_pieces"), F.col("first.shard").alias("first_shard"), F.col("first.place").alias("first_place"))


def piece_texts(mix: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``shard, place, doc_id, text`` of all pieces, the words joined by single spaces; ids must be neither null nor repeated."""
    named = mix.pieces.join(mix.documents.where("size > 0").select("source_no", "start", "doc_id"), ["source_no", "start"])
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_t"))
    words = F.slice(F.regexp_extract_all("_t", F.lit(f"({WORDS})"), F.lit(1)), F.col("from_word").cast("int") + 1, (F.col("to_word") - F.col("from_word")).cast("int"))
    return named.join(texts, "doc_id").select("shard", "place", "doc_id", F.array_join(words, " ").alias("text"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixed(table(spark, sf_dir, "documents"))
    return taken(mix._replace(pieces=written(mix.pieces, "pieces")))
