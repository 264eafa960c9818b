"""Near-duplicate documents: an exact Jaccard join of word shingles by parity sketches.

Words are hashed in numpy over whole Arrow buffers; a document is its set of 64-bit shingle
hashes. Its parity sketch toggles one bit a shingle, so the Hamming distance of two sketches is at
most the symmetric difference of the sets. Sets of sizes n and m link only if that difference is
at most (n + m) / 7, and then 3n <= 4m: sizes fall into bands [2**b, 2**(b+1)), and a pair meets in
the band of its larger set.

Candidates. A band cuts the sketch into k = 2**b segments (below 2**7 each shingle is a
segment). A segment is compared by the XOR of its shingles' hashes. Of two linked sets at most
d segments differ, so (pigeonhole) they share one among the first d + 1 non-empty segments of each,
in any order that all sets of the band follow. A set of n has at least d + 1 of them but for odds
below 1e-12 a set. The order puts frequent segments last, so passages that many documents share
are rarely in a prefix; it changes the cost only, never the result.

Runs of equal segments come from one sort, read as a stream. A short run gives all its pairs, a long
one its members paired with the first and the few just before. After the links of these are verified, members
of a long run that are still in different components meet in bounded blocks. So a group of
copies costs a pair a member, and no link between components is lost.

Verification. Pairs first need fitting sizes and sketches within the distance; the others' texts
are compared shingle by shingle, for each document its likeliest partner first, and further
partners only while they are in other components.

Defined results: documents without words have an empty set, link with nothing and are their own
component; documents of fewer words than a shingle have the whole sequence as one; rows with equal
sets are one class whatever their ids; a row with a null id goes by a hash of its text, links others like any row, and its
component is the least id in it, null if there is none; rows that share an id are one node; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import released
from .common import arrow_map, possibly, record, table, text_of, tidy, whole_rows, written
from .components import components, roots

WORDS, FINE = 5, 7
#: Runs of up to so many sets give all pairs; in blocks of so many others meet.
SHORT, BLOCK = 8, 2048
#: In longer ones each set is paired with the first and with so many before it.
CHAIN = 3
#: Segments that so many sets of a batch share may be frequent; so many of these are told to all tasks.
LOCAL, FREQUENT = 2, 200_000
#: The similarity as a fraction.
NUM, DEN = 75, 100
#: The bits of a set's key that hold its size, and how far these may be apart: 64 * log2(DEN / NUM), and what rounding takes.
SIZE, APART = 4095, math.ceil(64 * math.log2(DEN / NUM) + 1)

_P, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_MIX = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(1, 9)], dtype="u8")
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        base, inverse = np.full(size, _P, dtype="u8"), np.full(size, np.uint64(pow(int(_P), -1, 1 << 64)), dtype="u8")
        base[0] = inverse[0] = 1
        _powers[:] = [np.cumprod(base), np.cumprod(inverse)]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts that lie one after another in ``data``, and how many words lie before each text's end."""
    n = len(data)
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype("u8")
    black = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = black.copy()
    begins[1:] &= ~black[:-1]
    inner = bounds[(bounds > 0) & (bounds < n)]
    begins[inner] = black[inner]  # a text's first byte begins a word, whatever stands before it
    ends = np.zeros(n + 1, dtype=bool)
    ends[1:] = black
    ends[:-1] &= ~black | begins
    ends[0] = False
    power, inverse = powers(n)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(data * power)])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    hashes = mixed((sums[last] - sums[first]) * inverse[first] + (last - first).astype("u8") * _MIX[7])
    return hashes, np.searchsorted(first, bounds)


def sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = texts.cast(pa.large_string())
    i = 0
    while i < len(texts):
        offsets = np.frombuffer(texts.buffers()[1], dtype="i8", count=len(texts) + 1, offset=8 * texts.offset)
        j = int(max(i + 1, np.searchsorted(offsets, offsets[i] + (1 << 20), side="right") - 1))
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype="u1", count=int(offsets[j] - offsets[i]), offset=int(offsets[i])) if raw is not None and offsets[j] > offsets[i] else np.empty(0, "u1")
        hashes, counts = word_hashes(data, offsets[i : j + 1] - offsets[i]) if len(data) else (np.empty(0, "u8"), np.zeros(j + 1 - i, "i8"))
        if len(hashes) >= WORDS:
            whole = mixed(sum(hashes[k : len(hashes) - WORDS + 1 + k] * _MIX[k] for k in range(WORDS)))
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(whole[a : b - WORDS + 1])
            elif b > a:
                yield mixed(np.array([np.sum(hashes[a:b] * _MIX[: b - a]) + np.uint64(b - a)], dtype="u8"))
            else:
                yield np.empty(0, "u8")
        i = j


def band(n: int) -> int:
    return n.bit_length() - 1


def segments(own: np.ndarray, b: int) -> np.ndarray:
    """Signatures of the non-empty segments of a set in band ``b``."""
    tag = mixed(np.array([b + 1], dtype="u8"))[0]
    if b < FINE:
        return mixed(own ^ tag)
    part = own >> np.uint64(64 - b)  # sorted, as the set is
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return mixed(np.bitwise_xor.reduceat(mixed(own + _P), first) ^ mixed(part[first] + tag))


def signatures(own: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first d + 1 segments in each band where the set meets others."""
    n = len(own)
    if not n:
        return own
    largest, b = n * DEN // NUM, band(n)
    keep = (n + largest) // 7 + 1
    out = []
    for at in range(b, band(largest) + 1):
        found = np.sort(segments(own, at))
        if len(found) > keep:
            hot, rank = frequent
            if len(hot):
                place = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
                order = np.where(hot[place] == found, rank[place] + 1, 0)
                found = found[np.argsort(order, kind="stable")]
            found = found[:keep]
        out.append(found)
    return np.concatenate(out)


def sketch(own: np.ndarray) -> bytes:
    """The parity sketch: four to eight bits a shingle, at least 1024, so that the distance hardly falls short of the difference of sets that nearly link."""
    bits = max(1024, 8 << band(max(1, len(own))))
    on = np.bincount((own & np.uint64(bits - 1)).astype("i8"), minlength=bits) & 1
    return np.packbits(on.astype("u1"), bitorder="little").tobytes()


def distance(a: bytes, b: bytes) -> int:
    """The Hamming distance of sketches, the larger one folded onto the smaller one: a lower bound of the symmetric difference."""
    if len(a) < len(b):
        a, b = b, a
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    size = len(a)
    while size > len(b):
        size //= 2
        x = x >> (8 * size) ^ x & ((1 << 8 * size) - 1)
    return (x ^ y).bit_count()


def links(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and DEN * both >= NUM * (len(a) + len(b) - both)


NONE = (np.empty(0, "u8"), np.empty(0, "i8"))
FACTS = "doc_id long, text_key long, k1 long, k2 long, n long, sketch binary, hot array<long>"


def set_key(own: np.ndarray) -> int:
    """52 bits of a set's hash, then its size in 64ths of octaves, so that pairs tell by their keys whether their sizes may fit."""
    return int(np.bitwise_xor.reduce(mixed(own + _A)).astype("i8")) & ~SIZE | round(64 * math.log2(len(own)))


def sizes_fit(a: int, b: int) -> bool:
    return abs((a & SIZE) - (b & SIZE)) <= APART


def facts(docs: DataFrame) -> DataFrame:
    """A row a document: the two halves of its set's key (null for an empty set), the set's size, its sketch; and for a
    batch, with its first row, the segments that many of its sets share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()  # workers are used again, also after packing
        for b in batches:
            k1, k2, n, raw, seen = [], [], [], [], {}
            for own in sets(b["text"]):
                n.append(len(own))
                raw.append(sketch(own) if len(own) else None)
                k1.append(set_key(own) if len(own) else None)
                k2.append(int(np.sum(mixed(own + _B)).astype("i8")) if len(own) else None)
                if len(own) and k1[-1] not in seen:
                    seen[k1[-1]] = signatures(own, NONE)
            hot: list = []
            if seen:
                values, counts = np.unique(np.concatenate(list(seen.values())), return_counts=True)
                hot = values[counts >= LOCAL].astype("i8").tolist()
            yield record(doc_id=b["doc_id"], text_key=b["text_key"], k1=pa.array(k1, pa.int64()), k2=pa.array(k2, pa.int64()), n=pa.array(n, pa.int64()), sketch=pa.array(raw, pa.binary()), hot=pa.array(([hot] + [None] * len(n))[: len(n)], pa.list_(pa.int64())))

    return docs.select("doc_id", "text_key", "text").mapInArrow(tidy(run), FACTS)


class Runs:
    """Pairs from a stream of (signature, key) that is sorted; memory holds a batch and a short run."""

    def __init__(self) -> None:
        self.sig: int | None = None
        self.keys: list[int] = []
        self.long = False

    def _given(self, out: tuple[list, list, list]) -> None:
        if not self.long:
            for i, a in enumerate(self.keys):
                for b in self.keys[i + 1 :]:
                    if sizes_fit(a, b):
                        out[0].append(a)
                        out[1].append(b)
                        out[2].append(None)
        self.keys, self.long = [], False

    def _add(self, keys: np.ndarray, out: tuple[list, list, list]) -> None:
        for k in keys.tolist():
            if self.keys and k == self.keys[-1]:
                continue
            self.keys.append(k)
            if self.long or len(self.keys) > SHORT:
                for i in range(1 if not self.long else len(self.keys) - 1, len(self.keys)):
                    # the first, marked with the run, and those just before
                    for a, sig in ((self.keys[0], self.sig), *((x, None) for x in self.keys[max(1, i - CHAIN) : i])):
                        if sig is not None or sizes_fit(a, self.keys[i]):  # a run's members are all named
                            out[0].append(a)
                            out[1].append(self.keys[i])
                            out[2].append(sig)
                self.long = True
                self.keys = [self.keys[0], *self.keys[-CHAIN:]]

    def take(self, sig: np.ndarray, key: np.ndarray) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        ends = np.append(first[1:], len(sig))
        size = ends - first
        # runs of one row inside a batch are done with; the last may go on
        busy = np.flatnonzero(size > 1)
        for i in sorted({0, *busy.tolist(), len(first) - 1}):
            a, b = int(first[i]), int(ends[i])
            if self.sig is None or int(sig[a]) != self.sig:
                self._given(out)
                self.sig = int(sig[a])
            self._add(key[a:b], out)
        return out

    def rest(self) -> tuple[list, list, list]:
        out: tuple[list, list, list] = ([], [], [])
        self._given(out)
        return out


PAIRS = "a long, b long, sig long"


def candidate_pairs(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Pairs of keys that share a segment in their prefixes; with the segment if its run is long."""

    def emit(b: pa.RecordBatch) -> pa.RecordBatch:
        sig, key = [np.empty(0, "u8")], [np.empty(0, "i8")]
        for own in sets(b["text"]):
            if len(own):
                found = signatures(own, frequent)
                sig.append(found)
                key.append(np.full(len(found), set_key(own), "i8"))
        return record(sig=pa.array(np.concatenate(sig).astype("i8")), key=pa.array(np.concatenate(key)))

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                yield emit(b.slice(i, 1000))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        as_rows = lambda o: record(a=pa.array(o[0], pa.int64()), b=pa.array(o[1], pa.int64()), sig=pa.array(o[2], pa.int64()))
        for b in batches:
            if b.num_rows:
                yield as_rows(runs.take(b["sig"].to_numpy(), b["key"].to_numpy()))
        yield as_rows(runs.rest())

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("text").mapInArrow(tidy(batched), "sig long, key long").repartition(n, "sig").sortWithinPartitions("sig", "key")
    return rows.mapInArrow(tidy(pair), PAIRS)


def near_enough(pairs: DataFrame) -> DataFrame:
    """Pairs ``a, b, na, nb, sa, sb, …`` whose sizes and sketches allow a link, without sizes and sketches."""
    rest = [c for c in pairs.columns if c not in ("na", "nb", "sa", "sb")]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        near = [distance(x, y) <= (n + m) // 7 for x, y, n, m in zip(*(b[c].to_pylist() for c in ("sa", "sb", "na", "nb")), strict=True)]
        return b.select(rest).filter(pa.array(near, pa.bool_()))

    fits = pairs.where((F.col("na") * NUM <= F.col("nb") * DEN) & (F.col("nb") * NUM <= F.col("na") * DEN))
    types = dict(pairs.dtypes)
    return arrow_map(fits.select(*rest, "na", "nb", "sa", "sb"), run, ", ".join(f"{c} {types[c]}" for c in rest))


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs ``a, b`` of ids whose texts link; hardly any but the texts of paired documents are shuffled."""
    both_ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    texts = possibly(docs, both_ids, {"id": F.col("id")}, "met").where("met")
    # the same joins at every size: pairs grow with the corpus, so they are never broadcast
    left = pairs.select("a", "b").hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.hint("merge").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                ok = [links(x, y) for x, y in zip(sets(b["ta"]), sets(b["tb"]), strict=True)]
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return written(both.select("a", "b", "ta", "tb").mapInArrow(tidy(run), "a long, b long").distinct(), "shingle_links")


def with_component(pairs: DataFrame, found: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left").withColumn(f"c{side}", F.coalesce(f"c{side}", side))
    return pairs


def joined_by(found: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Components after the links among written ``pairs``."""
    if pairs.isEmpty() or (links_ := verified(pairs, docs)).isEmpty():
        return found
    return written(components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links_)), "shingle_components")


def blocks(members: DataFrame) -> DataFrame:
    """Pairs of members of a run, ``sig, id, n, sketch, comp``, that are in different components and near enough; in blocks."""
    sizes = members.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.countDistinct("comp").alias("c")).where("c > 1").select("sig", F.ceil(F.col("m") / BLOCK).cast("int").alias("k"))
    dealt = members.join(sizes, "sig").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        ids, comp, n, raw, own = (group[c].to_pylist() for c in ("id", "comp", "n", "sketch", "own"))
        size = min(map(len, raw))
        folded = np.zeros((len(raw), size), dtype="u1")
        for i, s in enumerate(raw):
            folded[i] = np.bitwise_xor.reduce(np.frombuffer(s, dtype="u1").reshape(-1, size), axis=0)
        wide, sizes_, comps, side = folded.view("u8"), np.array(n), np.array(comp), np.array(own)
        a, b = [], []
        for i in np.flatnonzero(side == low).tolist():
            fit = np.flatnonzero((side == high) & (comps != comps[i]) & (sizes_ * NUM <= n[i] * DEN) & (sizes_ * DEN >= n[i] * NUM))
            if low == high:
                fit = fit[fit > i]
            near = np.bitwise_count(wide[fit] ^ wide[i]).sum(axis=1) <= (sizes_[fit] + n[i]) // 7
            for j in fit[near].tolist():
                if distance(raw[i], raw[j]) <= (n[i] + n[j]) // 7:
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return met.groupBy("sig", "low", "high").applyInArrow(meet, "a long, b long").distinct()


def related(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, node`` for each row.

    ``text_key`` is a hash of the text. ``node`` names the component whatever the ids are; null for an empty set.
    """
    base = text_of(docs, id_col, text_col).select(F.col("id").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    base = base.select("*", F.coalesce("doc_id", "text_key").alias("id"))  # a row without an id goes by its text
    known = written(facts(base), "shingle_facts")
    top = known.select(F.explode("hot").alias("sig")).groupBy("sig").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "sig").limit(FREQUENT).collect()  # at most FREQUENT rows
    hot = np.array([r["sig"] for r in top], dtype="i8").view("u8")
    order = np.argsort(hot)
    frequent = (hot[order], np.array([r["c"] for r in top], dtype="i8")[order])

    own = known.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least"), F.coalesce(F.min("doc_id"), F.min("text_key")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(own, "shingle_classes")
    found = written(candidate_pairs(base, frequent), "shingle_pairs")
    size = lambda side: F.col(side).bitwiseAND(F.lit(SIZE))
    pairs = found.where(F.abs(size("a") - size("b")) <= APART).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    for side in ("a", "b"):
        own = classes.select(F.col("k1").alias(side), F.col("rep").alias(f"r{side}"), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}"))
        pairs = pairs.join(own, side)
    ids = pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "shared", "na", "nb", "sa", "sb").where("a != b")
    near = written(near_enough(ids), "shingle_near")

    best = near.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("shared"), "a"))).where("r = 1")
    comps = written(roots(verified(best, base)), "shingle_components")  # each b hangs on one lesser a

    # further partners, then members of long runs among each other, each time only across components
    further = with_component(near.select("a", "b").join(best.select("a", "b"), ["a", "b"], "left_anti"), comps).where("ca != cb").select("a", "b")
    comps = joined_by(comps, written(further, "shingle_rest"), base)
    ends = found.where("sig is not null")
    keyed = ends.select("sig", F.col("a").alias("k1")).union(ends.select("sig", F.col("b").alias("k1"))).distinct()
    members = keyed.join(classes, "k1").select("sig", F.col("rep").alias("id"), "n", "sketch")
    members = members.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id"))
    comps = joined_by(comps, written(blocks(members), "shingle_rest"), base)

    nameless = classes.where("least is null").select(F.col("rep").alias("node"))
    least = comps.join(nameless, "node", "left_anti").groupBy("component").agg(F.min("node").alias("name"))
    named = comps.join(least, "component", "left").select(F.col("node").alias("rep"), "component", "name")
    nodes = classes.join(named, "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("node"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    out = known.select("doc_id", "text_key", "k1", "k2", "n").join(nodes, ["k1", "k2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), "node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row."""
    return related(docs, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all its columns: the one with the least id (rows without an id last).

    Rows are told apart by id and text together, so a clean text stays though another text of its id goes. Documents without words all stay.
    Only rows that may go are shuffled.
    """
    key = ["id", "nameless", "text_key"]
    found = related(docs, id_col, text_col).where("node is not null")
    found = written(found.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("nameless"), "text_key", "node").groupBy(*key).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), "shingle_nodes")
    first = found.groupBy("node").agg(F.min(F.struct("nameless", "id", "text_key")).alias("first")).select("first.*")
    doubtful = written(found.join(first.withColumn("stays", F.lit(True)), key, "left").where("stays is null or n > 1").select(*key, F.coalesce("stays", F.lit(False)).alias("stays")), "shingle_doubtful")
    own = lambda name: F.col("row").getField(name)
    id_, text = own(id_col).cast("long"), F.coalesce(own(text_col).cast("string"), F.lit(""))
    rows = whole_rows(docs).withColumns({"id": F.coalesce(id_, F.lit(0)), "nameless": id_.isNull(), "text_key": F.xxhash64(text)})
    marked = possibly(rows, doubtful, {k: F.col(k) for k in key}, "hit")
    judged = marked.where("hit").join(doubtful.hint("shuffle_hash"), key, "left")
    once = judged.where("stays").dropDuplicates(key)  # repeated rows of a document that stays
    return marked.where("not hit").select("row.*").union(judged.where("stays is null").select("row.*")).union(once.select("row.*"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same result from the shingles that two documents share, in SQL.
ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(list_zip(w, w[2:], w[3:], w[4:], w[5:], true), lambda z: z[1] || ' ' || z[2] || ' ' || z[3] || ' ' || z[4] || ' ' || z[5]) END)) AS x FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a, b FROM shared JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
c AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)"""
