"""Byte-pair training over partitioned chunks, in rounds that find many merges at once.

Distinct chunks stay where they are, packed into blocks. A round is two passes over the blocks: one counts pairs, of which the
``candidates`` most frequent reach the driver; the other gives these pairs' neighbours, and how often each stands before
and after them. With that the driver follows the sequential definition as far as it is certain: it keeps for
each pair it knows a least and a most count, takes the first pair (the most frequent, the least of equals) while
nothing else can come before it, and sees from the neighbours what each merge takes from other pairs and which new
pairs it makes. Where a count is in doubt, or a pair that the round didn't list could come next, the round ends
and the blocks are counted again. So the merges are those of one-at-a-time training, in order, with their counts.

The driver holds the candidates, their neighbours (ids of the vocabulary) and the merges, and no chunk.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept
from .bpe import Merge, Pair, chunk_counts

CANDIDATES = 512
#: Distinct chunks of a block, about; merges that passes apply on the fly before blocks are written anew.
BLOCK, PENDING = 100_000, 256
END = -1


def applied(ids: np.ndarray, merges: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Chunks, each followed by END, after merges one after another; each from left to right, without overlaps."""
    for left, right, token in merges:
        at = np.flatnonzero((ids[:-1] == left) & (ids[1:] == right))
        if left == right and len(at) > 1:  # of a run every other place counts
            begins = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
        if len(at):
            ids[at] = token
            ids = np.delete(ids, at + 1)
    return ids


def weighted(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    found, first = np.unique(codes[order], return_index=True)
    return found, np.add.reduceat(weights[order], first) if len(found) else weights[:0]


def pairs_of(ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``left << 32 | right`` of adjacent ids, overlapping, and their weighted counts."""
    inside = (ids[:-1] >= 0) & (ids[1:] >= 0)
    of = np.cumsum(ids == END)[:-1][inside]
    return weighted(ids[:-1][inside] << 32 | ids[1:][inside], weights[of])


def neighbours_of(ids: np.ndarray, weights: np.ndarray, codes: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(whether before, place in sorted ``codes``, neighbour, count) of the ids beside each pair."""
    n = len(ids) - 1
    inside = (ids[:-1] >= 0) & (ids[1:] >= 0)
    own = ids[:-1] << 32 | np.maximum(ids[1:], 0)
    place = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
    at = np.flatnonzero(inside & (codes[place] == own))
    of = np.cumsum(ids == END)
    for before in (True, False):
        near = at - 1 if before else at + 2
        sound = (near >= 0) & (near <= n)
        near, mid = near[sound], at[sound]
        real = ids[near] >= 0
        near, mid = near[real], mid[real]
        keys, count = weighted(place[mid].astype("i8") << 32 | ids[near], weights[of[mid]])
        yield before, keys >> 32, keys & 0xFFFFFFFF, count


class Certain:
    """What a round knows: for each pair between how many and how many times it occurs."""

    def __init__(self, top: list[tuple[Pair, int]], complete: bool, beside: dict[tuple[bool, Pair], dict[int, int]]) -> None:
        self.low, self.high = {p: n for p, n in top}, {p: n for p, n in top}
        self.heap = [(-n, p) for p, n in top]
        heapq.heapify(self.heap)
        self.beside, self.last = beside, (-math.inf, ()) if complete else (-top[-1][1], top[-1][0])
        self.complete, self.listed = complete, {p for p, _ in top}
        self.stale: set[Pair] = set()  # pairs whose neighbours have changed since
        self.lefts: dict[int, list[int]] = defaultdict(list)  # tokens that were the left side of a merge of this round, and what became of them
        self.rights: dict[int, list[int]] = defaultdict(list)
        self.done = False

    def change(self, pair: Pair, low: int, high: int) -> None:
        if pair not in self.high:
            if low < 0 or high < 0:
                return  # a pair that isn't listed stays behind the last one
            self.low[pair] = self.high[pair] = 0
        self.low[pair] += low
        self.high[pair] += high
        heapq.heappush(self.heap, (-self.high[pair], pair))

    def next(self) -> tuple[Pair, int] | None:
        """The pair that comes next for certain, with its count; None if that can't be told, or nothing is left."""
        while self.heap and (self.heap[0][1] not in self.high or -self.heap[0][0] != self.high[self.heap[0][1]]):
            heapq.heappop(self.heap)
        if self.done or not self.heap:
            return None
        n, pair = self.heap[0]
        if n >= 0 or self.low[pair] != -n or not self.complete and (n, pair) > self.last:
            return None
        return pair, -n

    def merge(self, pair: Pair, token: int) -> None:
        a, b = pair
        del self.low[pair], self.high[pair]
        if pair not in self.listed or a == b:
            self.done = True  # its neighbours aren't known, or it overlaps itself
            return
        self.lefts[a].append(token)
        self.rights[b].append(token)
        stale = pair in self.stale
        for x, n in self.beside.get((True, pair), {}).items():
            sure = not stale and x not in self.rights
            self.change((x, a), -n, -n if sure else 0)
            self.change((x, token), n if sure else 0, n)
            for t in self.rights.get(x, ()):
                self.change((t, a), -n, 0)
                self.change((t, token), 0, n)
            self.stale.add((x, a))
        for y, n in self.beside.get((False, pair), {}).items():
            sure = not stale and y not in self.lefts
            self.change((b, y), -n, -n if sure else 0)
            self.change((token, y), n if sure else 0, n)
            for t in self.lefts.get(y, ()):
                self.change((b, t), -n, 0)
                self.change((token, t), 0, n)
            self.stale.add((b, y))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to BLOCK rows or more."""
    some: list[pa.RecordBatch] = []
    for b in batches:
        some.append(b)
        if sum(x.num_rows for x in some) >= BLOCK:
            yield pa.Table.from_batches(some)
            some = []
    if some:
        yield pa.Table.from_batches(some)


def blocks_of(chunks: DataFrame) -> DataFrame:
    """``ids, weights``: distinct chunks as bytes, a block a row; ``chunks``: chunk, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches):
            raw = [c.encode() for c in b["chunk"].to_pylist()]
            ids = np.full(sum(map(len, raw)) + len(raw), END, "i8")
            ends = np.cumsum([len(c) + 1 for c in raw]) - 1
            inside = np.ones(len(ids), bool)
            inside[ends] = False
            ids[inside] = np.frombuffer(b"".join(raw), "u1")
            yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i4").tobytes()]), pa.array([b["n"].to_numpy().astype("<i8").tobytes()])], ["ids", "weights"])

    return chunks.where("octet_length(chunk) > 1").select("chunk", "n").mapInArrow(run, "ids binary, weights binary")


def _passed(blocks: DataFrame, merges: Sequence[tuple[int, int, int]], give, schema: str) -> DataFrame:
    """``give(ids, weights)`` of each block after ``merges``."""
    shared = blocks.sparkSession.sparkContext.broadcast(list(merges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, weights in zip(b["ids"].to_pylist(), b["weights"].to_pylist(), strict=True):
                yield from give(applied(np.frombuffer(ids, "<i4").astype("i8"), shared.value), np.frombuffer(weights, "<i8"))

    return blocks.mapInArrow(run, schema)


def train_in_rounds(chunks: DataFrame, merges: int, first: int = 256, candidates: int = CANDIDATES) -> list[Merge]:
    """The merges that ``bpe.train`` finds for ``chunks`` (chunk, n); too few pairs are an error. No chunk reaches the driver."""
    out: list[Merge] = []
    pending: list[tuple[int, int, int]] = []

    def counted(ids: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        codes, n = pairs_of(ids, weights)
        yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], ["code", "n"])

    def renewed(ids: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([ids.astype("<i4").tobytes()]), pa.array([weights.tobytes()])], ["ids", "weights"])

    with kept(chunks.sparkSession, "bpe_blocks") as keep:
        blocks = keep.replaced(blocks_of(chunks))
        while len(out) < merges:
            if len(pending) > PENDING:
                blocks = keep.replaced(_passed(blocks, pending, renewed, "ids binary, weights binary"))
                pending = []
            counts = _passed(blocks, pending, counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
            top = [((r.code >> 32, r.code & 0xFFFFFFFF), r.n) for r in counts.orderBy(F.desc("n"), "code").limit(candidates).collect()]
            if not top:
                raise ValueError(f"only {len(out)} merges can be found")
            codes = np.array(sorted(a << 32 | b for (a, b), _ in top), "i8")

            def beside(ids: np.ndarray, weights: np.ndarray, codes: np.ndarray = codes) -> Iterator[pa.RecordBatch]:
                for before, place, near, n in neighbours_of(ids, weights, codes):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), before)), pa.array(place), pa.array(near), pa.array(n)], ["before", "place", "near", "n"])

            pairs = [(c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()]
            near = _passed(blocks, pending, beside, "before boolean, place long, near long, n long").groupBy("before", "place", "near").agg(F.sum("n").alias("n")).toArrow()
            found: dict[tuple[bool, Pair], dict[int, int]] = defaultdict(dict)
            for before, place, x, n in zip(*(near[c].to_pylist() for c in ("before", "place", "near", "n")), strict=True):
                found[before, pairs[place]][x] = n
            known = Certain(top, len(top) < candidates, found)
            while len(out) < merges and (step := known.next()):
                pair, n = step
                out.append(Merge(len(out), *pair, first + len(out), n))
                pending.append((*pair, out[-1].token))
                known.merge(pair, out[-1].token)
    return out


def train_over(docs: DataFrame, vocab_size: int, text: str = "text", candidates: int = CANDIDATES) -> list[Merge]:
    """Trains on all chunks of a corpus of any size."""
    return train_in_rounds(chunk_counts(docs, text), vocab_size - 256, candidates=candidates)
