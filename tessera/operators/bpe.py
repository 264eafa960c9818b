"""Byte-pair encoding: training on distinct chunks, encoding and evaluation.

Chunks are counted over the cluster; only distinct chunks of a budgeted corpus reach the driver, where
merges are found one after another, as each depends on all before it.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import regex_chunks

Pair = tuple[int, int]


@dataclass(frozen=True)
class Merge:
    rank: int
    left: int
    right: int
    token: int
    count: int


def merged(chunk: tuple[int, ...], pair: Pair, token: int) -> tuple[int, ...]:
    """``chunk`` with the pair replaced from left to right, without overlaps."""
    out, i = [], 0
    while i < len(chunk):
        if chunk[i : i + 2] == pair:
            out.append(token)
            i += 2
        else:
            out.append(chunk[i])
            i += 1
    return tuple(out)


def train(chunks: dict[tuple[int, ...], int], merges: int, first: int = 256) -> list[Merge]:
    """Merges of weighted chunks: each time the most frequent pair, the least of equals. Too few pairs are an error."""
    words = [[c, n] for c, n in chunks.items() if len(c) > 1]
    counts: Counter[Pair] = Counter()
    where: dict[Pair, set[int]] = defaultdict(set)
    for i, (c, n) in enumerate(words):
        for p in zip(c, c[1:], strict=False):
            counts[p] += n
            where[p].add(i)
    heap = [(-n, p) for p, n in counts.items()]
    heapq.heapify(heap)
    out = []
    for rank in range(merges):
        while heap and (-heap[0][0] != counts.get(heap[0][1], 0) or not heap[0][0]):
            n, p = heapq.heappop(heap)
            if counts.get(p, 0) and -n > counts[p]:
                heapq.heappush(heap, (-counts[p], p))
        if not heap:
            raise ValueError(f"only {rank} merges can be found")
        n, pair = heapq.heappop(heap)
        out.append(Merge(rank, *pair, first + rank, -n))
        changed: set[Pair] = set()
        for i in list(where[pair]):
            old, weight = words[i]
            new = merged(old, pair, first + rank)
            for p in zip(old, old[1:], strict=False):
                counts[p] -= weight
                where[p].discard(i)
                changed.add(p)
            for p in zip(new, new[1:], strict=False):
                counts[p] += weight
                where[p].add(i)
                changed.add(p)
            words[i][0] = new
        for p in changed:
            if counts[p] > 0:
                heapq.heappush(heap, (-counts[p], p))
            else:
                del counts[p]
    return out


def encode(ids: Iterable[int], ranks: dict[Pair, tuple[int, int]]) -> list[int]:
    """Always the pair of the lowest rank, the leftmost first; ``ranks``: pair to (rank, token). A linked list and a heap."""
    ids = list(ids)
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p][0], i, p) for i in range(n - 1) if (p := (ids[i], ids[i + 1])) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if ids[i] is not None else n
        if j >= n or (ids[i], ids[j]) != pair:
            continue
        ids[i], ids[j] = ranks[pair][1], None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (p := (ids[a], ids[after[a]])) in ranks:
                heapq.heappush(heap, (ranks[p][0], a, p))
    return [x for x in ids if x is not None]


def vocabulary(merges: Iterable[Merge]) -> dict[int, bytes]:
    out = {i: bytes([i]) for i in range(256)}
    for m in merges:
        out[m.token] = out[m.left] + out[m.right]
    return out


def decode(ids: Iterable[int], vocab: dict[int, bytes]) -> str:
    return b"".join(vocab[i] for i in ids).decode("utf-8", errors="replace")


def chunk_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct chunks of all texts and how often they occur."""
    return docs.select(F.explode(regex_chunks(F.col(text))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def train_on(docs: DataFrame, vocab_size: int, text: str = "text") -> list[Merge]:
    """Trains on a corpus that a character budget already bounds (see ``budget.bounded_bpe_corpus``)."""
    rows = chunk_counts(docs, text).toLocalIterator()
    return train({tuple(r["chunk"].encode()): r["n"] for r in rows}, vocab_size - 256)


def encoded(docs: DataFrame, merges: list[Merge], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of each text. A task looks up the distinct chunks of a few texts at a time and encodes only those it doesn't know yet."""
    ranks = {(m.left, m.right): (m.rank, m.token) for m in merges}
    chunks = docs.select(key, regex_chunks(F.col(text)).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                b = batch.slice(i, 500)
                if len(known) > 200_000:
                    known.clear()
                found = b["chunks"].flatten().dictionary_encode()
                own = []
                for c in found.dictionary.to_pylist():
                    if (ids := known.get(c)) is None:
                        ids = known[c] = encode(c.encode(), ranks)
                    own.append(ids)
                size = np.fromiter(map(len, own), dtype="i8", count=len(own))
                first, flat = np.cumsum(size) - size, np.fromiter((x for ids in own for x in ids), dtype="i4", count=int(size.sum()))
                at = found.indices.to_numpy()
                after = np.cumsum(size[at])
                ids = flat[np.repeat(first[at] - (after - size[at]), size[at]) + np.arange(after[-1] if len(after) else 0)]
                rows = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(b["chunks"]), 0).to_numpy()))
                yield pa.RecordBatch.from_arrays([b[key], pa.ListArray.from_arrays(pa.array(np.append(0, after)[rows].astype("i4")), pa.array(ids))], [key, "ids"])

    return chunks.mapInArrow(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


def compression(docs: DataFrame, ids: DataFrame, group: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bytes, tokens and bytes a token by group, null without tokens."""
    both = docs.select(key, group, F.octet_length(text).alias("b")).join(ids.select(key, F.size("ids").alias("t")), key)
    return both.groupBy(group).agg(F.sum("b").alias("bytes"), F.sum("t").alias("tokens")).withColumn("bytes_per_token", F.try_divide("bytes", "tokens"))
