"""Best-fit packing by minimum bin slack, planned on the histogram of lengths.

Only the number of pieces of each length matters to a plan, and a piece has one of at most
``capacity`` lengths. So the plan is made on the driver from at most ``capacity`` counts,
however many documents there are: for each bin a bitset subset-sum dynamic programme over the
lengths left finds the fullest feasible combination, which is taken as often as the counts
allow. Pieces then get their place by their rank among the pieces of their length; ranks are
windows over (length, salt), so a length that a third of all pieces share is dealt out.

Ids are those that the tokenizers library gives with its defaults, so a text that spells an added token
gets that token's id.

Defined results: a text of any length is encoded a group at a time; null text is empty and still one piece (the end id); a null id, equal ids and
repeated rows are packed like any other row; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .chunks import library_cache
from .common import record, sliced, table, text_of, tidy, written

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that a rank window holds, about.
GROUP = 100_000
#: Documents that a worker holds at a time, and characters that it encodes together. Less of both takes less memory and more time.
ROWS, CHARS = 1000, 1_000_000


def fullest(counts: dict[int, int], space: int) -> list[tuple[int, int]]:
    """The (length, how many) with the largest sum up to ``space``: bitset subset sums.

    Lengths are tried from the largest; the backtrack takes a smaller one only where it must, so
    that small pieces, which fit anywhere, are left for later.
    """
    full = (1 << (space + 1)) - 1
    steps: list[tuple[int, int, int]] = []  # length, copies in this step, sums reachable before it
    reach = 1
    for length in sorted((x for x in counts if x <= space), reverse=True):
        left, part = min(counts[length], space // length), 1
        while left and not reach >> space & 1:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= (reach << (length * part)) & full
            left -= part
            part *= 2
        if reach >> space & 1:
            break
    total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, part, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + part
            total -= length * part
    return sorted(taken.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``(length, first rank, rank after the last, first sequence, copies a bin, offset)``.

    Each bin starts with the largest length left, as every piece must go somewhere, and is filled
    up by the fullest combination. Each round uses up a length or leaves fewer of it than one bin
    takes, so there are few rounds, whatever the counts.
    """
    left = {k: n for k, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        top = max(left)
        left[top] -= 1
        combo = dict(fullest(left, capacity - top))
        left[top] += 1
        combo[top] = combo.get(top, 0) + 1
        times = min(left[x] // n for x, n in combo.items())
        offset = 0
        for length in sorted(combo, reverse=True):
            n = combo[length]
            rows.append((length, used[length], used[length] + n * times, sequence, n, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequence += times
    return np.array(sorted(rows), dtype="i8").reshape(-1, 6)


def placed(length: np.ndarray, rank: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces, given their ranks within their lengths."""
    lengths, first = np.unique(rows[:, 0], return_index=True)
    ends = np.append(first[1:], len(rows))
    at = np.empty(len(length), dtype="i8")
    for x in np.unique(length):
        i = int(np.searchsorted(lengths, x))
        of = length == x
        at[of] = first[i] + np.searchsorted(rows[first[i] : ends[i], 1], rank[of], side="right") - 1
    _, start, _, sequence, copies, offset = rows[at].T
    k = rank - start
    return sequence + k // copies, offset + k % copies * length


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first takes what full pieces leave over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """Tokenized documents cut into pieces of at most ``capacity`` ids, the end id included."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with library_cache(tokenizer) as cache:
            for batch in sliced(batches, rows):
                doc, piece, start, length, crc, raw = [], [], [], [], [], []
                for key, ids in zip(batch["id"].to_pylist(), cache.encode(batch["text"].to_pylist(), chars), strict=True):
                    ids += end
                    for i, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * at : 4 * (at + n)]
                        doc.append(key)
                        piece.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        if keep_ids:
                            raw.append(own)
                out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                yield record(**out, **({"ids": pa.array(raw, pa.binary())} if keep_ids else {}))

    return text_of(docs, id_col, text_col).mapInArrow(tidy(run), PIECES + ", ids binary" * keep_ids)


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table with ``doc_id, piece, length, ids_crc32``."""
    sizes = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    rows = plan(sizes, capacity)
    shared = found.sparkSession.sparkContext.broadcast(rows)  # bounded by the lengths, not by the input
    salts = max(32, sum(sizes.values()) // GROUP)
    salted = found.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = before.select("length", "_salt", (F.sum("_n").over(W.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_own", own).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_own") - 1)
    names = found.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = placed(b["length"].to_numpy(), b["_rank"].to_numpy(), shared.value)
                yield record(**{c: b[c] for c in names}, sequence_id=pa.array(sequence), offset=pa.array(offset))

    fields = ", ".join(f"`{c}` {t}" for c, t in found.dtypes)
    return ranked.select(*names, "_rank").mapInArrow(run, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """One row a piece: its document, place in the document, sequence and offset there; with ``keep_ids`` its ids, too."""
    return pack(written(pieces(docs, id_col, text_col, tokenizer, capacity, end_id, keep_ids, rows, chars), "pieces", rows=rows), capacity)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
