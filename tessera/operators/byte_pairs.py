"""Bytes, adjacent pairs, shifts and windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Windows that a function of windows sees at a time.
WINDOWS = 1 << 15
#: Starts, inputs and targets of some windows, a row a window, to integers of each for every name.
OfWindows = Callable[[np.ndarray, np.ndarray, np.ndarray], dict[str, np.ndarray]]


def byte_ids(text: Column) -> Column:
    """UTF-8 bytes as an array of ids 0 to 255."""
    # in Latin-1 each byte is a character
    return F.transform(F.split(F.decode(F.encode(text, "utf-8"), "ISO-8859-1"), "", -1), F.ascii)


def byte_encode(text: Column) -> Column:
    """``byte_ids``, and an empty array for an empty text."""
    return F.when(F.octet_length(text) > 0, byte_ids(text)).otherwise(F.array().cast("array<int>"))


def byte_decode(ids: str | Column) -> Column:
    """The text of ids 0 to 255; bytes that aren't UTF-8 raise."""
    digits = F.array_join(F.transform(ids, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    return F.decode(F.unhex(digits), "utf-8")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """Counts of adjacent ids in chunks, overlapping; ``chunks``: ids, n (how often the chunk occurs).

    Equal chunks are counted once and weighted, so the explode sees distinct chunks only.
    """
    pairs = F.zip_with(F.slice("ids", 1, F.greatest(F.size("ids") - 1, F.lit(0))), F.slice("ids", 2, F.greatest(F.size("ids") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    each = chunks.select(F.explode(pairs).alias("p"), "n")  # a filter on ids would be pushed below the grouping, which would encode each occurrence
    return each.groupBy(F.col("p.a").alias("left_id"), F.col("p.b").alias("right_id")).agg(F.sum("n").cast("long").alias("pair_count"))


def word_chunks(docs: DataFrame, text: str = "text", least_bytes: int = 1) -> DataFrame:
    """Distinct space-delimited chunks of at least so many bytes as byte ids, with their counts."""
    words = docs.select(F.explode(F.split(text, " ", -1)).alias("chunk")).where(F.octet_length("chunk") >= least_bytes).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    return words.select("chunk", byte_encode(F.col("chunk")).alias("ids"), "n")


def best_pair(counts: DataFrame) -> DataFrame:
    """The most frequent pair; of equals the least."""
    return counts.orderBy(F.desc("pair_count"), "left_id", "right_id").limit(1)


def next_token_shift(rows: DataFrame, ids: str = "ids") -> DataFrame:
    """``inputs`` without the last id and ``targets`` without the first."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return rows.withColumns({"inputs": F.slice(ids, 1, n), "targets": F.slice(ids, 2, n)})


def sliding_windows(rows: DataFrame, length: int, ids: str = "ids") -> DataFrame:
    """Every contiguous window of ``length`` inputs that still has a next target."""
    starts = F.when(F.size(ids) > length, F.sequence(F.lit(1), F.size(ids) - length))
    return rows.withColumn("start", F.explode(starts)).withColumns({"inputs": F.slice(ids, F.col("start"), F.lit(length)), "targets": F.slice(ids, F.col("start") + 1, F.lit(length))}).withColumn("start", F.col("start") - 1)


def summed_windows(rows: DataFrame, length: int, fn: OfWindows, names: list[str], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, windows`` and a sum for each name over what ``fn`` gives for a row's windows; rows without a window are left out.

    The windows are those of ``sliding_windows``, but as views of a row's ids, which may also be byte ids as a binary; none becomes a row.
    """

    def sums(of: np.ndarray) -> list[int]:
        n, total = len(of) - length, dict.fromkeys(names, 0)
        for at in range(0, n, WINDOWS):
            seen = np.lib.stride_tricks.sliding_window_view(of[at : min(at + WINDOWS, n) + length].astype("int64"), length + 1)
            for name, values in fn(np.arange(at, at + len(seen)), seen[:, :-1], seen[:, 1:]).items():
                total[name] += int(values.sum())
        return [n, *total.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, own = batch.columns
            binary = pa.types.is_binary(own.type)
            found = [(i, np.frombuffer(x.as_buffer(), "uint8") if binary else x.values.to_numpy()) for i, x in enumerate(own) if x.is_valid]
            found = [(i, sums(x)) for i, x in found if len(x) > length]
            columns = zip(*(x for _, x in found), strict=True) if found else [[]] * (len(names) + 1)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, _ in found], "int64")), *(pa.array(c, "int64") for c in columns)], names=[key, "windows", *names])

    return rows.select(key, ids).mapInArrow(run, ", ".join([f"`{key}` {dict(rows.dtypes)[key]}", *(f"`{c}` long" for c in ("windows", *names))]))
