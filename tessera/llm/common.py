"""Shared plumbing: written intermediate tables, Arrow helpers and URL-free paths.

Intermediate tables go to ``spark.checkpoint.dir``, the folder that driver and executors
share. It is read from the session; only where it is unset (tests, notebooks) a local
temporary folder is chosen, once an application.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONF = "spark.checkpoint.dir"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that a worker takes at a time.
ROWS = 1000
#: The size of a bitmap of keys; at most 16 MB, twice that as words.
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 27
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; the path is only ever opened by Spark's readers."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that every executor sees; only a local session may leave it unset."""
    at = spark.conf.get(CONF, None)
    if not at:  # the setting can't be changed once a session runs, so the choice is kept here
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {CONF} to a folder that the driver and all executors share")
        at = _own.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="tessera-")
        _own[spark.sparkContext.applicationId] = at
    return at.rstrip("/")


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """What runs meanwhile sends workers at most ``rows`` rows at a time; the session's setting, or a smaller one of its own, holds again after it."""
    own = spark.conf.get(BATCH, None)
    if rows is None or own is not None and 0 < int(own) <= rows:
        yield
        return
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if own is None else spark.conf.set(BATCH, own)


def written(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage and survives the loss of any executor. The schema is kept as it is, so an
    empty frame comes back empty, too. ``rows``: the most that a worker is sent at a time; for whole texts,
    as executors hold each batch twice while they make it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    with batches_of(spark, rows):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave back, once all that is read from them has been written itself."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def text_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` with null text as the empty string; other columns, whatever their names, are pruned."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def whole_rows(df: DataFrame) -> DataFrame:
    """Each row as a struct ``row``, so that columns added beside it clash with none of its own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``; none for an empty batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def given_back() -> None:
    """Gives memory that is free in this worker back to the machine: workers are kept and used again by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory given back at the end of each task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            given_back()

    return tidied


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            if (out := fn(batch)) is not None and out.num_rows:
                yield out

    return df.mapInArrow(tidy(run), schema)


def possibly(df: DataFrame, keys: DataFrame, columns: dict[str, Column], mark: str) -> DataFrame:
    """``df`` with a boolean column ``mark``: false only for rows whose key isn't among ``keys``. ``columns``: the key's columns in ``keys``, each with what it is in ``df``.

    Keys are hashed into a bitmap whose size follows their number up to a fixed bound, so it can be
    broadcast. Beyond the bound more rows are marked that aren't there, but none is ever lost.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (32 * keys.count()).bit_length()))
    place = lambda *own: F.pmod(F.xxhash64(*own), F.lit(bits))
    at = place(*columns)
    rows = keys.groupBy(F.floor(at / 32_768).cast("long").alias("_row")).agg(F.bitmap_construct_agg(at % 32_768).alias("_bits"))
    word = lambda i: F.conv(F.hex(F.substring("_bits", 4 * i + 1, 4)), 16, 10).cast("long")
    rows = rows.select("_row", F.transform(F.sequence(F.lit(0), F.lit(1023)), word).alias("_words"))
    out = df.withColumn("_at", place(*columns.values()))
    out = out.withColumn("_row", F.floor(F.col("_at") / 32_768).cast("long")).join(F.broadcast(rows), "_row", "left")  # at most MOST_BITS / 32768 rows
    # words of four bytes, the first byte highest, in each the first bit lowest
    within = F.col("_at") % 32
    bit = F.getbit(F.get("_words", (F.col("_at") % 32_768 / 32).cast("int")), (F.lit(24) - within + 2 * (within % 8)).cast("int"))
    return out.withColumn(mark, F.coalesce(bit == 1, F.lit(False))).drop("_at", "_row", "_words")


def record(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
