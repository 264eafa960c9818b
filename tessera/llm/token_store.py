"""Token-id images with Elias-Fano document boundaries.

An image holds the ids of consecutive documents as one array, their boundaries in Elias-Fano
form and their document ids. Images are rows of a Parquet table, since only Spark's own
writers reach every kind of store; ``export`` writes them as plain files, too.

Image, little-endian::

    8  magic "TESSERA1"
    1  bytes an id (2 or 4)   1  low bits l   6  zero
    8  documents d            8  ids n        8  words of high bits h
    high bits   h x uint64    document i's end e sets bit (e >> l) + i
    low bits    ceil(d*l/64) x uint64
    samples     uint32: the high-bit position of every 256th end
    document ids  d x int64   validity of those  ceil(d/8) bytes
    ids         n x uint16 or uint32

``select(i)`` starts from a sample, so an end is found in near-minimal space without a table of
64-bit offsets.

Defined results: null text is empty (the end id alone); null ids come first; equal ids and
repeated rows are ordered by text; an empty table gives an empty result; other columns are
ignored, whatever their names. Ids are those that the tokenizers library gives with its defaults; an
id that doesn't fit the image's width is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import library_cache, width_of
from .common import record, sliced, table, text_of, tidy, written

MAGIC, SAMPLE = b"TESSERA1", 256
HEAD = struct.Struct("<8sBB6xQQQ")


@dataclass
class EliasFano:
    """Non-decreasing numbers below ``universe`` in about ``n * (2 + log2(universe / n))`` bits."""

    n: int
    low_bits: int
    high: np.ndarray
    low: np.ndarray
    samples: np.ndarray

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype="u8")
        n = len(values)
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)) + np.arange(n, dtype="u8")
        bits = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, dtype="u1")
        bits[at] = 1
        wide = np.zeros(-(-n * low_bits // 64) * 64, dtype="u1")
        if low_bits:
            each = (values[:, None] >> np.arange(low_bits, dtype="u8")) & np.uint64(1)
            wide[: n * low_bits] = each.ravel()
        words = lambda b: np.packbits(b, bitorder="little").view("<u8")
        return cls(n, low_bits, words(bits), words(wide), at[::SAMPLE].astype("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype="u8")
        at = i.astype("u8") * np.uint64(self.low_bits)
        word, shift = at >> np.uint64(6), at & np.uint64(63)
        more = np.append(self.low, np.zeros(1, dtype="<u8"))
        hi = np.where(shift > 0, more[word + np.uint64(1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((more[word] >> shift) | hi) & np.uint64((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number: from the sample before it, word by word, to its bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = int(self.samples[i // SAMPLE])
        need, word = i % SAMPLE, start >> 6
        bits = int(self.high[word]) >> (start & 63) << (start & 63)
        while (have := bits.bit_count()) <= need:
            need, word = need - have, word + 1
            bits = int(self.high[word])
        for _ in range(need):
            bits &= bits - 1
        at = (word << 6) + (bits & -bits).bit_length() - 1
        word, shift = divmod(i * self.low_bits, 64)
        low = int(self.low[word]) >> shift if self.low_bits else 0
        if shift + self.low_bits > 64:
            low |= int(self.low[word + 1]) << 64 - shift
        return (at - i << self.low_bits) | low & (1 << self.low_bits) - 1

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high.view("u1"), bitorder="little"))
        i = np.arange(self.n)
        return (((at - i).astype("u8") << np.uint64(self.low_bits)) | self._low(i)).astype("i8")


def image(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    """An image of documents whose ids come as little-endian uint32 bytes."""
    ef = EliasFano.build(np.cumsum([len(x) // 4 for x in ids]))
    flat = np.frombuffer(b"".join(ids), dtype="<u4")
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"id {flat.max()} doesn't fit {width} bytes")
    valid = np.array([x is not None for x in doc_ids], dtype=bool)
    names = np.array([x or 0 for x in doc_ids], dtype="<i8")
    head = HEAD.pack(MAGIC, width, ef.low_bits, ef.n, len(flat), len(ef.high))
    return b"".join((head, ef.high.tobytes(), ef.low.tobytes(), ef.samples.tobytes(), names.tobytes(), np.packbits(valid, bitorder="little").tobytes(), flat.astype(f"<u{width}").tobytes()))


@dataclass
class Image:
    """A read image; ``ids[ends.select(i - 1):ends.select(i)]`` is document i."""

    ends: EliasFano
    doc_ids: list[int | None]
    ids: np.ndarray

    @classmethod
    def read(cls, raw: bytes) -> Image:
        magic, width, low_bits, docs, n, words = HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token image")
        at = HEAD.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
            at += out.nbytes
            return out

        high, low, samples = take("<u8", words), take("<u8", -(-docs * low_bits // 64)), take("<u4", -(-docs // SAMPLE))
        names, valid = take("<i8", docs), np.unpackbits(take("u1", -(-docs // 8)), bitorder="little")[:docs]
        ids = take(f"<u{width}", n)
        return cls(EliasFano(docs, low_bits, high, low, samples), [int(x) if ok else None for x, ok in zip(names, valid, strict=True)], ids)


IMAGES = "part int, before long, n_docs long, n_ids long, image binary"


def write_images(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int | None = None, image_ids: int = 2_000_000) -> DataFrame:
    """The written table of images in ascending order of document ids: ``part``, then ``before``.

    ``width`` is what the tokenizer's ids and the end id need, unless it is given. Documents are dealt out by ranges of their ids; each task encodes its range in order and closes
    an image after ``image_ids`` ids, so memory is bounded by an image and a document.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = width or (4 if end_id >> 16 else width_of(tokenizer))
    end = np.array([end_id], dtype="<u4").tobytes()
    ordered = text_of(docs, id_col, text_col).repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), library_cache(tokenizer)
        names, own, size, before = [], [], 0, 0

        def closed() -> pa.RecordBatch:
            return record(part=pa.array([part], pa.int32()), before=pa.array([before], pa.int64()), n_docs=pa.array([len(names)], pa.int64()), n_ids=pa.array([size], pa.int64()), image=pa.array([image(names, own, width)], pa.binary()))

        with cache:
            for batch in sliced(batches, 1000):
                for key, ids in zip(batch["id"].to_pylist(), cache.encode(batch["text"].to_pylist()), strict=True):
                    names.append(key)
                    own.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= image_ids:
                        yield closed()
                        names, own, size, before = [], [], 0, before + size
        if names:
            yield closed()

    return written(ordered.mapInArrow(tidy(run), IMAGES), "token_images", "zstd")


def read_images(images: DataFrame, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (little-endian uint32) from written images; ``start`` counts over all of them.

    A document's place in its image comes from the select structure.
    """
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row a write task
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, raw in zip(*(batch[c].to_pylist() for c in ("part", "before", "image")), strict=True):
                one = Image.read(raw)
                ends = np.fromiter(map(one.ends.select, range(one.ends.n)), dtype="i8", count=one.ends.n)
                starts = np.concatenate([[0], ends[:-1]])
                wide = memoryview(one.ids.astype("<u4")).cast("B")
                own = [wide[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = {"doc_id": pa.array(one.doc_ids, pa.int64()), "start": pa.array(starts + before + base[part]), "n_tokens": pa.array(ends - starts), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64())}
                yield record(**columns, **({"ids": pa.array([bytes(x) for x in own], pa.binary())} if with_ids else {}))

    return images.mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def export(images: DataFrame, directory: str) -> list[str]:
    """Write images as files ``part-before.tsr`` of a local directory; for small tables and tests, one image at a time."""
    import os

    names = []
    for r in images.orderBy("part", "before").toLocalIterator():
        names.append(f"{r['part']:05d}-{r['before']:012d}.tsr")
        with open(os.path.join(directory, names[-1]), "wb") as f:
            f.write(r["image"])
    return names


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    images = write_images(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)
    return read_images(images, with_ids=False)
