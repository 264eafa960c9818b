"""Byte-level BPE by a sentencepiece model that is written straight from a rank file.

Nothing is trained: the model file is serialised here. Byte b of a token becomes the character
U+0100 + b, a token's score is its negative rank, and normalisation is the identity, so
sentencepiece merges what a rank-driven encoder merges: the best rank first, the leftmost of
equals. Pre-tokens are encoded one by one; decoding maps pieces back to bytes.

Defined results: null text is empty and has no ids; ids, repeated rows and ties need no care, as
rows are independent; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .chunks import ChunkCache, flat, packed
from .common import arrow_map, record, sliced, table, text_of, tidy

#: Where the characters that stand for bytes begin.
BASE = 0x100
_TO_CHARS = {b: BASE + b for b in range(256)}


def mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(_TO_CHARS)


def unmapped(piece: str) -> bytes:
    return bytes(ord(c) - BASE for c in piece)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file in order of rank; ranks must count up from 0."""
    with open(path, "rb") as f:
        rows = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(rows)
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    if not all(tokens):
        raise ValueError(f"ranks in {path} have gaps")
    return tokens


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protocol-buffer field: a varint, a float or bytes."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: Sequence[bytes]) -> bytes:
    """A serialised sentencepiece model: piece 0 is unknown, piece r + 1 is the token of rank r."""
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    pieces += [_field(1, mapped(t).encode()) + _field(2, float(-rank)) for rank, t in enumerate(tokens)]
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(2, b"") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """``encode(texts)`` yields little-endian uint32 ids; ``decode(ids)`` gives the bytes."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.split = regex.compile(pattern).findall
        self.bytes = [unmapped(self.model.id_to_piece(i + 1)) for i in range(len(tokens))]
        self.rank = {t: i for i, t in enumerate(self.bytes)}
        self.cache = ChunkCache(self._whole, lambda chunks: flat(self._whole([c if c[0] == "\n" else " " + c for c in chunks.to_pylist()])))
        self.encode = self.cache.encode

    def _whole(self, texts: Sequence[str]) -> list[bytes]:
        words = [[w.encode() for w in self.split(t)] for t in texts]
        new = list({w for own in words for w in own if w not in self.rank})
        ids = dict(zip(new, self.model.encode([mapped(w) for w in new], num_threads=1), strict=True)) if new else {}
        return [packed([i for w in own for i in ([self.rank[w]] if w in self.rank else [x - 1 for x in ids[w]])]) for own in words]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One a worker process."""
    return Codec(path, pattern)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` with ids as little-endian uint32 bytes."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        return record(doc_id=b["id"], ids=pa.array(codec(ranks, pattern).encode(b["text"].to_pylist()), pa.binary()))

    return arrow_map(text_of(docs, id_col, text_col), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Adds ``decoded``, the bytes of the ids."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [codec(ranks, pattern).decode(x) for x in b["ids"].to_pylist()]
        return record(doc_id=b["doc_id"], ids=b["ids"], decoded=pa.array(out, pa.binary()))

    return arrow_map(encoded, run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encoded and decoded again in one pass, a few rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        with own.cache:
            for b in sliced(batches, 500):
                n, sha, back = [], [], []
                for ids in own.encode(b["text"].to_pylist(), 500_000):
                    n.append(len(ids) // 4)
                    sha.append(hashlib.sha256(ids).hexdigest())
                    back.append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield record(doc_id=b["id"], n_tokens=pa.array(n, pa.int64()), ids_sha256=pa.array(sha, pa.string()), decoded_sha256=pa.array(back, pa.string()))

    return text_of(docs, id_col, text_col).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    ranks, pattern = public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN
    return round_trip(table(spark, sf_dir, "documents"), ranks, pattern)
