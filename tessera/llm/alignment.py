"""Alignment of two tokenizers by bitsets of token ends.

Tokens of both kinds cover the same bytes, so each token is known by where it ends. Ends are marked in
packed bitsets, one a tokenizer. Their AND has the cuts that both share; popcount ranks at these cuts give
the range of tokens of each group. Their OR has the ends of all stretches of bytes in which one token of
each kind overlaps, and the ranks of both bitsets there name the two: the links. All this is done with numpy on many
documents at a time, and on a long one a window at a time, cut at a shared cut.

A document's links are kept as distinct pairs of ids and how often they occur. Counts over the corpus are summed in tasks
first, then by pair. They go back to the documents in two exact ways: the ``HELD`` pairs (at most) with the most
links as one table that each worker holds, which takes most links and all hot pairs; all others through a join, in which
no pair has more than 1/HELD of all links.

Defined results: null and empty texts, and texts whose tokens don't spell a space and the text, have no tokens:
zeros and an empty digest; null and repeated ids and repeated rows are documents each; ties for a second id's best partner are all best;
a text of any length is aligned in windows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkCache, byte_characters, even, flat, library_cache, packed
from .common import record, sliced, table, text_of, tidy, written

#: Tokens of a window, and characters that are encoded together.
WINDOW, CHARS = 1 << 17, 500_000
#: Pairs whose counts a worker holds, 17 bytes each, and those it sums up before it passes them on.
HELD, SUMMED = 1 << 18, 1 << 21
SPACE = "▁"
FOUND = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


class Links(NamedTuple):
    """Tokens of each kind in each group, and the numbers of the tokens that each link joins."""

    group_a: np.ndarray
    group_b: np.ndarray
    a: np.ndarray
    b: np.ndarray


class Bits:
    """A packed bitset with popcount ranks."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype="i8"))

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        flags = np.zeros(-(-size // 64) * 64, "u1")
        flags[places] = 1
        return cls(np.packbits(flags, bitorder="little").view("<u8"))

    def rank(self, places: np.ndarray) -> np.ndarray:
        """How many bits are set below each place."""
        word = places >> 6
        below = (np.uint64(1) << (places & 63).astype("u8")) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def places(self) -> np.ndarray:
        """Select of all: the places of the set bits."""
        return np.flatnonzero(np.unpackbits(self.words.view("u1"), bitorder="little"))


def aligned(size_a: np.ndarray, size_b: np.ndarray) -> Links | None:
    """Groups and links up to the last shared cut of tokens of these sizes; None without one."""
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    size = int(min(end_a[-1], end_b[-1]))
    a, b = (Bits.of(e[: np.searchsorted(e, size, side="right")] - 1, size) for e in (end_a, end_b))
    cuts = Bits(a.words & b.words).places()
    if not len(cuts):
        return None
    ends = Bits(a.words | b.words).places()
    ends = ends[: np.searchsorted(ends, cuts[-1], side="right")]
    groups = (np.diff(x.rank(cuts) + 1, prepend=0) for x in (a, b))
    return Links(*groups, a.rank(ends), b.rank(ends))


class Pair:
    """Both tokenizers, the bytes of their tokens, and texts' ids with a space before the text."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto
        from tokenizers import Tokenizer

        names = Tokenizer.from_file(byte_file).get_vocab(with_added_tokens=False)
        back = {chr(c): b for b, c in byte_characters().items()}
        self.a_bytes = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.a_bytes[i] = bytes(map(back.__getitem__, name)) if set(name) <= back.keys() else name.encode()
        library = library_cache(byte_file, special_as_text=True)
        self.a = SpacedCache(lambda texts: library.whole([" " + t for t in texts]), library.glued, apart=library.apart)
        model = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        pieces = [model.id_to_piece(i) for i in range(len(model))]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        whole = lambda texts: list(map(packed, model.encode(list(texts), num_threads=1)))

        def glued(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """The model puts a space before each chunk; before a line feed it is a token of its own and none of the chunk's."""
            texts = chunks.to_pylist()
            return flat([ids[4:] if text[0] == "\n" else ids for text, ids in zip(texts, whole(texts), strict=True)])

        spec = proto.ModelProto.FromString(model.serialized_model_proto())
        plain = spec.normalizer_spec.name == "identity" and spec.normalizer_spec.add_dummy_prefix and not spec.normalizer_spec.remove_extra_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        # no piece goes on over a space or a line feed, so chunks that begin with one stand alone
        plain &= all(p.type in (1, 2, 3, 6) for p in spec.pieces) and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.b = SpacedCache(whole, glued if plain else None, apart=re.compile(SPACE))  # in texts a mark may meet the one that a space becomes
        self.a_size, self.b_size = (np.fromiter(map(len, x), "i8", len(x)) for x in (self.a_bytes, self.b_bytes))
        # a token's number with what follows it: "," within a group, "|" after its first side, ";" after its second
        self.words = [f"{i}{end}".encode() for own, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(own))]

    def __enter__(self) -> Pair:
        return self

    def __exit__(self, *_: object) -> None:
        self.a.forget()
        self.b.forget()

    def spelled(self, a: np.ndarray, b: np.ndarray, text: str) -> bool:
        raw = b" " + text.encode()
        return all(b"".join(map(own.__getitem__, ids.tolist())) == raw for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def listed(self, a: np.ndarray, b: np.ndarray, links: Links) -> np.ndarray:
        """What ``words`` to write for these groups, in order."""
        n, m = len(self.a_bytes), len(self.b_bytes)
        through_a, through_b = np.cumsum(links.group_a), np.cumsum(links.group_b)
        out = np.empty(len(a) + len(b), "i8")
        last = np.zeros(len(a), "i8")
        last[through_a - 1] = n
        out[np.arange(len(a)) + np.repeat(through_b - links.group_b, links.group_a)] = a + last
        last = np.zeros(len(b), "i8")
        last[through_b - 1] = m
        out[np.arange(len(b)) + np.repeat(through_a, links.group_b)] = 2 * n + b + last
        return out


class SpacedCache(ChunkCache):
    """Ids of texts that stand behind a space, so that first chunks are like others. ``whole`` sees to the space itself."""

    def _group(self, texts: list[str]) -> list[bytes]:
        if self.glued is None:
            return self.whole(texts)
        alike = list(map(even, texts))
        some = iter(self._joined([t for t, x in zip(texts, alike, strict=True) if x]) if any(alike) else ())
        rest = iter(self.whole([t for t, x in zip(texts, alike, strict=True) if not x]) if not all(alike) else ())
        return [next(some if x else rest) for x in alike]


@functools.lru_cache(maxsize=2)
def pair(byte_file: str, piece_file: str) -> Pair:
    """One a worker process."""
    return Pair(byte_file, piece_file)


class Document(NamedTuple):
    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    digest: str
    codes: np.ndarray  # distinct pairs of ids, ascending
    times: np.ndarray


NONE = Document(0, 0, 0, 0, "", np.empty(0, "i8"), np.empty(0, "i8"))


def _several(own: Pair, ids: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[Document]:
    """Documents that fit one window: their ends are shared cuts, so they are aligned as one."""
    a, b = (np.concatenate(x) for x in zip(*ids, strict=True))
    links = aligned(own.a_size[a], own.b_size[b])
    listed, m = own.listed(a, b, links), len(own.b_bytes)
    n_a, n_b = (np.array([len(x[k]) for x in ids]) for k in (0, 1))
    end_a = np.cumsum(n_a)
    group = np.searchsorted(np.cumsum(links.group_a), end_a, side="left") + 1  # groups up to a document's end
    link = np.searchsorted(links.a, end_a)
    of = np.repeat(np.arange(len(ids)), np.diff(link, prepend=0))
    most = len(own.a_bytes) * m
    codes, times = np.unique(of * most + a[links.a] * m + b[links.b], return_counts=True)
    first = np.append(np.searchsorted(codes, np.arange(len(ids)) * most), len(codes))
    groups, n_links, end, at = np.diff(group, prepend=0), np.diff(link, prepend=0), np.cumsum(n_a + n_b), 0
    for k in range(len(ids)):
        text = b"".join(map(own.words.__getitem__, listed[at : end[k]].tolist()))
        part = slice(first[k], first[k + 1])
        yield Document(int(n_a[k]), int(n_b[k]), int(groups[k]), int(n_links[k]), hashlib.sha256(text[:-1]).hexdigest(), codes[part] - k * most, times[part])
        at = end[k]


def _long(own: Pair, a: np.ndarray, b: np.ndarray, window: int) -> Document:
    """One document, a window at a time; a window without a shared cut is widened."""
    digest, i, j, n_groups, n_links, size = hashlib.sha256(), 0, 0, 0, 0, window
    codes, times = [], []
    while i < len(a):
        x, y = a[i : i + size], b[j : j + size]
        if (links := aligned(own.a_size[x], own.b_size[y])) is None:
            size *= 2
            continue
        x, y = x[: links.group_a.sum()], y[: links.group_b.sum()]
        text = b"".join(map(own.words.__getitem__, own.listed(x, y, links).tolist()))
        digest.update(b";" * bool(i) + text[:-1])
        new = np.unique(x[links.a] * len(own.b_bytes) + y[links.b], return_counts=True)
        codes.append(new[0])
        times.append(new[1])
        n_groups, n_links, i, j, size = n_groups + len(links.group_a), n_links + len(links.a), i + len(x), j + len(y), window
    return Document(len(a), len(b), n_groups, n_links, digest.hexdigest(), *summed(np.concatenate(codes), np.concatenate(times)))


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their sums."""
    order = np.argsort(codes, kind="stable")
    codes, first = np.unique(codes[order], return_index=True)
    return codes, np.add.reduceat(times[order], first) if len(first) else times


def documents(own: Pair, texts: Sequence[str], window: int = WINDOW, chars: int = CHARS) -> Iterator[Document]:
    waiting: list[tuple[np.ndarray, np.ndarray] | None] = []
    size = 0

    def done() -> Iterator[Document]:
        found = iter(list(_several(own, some))) if (some := [x for x in waiting if x]) else iter(())
        for x in waiting:
            yield next(found) if x else NONE

    for text, *ids in zip(texts, own.a.encode(texts, chars), own.b.encode(texts, chars), strict=True):
        a, b = (np.frombuffer(x, "<u4").astype("i8") for x in ids)
        sound = bool(text) and own.spelled(a, b, text)
        n = max(len(a), len(b)) if sound else 0
        if size + n > window:
            yield from done()
            waiting, size = [], 0
        if n > window:
            yield _long(own, a, b, window)
        else:
            waiting.append((a, b) if sound else None)
            size += n
    yield from done()


def _packed(codes: np.ndarray, wide: str) -> bytes:
    return np.diff(codes, prepend=0).astype(wide).tobytes()


def _unpacked(batch: pa.RecordBatch, wide: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the row, code, times) of all pairs of a batch."""
    size = np.array([len(x) for x in batch["times"].to_pylist()], "i8") // 4
    steps = np.frombuffer(b"".join(batch["codes"].to_pylist()), wide).astype("i8")
    end = np.cumsum(size)
    codes = np.cumsum(steps)
    some = size > 0
    codes -= np.repeat(np.append(0, codes)[(end - size)[some]], size[some])  # each row starts from 0
    return np.repeat(np.arange(len(size)), size), codes, np.frombuffer(b"".join(batch["times"].to_pylist()), "<u4").astype("i8")


class Alignments(NamedTuple):
    """``documents``: a row a document with its pairs, packed; ``pairs``: code, n (links in the corpus), best."""

    documents: DataFrame
    pairs: DataFrame
    wide: str


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> Alignments:
    """Every text by both tokenizers; a pair's code is ``first id * second ids + second id``."""
    own = pair(byte_file, piece_file)
    m = len(own.b_bytes)
    wide = "<u4" if len(own.a_bytes) * m <= 1 << 32 else "<i8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        with pair(byte_file, piece_file) as own:
            for b in sliced(batches, 500):
                found = list(documents(own, b["text"].to_pylist(), window))
                whole = {c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}
                yield record(row=pa.array(range(row, row + len(found))), doc_id=b["id"], **whole, groups_sha256=pa.array([x.digest for x in found]), codes=pa.array([_packed(x.codes, wide) for x in found], pa.binary()), times=pa.array([x.times.astype("<u4").tobytes() for x in found], pa.binary()))
                row += len(found)

    found = written(text_of(docs, id_col, text_col).mapInArrow(tidy(run), FOUND), "alignments", "zstd")
    return Alignments(found, written(pair_counts(found, m, wide), "token_pairs"), wide)


def pair_counts(found: DataFrame, m: int, wide: str) -> DataFrame:
    """Links of each pair over the corpus, and whether its second id has none with more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, times = np.empty(0, "i8"), np.empty(0, "i8")
        give = lambda: record(code=pa.array(codes), n=pa.array(times))
        for b in sliced(batches, 500):
            _, more, n = _unpacked(b, wide)
            codes, times = summed(np.append(codes, more), np.append(times, n))
            if len(codes) > SUMMED:
                yield give()
                codes, times = codes[:0], times[:0]
        if len(codes):
            yield give()

    counts = written(found.select("codes", "times").mapInArrow(tidy(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")), "pair_counts")
    most = counts.groupBy((F.col("code") % m).alias("b")).agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), F.col("code") % m == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))  # at most a row an id of the second tokenizer


def scored(found: Alignments, held: int = HELD) -> DataFrame:
    """``row, n_best, count_sum`` for each document that has links."""
    spark, wide = found.documents.sparkSession, found.wide
    size = F.floor(8 * F.log2("n")).cast("int")
    least, total = None, 0
    for r in sorted(found.pairs.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("k")).collect(), key=lambda r: -r["size"]):  # at most 8 * 63 rows
        if (total := total + r.k) > held:
            break
        least = r["size"]
    many = F.lit(False) if least is None else size >= least
    hot = found.pairs.where(many).toArrow().sort_by("code")  # at most `held` rows
    shared = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for b in sliced(batches, 500):
            of, code, times = _unpacked(b, wide)
            at = np.searchsorted(codes, code)
            there = np.zeros(len(code), bool)
            inside = at < len(codes)
            there[inside] = codes[at[inside]] == code[inside]
            at, rows, row = at[there], b["row"].to_numpy(), of[there]
            sums = np.zeros((2, len(rows)), "i8")
            np.add.at(sums[0], row, times[there] * best[at])
            np.add.at(sums[1], row, times[there] * counts[at])
            some, cold = np.unique(of), ~there
            null = pa.nulls(len(some), pa.int64())
            yield record(row=pa.array(rows[some]), n_best=pa.array(sums[0][some]), count_sum=pa.array(sums[1][some]), code=null, times=null)
            null = pa.nulls(int(cold.sum()), pa.int64())
            yield record(row=pa.array(rows[of[cold]]), n_best=null, count_sum=null, code=pa.array(code[cold]), times=pa.array(times[cold]))

    parts = written(found.documents.select("row", "codes", "times").where("octet_length(times) > 0").mapInArrow(tidy(run), "row long, n_best long, count_sum long, code long, times long"), "scored")
    cold = parts.where("code is not null").select("row", "code", "times").join(found.pairs.where(~many), "code")
    cold = cold.select("row", F.when(F.col("best"), F.col("times")).otherwise(F.lit(0)).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum"))
    return parts.where("code is null").select("row", "n_best", "count_sum").union(cold).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def document_alignments(found: Alignments, held: int = HELD) -> DataFrame:
    """A row a document: its tokens, groups and links, and what their pairs count in the corpus."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.documents.drop("codes", "times").join(scored(found, held), "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return document_alignments(align(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")))
