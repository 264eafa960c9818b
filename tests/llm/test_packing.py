"""Best-fit packing: plans, cuts, and the whole operator against the tokenizer."""

import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import chunks, packing  # noqa: E402

BPE = public_tokenizers.path("byte_bpe_50k.json")


def reachable(counts, space):
    sums = {0}
    for n, k in counts.items():
        for _ in range(k):
            sums |= {s + n for s in sums if s + n <= space}
    return max(sums)


@pytest.mark.parametrize("seed", range(30))
def test_fullest_is_the_fullest(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 30): r.randint(1, 4) for _ in range(6)}
    space = r.randint(1, 60)
    found = packing.fullest(counts, space)
    assert sum(n * k for n, k in found) == reachable(counts, space) and all(k <= counts[n] for n, k in found)


@pytest.mark.parametrize("seed", range(10))
def test_plan_places_each_rank_once(seed):
    r = random.Random(seed)
    counts = {r.randint(1, 64): r.randint(1, 200) for _ in range(20)}
    rows = packing.plan(counts, 64)
    length = np.repeat(list(counts), list(counts.values()))
    rank = np.concatenate([np.arange(n) for n in counts.values()])
    sequence, offset = packing.placed(length, rank, rows)
    bins = {}
    for s, o, n in zip(sequence, offset, length):
        bins.setdefault(int(s), []).append((int(o), int(n)))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 64
    total = sum(n * k for n, k in counts.items())
    assert len(bins) <= -(-total // 64) + 1 + sum(k for n, k in counts.items() if n > 32) // 4 + 3


def test_cut():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def test_operator(spark):
    texts = ["", None, "one", "one", "two words " * 40, "x" * 900, "é 🚀\n\n  z"] + [f"text {i} " * (i % 17) for i in range(120)]
    docs = spark.createDataFrame([(None if i == 3 else i, t, "noise", 1) for i, t in enumerate(texts)], "doc_id long, text string, piece string, offset int")
    rows = packing.best_fit_packing(docs, BPE, capacity=32, keep_ids=True).collect()
    t = Tokenizer.from_file(BPE)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), dtype="<u4").tolist()
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and r.length == len(ids) <= 32
        assert ids == want[3 if r.doc_id is None else r.doc_id][r.start : r.start + r.length]
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
    assert len(bins) == -(-sum(r.length for r in rows) // 32)


def test_empty_table(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), BPE).collect() == []


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunk_cache_is_exact(file, as_text):
    r = random.Random(7)
    parts = [" ", " ", "\n", "\t", "a", "Bc", "É", "'s", "1", "!", "%%", "　", "ß", "İ", "\x1f", "語", "<|endoftext|>", "<|startoftext|>", "<|"]
    texts = ["", " ", "\n", "\nfoo", "a\nb", "a ", "don't  stop", "\x85 a\x85\x85b"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 16))) for _ in range(3000)]
    t = Tokenizer.from_file(public_tokenizers.path(file))
    t.encode_special_tokens = as_text
    cache = chunks.library_cache(public_tokenizers.path(file), as_text)
    assert cache.glued is not None
    for text, ids in zip(texts, cache.encode(texts, 500), strict=True):
        assert chunks.packed(t.encode(text, add_special_tokens=False).ids) == ids, text


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_are_encoded_once_whatever_stands_beside_them(file, monkeypatch):
    """Long chunks in some groups don't make the cache lose the others."""
    words = [f"{a}{w}{b}" for a in ("", "\n") for w in ("word", "WORD", "Éàß", "ÀÖØöøÿ", "x", "J\u030c", "1a") for b in ("", ".", ",a", "'s", "1%É")]
    texts = ["a" + "".join(w if w[0] == "\n" else " " + w for w in (*words, "y" * k, "z")) for k in (1, 100, 3, 1000, 40, 5000)]
    t = Tokenizer.from_file(public_tokenizers.path(file))
    cache, seen = chunks.library_cache(public_tokenizers.path(file)), []
    glued = cache.glued
    monkeypatch.setattr(cache, "glued", lambda some: (seen.extend(some if isinstance(some, list) else some.to_pylist()), glued(some))[1])
    with cache:
        for text, ids in zip(texts, cache.encode(texts, 1), strict=True):
            assert chunks.packed(t.encode(text, add_special_tokens=False).ids) == ids
    assert len(words) < len(seen) == len(set(seen))
