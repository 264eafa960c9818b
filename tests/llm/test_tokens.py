"""Token images and byte-level BPE: round trips and other libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import byte_bpe, chunks, token_store  # noqa: E402

WORDS, RANKS = public.path("word_bpe_49k.json"), public.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "Hello World", "hello  world\n", "É é 🚀 <|endoftext|>", "x" * 3000, "don't 1234", "hello  world\n", "one <|endoftext|> two<|startoftext|>", "<|ENDOFTEXT|> <|endoftext"]


@pytest.mark.parametrize("seed", range(8))
def test_elias_fano(seed):
    r = random.Random(seed)
    values = np.cumsum([r.choice([0, 1, 3, 1000 * (seed + 1)]) for _ in range(r.randint(0, 1500))])
    ef = token_store.EliasFano.build(values)
    assert ef.all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    if len(values):
        bits = 64 * (len(ef.high) + len(ef.low)) + 32 * len(ef.samples)
        assert bits <= len(values) * (3.2 + max(0, np.log2((values[-1] + 1) / len(values)))) + 400
        with pytest.raises(IndexError):
            ef.select(len(values))


@pytest.mark.parametrize("ids", [[], [b""], [b"\1\0\0\0" * 5, b"", b"\2\0\0\0"]])
def test_image_round_trip(ids):
    names = [None, 7, -1][: len(ids)]
    one = token_store.Image.read(token_store.image(names, ids, 2))
    ends = one.ends.all()
    assert one.doc_ids == names and [one.ids[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends], ends)] == ids


def test_store(spark, tmp_path):
    docs = spark.createDataFrame([(100 - i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, start string")
    images = token_store.write_images(docs, WORDS, 1, image_ids=50)
    rows = sorted(token_store.read_images(images).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(100 - i for i in range(len(TEXTS)))
    t = Tokenizer.from_file(WORDS)
    at = 0
    for r in rows:
        want = np.array(t.encode(TEXTS[100 - r.doc_id] or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(want) // 4, zlib.crc32(want), want)
        at += r.n_tokens
    names = token_store.export(images, str(tmp_path))
    assert sum(len(token_store.Image.read((tmp_path / n).read_bytes()).doc_ids) for n in names) == len(TEXTS)
    assert token_store.read_images(token_store.write_images(docs.limit(0), WORDS, 1)).collect() == []


def test_widths():
    assert token_store.width_of(WORDS) == 2
    with pytest.raises(ValueError):
        token_store.image([1], [np.array([70_000], dtype="<u4").tobytes()], 2)
    assert token_store.Image.read(token_store.image([1], [np.array([70_000], dtype="<u4").tobytes()], 4)).ids.tolist() == [70_000]


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "b c"), (3, "a"), (None, None), (3, "a"), (3, "x y")], "doc_id long, text string")
    rows = sorted(token_store.read_images(token_store.write_images(docs, WORDS, 1)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 3, 3, 3] and [r.n_tokens for r in rows] == [1, 3, 2, 2, 3]


def test_other_files_are_encoded_whole(tmp_path):
    from tokenizers import normalizers, pre_tokenizers

    t = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    t.normalizer, t.pre_tokenizer = normalizers.Lowercase(), pre_tokenizers.ByteLevel(add_prefix_space=True)
    t.save(str(tmp_path / "other.json"))
    cache = chunks.library_cache(str(tmp_path / "other.json"))
    assert cache.glued is None
    texts = ["Some Text here", "", "A b"]
    assert list(cache.encode(texts)) == [chunks.packed(t.encode(x, add_special_tokens=False).ids) for x in texts]


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_peer(peer):
    r = random.Random(3)
    parts = [" ", "\n", "\t", "a", "É", "'s", "1", "!", "　", "ß", "İ", "\x1f", "\x85", "語", "²", "🚀", "\0", "́", "ing"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 16))) for _ in range(3000)] + ["ab" * 4000]
    codec = byte_bpe.codec(RANKS, public.PATTERN)
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == chunks.packed(peer.encode_ordinary(text)) and codec.decode(ids) == text.encode()


def test_byte_bpe_operator(spark, peer):
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids binary")
    encoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public.PATTERN), RANKS, public.PATTERN)
    for r in encoded.collect():
        assert bytes(r.decoded) == (TEXTS[r.doc_id] or "").encode() and bytes(r.ids) == chunks.packed(peer.encode_ordinary(TEXTS[r.doc_id] or ""))
    for r in byte_bpe.round_trip(docs, RANKS, public.PATTERN).collect():
        ids = chunks.packed(peer.encode_ordinary(TEXTS[r.doc_id] or ""))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((TEXTS[r.doc_id] or "").encode()).hexdigest())
    assert byte_bpe.round_trip(docs.limit(0), RANKS, public.PATTERN).collect() == []
