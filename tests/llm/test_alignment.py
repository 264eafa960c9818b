"""Groups, links and counts against tokens' byte ranges compared one by one."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

public = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from tessera.llm import alignment  # noqa: E402

A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
TEXTS = ["", None, "Hello World", "hello  world\n", "É é 🚀 <|endoftext|> <s>", "a\nb c\nd", "\n\n x", "tabs\tand blanks ▁ x", "don't 1234 <0x41>", "ﬁne ｗｉｄｅ ①", "x" * 700, " lead", "trail ", "naïve coöperation, überall; 東京と大阪。", "▁under ▁", "The quick brown fox\njumps over the lazy dog " * 20]


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def slow(texts):
    t, m = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    from tessera.llm.chunks import byte_characters

    back = {chr(c): b for b, c in byte_characters().items()}
    piece = lambda i: bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
    docs, corpus = [], Counter()
    for text in texts:
        raw = (" " + (text or "")).encode()
        a = spans((i, bytes(map(back.__getitem__, t.id_to_token(i)))) for i in t.encode(" " + (text or ""), add_special_tokens=False).ids)
        b = spans((i, piece(i)) for i in m.encode(text or ""))
        joined = [b"".join(x) for x in ((bytes(map(back.__getitem__, t.id_to_token(i))) for i, _, _ in a), (piece(i) for i, _, _ in b))]
        if not text or joined != [raw, raw]:
            docs.append(None)
            continue
        links = Counter((i, k) for i, s, e in a for k, u, v in b if s < v and u < e)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        groups = [";".join([])]
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in own if low <= s and e <= cut) for own in (a, b)))
            low = cut
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        corpus += links
    most = Counter()
    for (_, k), n in corpus.items():
        most[k] = max(most[k], n)
    out = []
    for d in docs:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            links = d[3]
            out.append((*d[:3], sum(links.values()), sum(n for p, n in links.items() if corpus[p] == most[p[1]]), sum(n * corpus[p] for p, n in links.items()), d[4]))
    return out


@pytest.mark.parametrize("held,window", [(1 << 18, 1 << 17), (40, 64), (0, 1)])
def test_alignment(spark, held, window):
    r = random.Random(held)
    texts = TEXTS + ["".join(r.choice(["a", "the", " ", "\n", "é", "🚀", "▁", "12", "ing", "  ", "\t", "'s"]) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["Hello World"] * 30
    rows = [(i % 50 if i % 7 else None, t, i, "row") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, code string").repartition(3)
    out = alignment.document_alignments(alignment.align(docs, A, B, window=window), held)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, out.collect())) == Counter((row[0], *w) for row, w in zip(rows, slow(texts), strict=True))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.document_alignments(alignment.align(docs, A, B)).collect() == []
    none = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.document_alignments(alignment.align(none, A, B)).collect()), key=str) == [(1, *[0] * 6, ""), (None, *[0] * 6, "")]


@pytest.mark.parametrize("seed", range(30))
def test_bitsets(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 400))
    cut = lambda: np.diff(np.append(np.append(0, np.sort(r.choice(np.arange(1, n), int(r.integers(0, n)), replace=False))), n)) if n > 1 else np.array([1])
    a, b = cut(), cut()
    links = alignment.aligned(a, b)
    ea, eb = np.cumsum(a), np.cumsum(b)
    assert list(zip(links.a.tolist(), links.b.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]]
    shared = sorted(set(ea.tolist()) & set(eb.tolist()))
    assert np.cumsum(links.group_a).tolist() == [int((ea <= c).sum()) for c in shared] and np.cumsum(links.group_b).tolist() == [int((eb <= c).sum()) for c in shared]
    bits = alignment.Bits.of(ea - 1, n)
    assert bits.places().tolist() == (ea - 1).tolist() and bits.rank(np.arange(n)).tolist() == [int((ea - 1 < p).sum()) for p in range(n)]


def test_ids_equal_the_libraries():
    r = random.Random(3)
    own, t, m = alignment.pair(A, B), Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    texts = ["".join(r.choice(["a", "the", " ", " ", "\n", "é", "🚀", "▁", "12", "ing", "\t", "'s", "<s>", "<0x41>", "日本", " ", "\r", "Ω", "́"]) for _ in range(r.randint(1, 40))) for _ in range(4000)]
    for text, a, b in zip(texts, own.a.encode(texts), own.b.encode(texts), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == t.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert np.frombuffer(b, "<u4").tolist() == m.encode(text), repr(text)
