"""BPE against recounting models, and chunks against another regex engine."""

import random
from collections import Counter

import pytest
import regex

from tessera.functions.text import SPLIT_PATTERN, regex_chunks
from tessera.operators import bpe, bpe_rounds


def slow_train(chunks, merges):
    words, out = list(chunks.items()), []
    for k in range(merges):
        counts = Counter()
        for c, n in words:
            for p in zip(c, c[1:]):
                counts[p] += n
        if not counts:
            raise ValueError
        pair = min(counts, key=lambda p: (-counts[p], p))
        out.append((*pair, 256 + k, counts[pair]))
        words = [(bpe.merged(c, pair, 256 + k), n) for c, n in words]
    return out


@pytest.mark.parametrize("seed", range(15))
def test_training_equals_recounting(seed):
    r = random.Random(seed)
    chunks = {}
    for _ in range(r.randint(2, 8)):
        c = tuple(r.randrange(4) for _ in range(r.randint(0, 9)))
        chunks[c] = chunks.get(c, 0) + r.randint(1, 3)
    for merges in range(12, -1, -1):
        try:
            want = slow_train(chunks, merges)
        except ValueError:
            with pytest.raises(ValueError):
                bpe.train(chunks, merges)
            continue
        assert [(m.left, m.right, m.token, m.count) for m in bpe.train(chunks, merges)] == want
        break


@pytest.mark.parametrize("seed", range(10))
def test_encoding_equals_sweeping(seed):
    r = random.Random(seed)
    merges = bpe.train({tuple(r.randrange(3) for _ in range(40)): 1}, 8)
    ranks = {(m.left, m.right): (m.rank, m.token) for m in merges}
    ids = tuple(r.randrange(3) for _ in range(60))
    want = ids
    while pairs := [p for p in zip(want, want[1:]) if p in ranks]:
        best = min(pairs, key=lambda p: ranks[p][0])
        want = bpe.merged(want, best, ranks[best][1])
    assert bpe.encode(ids, ranks) == list(want)


def test_merging_does_not_overlap():
    assert bpe.merged((7, 7, 7), (7, 7), 9) == (9, 7)


CASES = ["", "I'm we'd I'LL", "word  next \t  ", "a1234b", "x\r\n\r\ny", "Καλημέρα κόσμε", "한국어 テスト", "☕🚀 x", "a b c", "  lead", "f(x)+=1;\n\n", "\x85 x"]


def test_chunks_equal_another_engine(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r.i: r.c for r in rows.select("i", regex_chunks(rows.t).alias("c")).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == regex.findall(SPLIT_PATTERN, t) and "".join(got[i]) == t


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    merges = bpe.train_on(docs, 262)
    vocab = bpe.vocabulary(merges)
    for r in bpe.encoded(docs, merges).collect():
        assert bpe.decode(r.ids, vocab) == CASES[r.doc_id]
    total = bpe.compression(docs.selectExpr("*", "'x' as g"), bpe.encoded(docs, merges), "g").first()
    assert total.bytes == sum(len(t.encode()) for t in CASES) and total.tokens < total.bytes


def in_rounds(chunks, merges, candidates):
    """The rounds of ``train_in_rounds`` over one block, without Spark; and how many there were."""
    import numpy as np

    ids = np.array([x for c in chunks for x in (*c, bpe_rounds.END)], "i8")
    weights = np.array(list(chunks.values()), "i8")
    out, rounds = [], 0
    while len(out) < merges:
        codes, n = bpe_rounds.pairs_of(ids, weights)
        top = sorted((((int(c) >> 32, int(c) & 0xFFFFFFFF), int(k)) for c, k in zip(codes, n)), key=lambda x: (-x[1], x[0]))[:candidates]
        if not top:
            raise ValueError
        listed, beside = np.array(sorted(a << 32 | b for (a, b), _ in top), "i8"), {}
        for before, place, near, count in bpe_rounds.neighbours_of(ids, weights, listed):
            for p, x, k in zip(place, near, count):
                beside.setdefault((before, (int(listed[p]) >> 32, int(listed[p]) & 0xFFFFFFFF)), {})[int(x)] = int(k)
        known, new = bpe_rounds.Certain(top, len(top) < candidates, beside), []
        while len(out) < merges and (step := known.next()):
            out.append((*step[0], 256 + len(out), step[1]))
            new.append(out[-1][:3])
            known.merge(step[0], new[-1][2])
        assert new
        ids, rounds = bpe_rounds.applied(ids, new), rounds + 1
    return out, rounds


@pytest.mark.parametrize("seed", range(300))
def test_rounds_equal_recounting(seed):
    r = random.Random(seed)
    chunks, letters = {}, r.choice([2, 3, 5, 12])
    for _ in range(r.randint(2, 30)):
        c = tuple(r.randrange(letters) for _ in range(r.randint(0, r.choice([4, 12]))))
        chunks[c] = chunks.get(c, 0) + r.choice([1, 1, 2, 50])
    for merges in (40, 10, 3, 1):
        try:
            want = slow_train(chunks, merges)
        except ValueError:
            with pytest.raises(ValueError):
                in_rounds(chunks, merges, r.choice([1, 3, 500]))
            continue
        for candidates in (1, 3, 20, 500):
            assert in_rounds(chunks, merges, candidates)[0] == want
        break


def test_rounds_find_many_merges():
    r = random.Random(0)
    words = {tuple(r.choice(b"etaoinshrdlu") for _ in range(r.randint(2, 9))): 1 + int(r.paretovariate(1)) for _ in range(3000)}
    out, rounds = in_rounds(words, 600, 512)
    assert [x[:3] for x in out] == [(m.left, m.right, m.token) for m in bpe.train(words, 600)] and rounds < 300


def test_training_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(bpe_rounds, "PENDING", 5)
    monkeypatch.setattr(bpe_rounds, "BLOCK", 7)
    docs = spark.createDataFrame([(i, t * (1 + i % 3)) for i, t in enumerate(CASES)], "doc_id long, text string")
    assert bpe_rounds.train_over(docs, 256 + 25, candidates=20) == bpe.train_on(docs, 256 + 25)
    with pytest.raises(ValueError, match="only 0 merges"):
        bpe_rounds.train_over(docs.limit(0), 257)
