"""Mixtures against counting, and the parts of the draw against their definitions."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def test_targets():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [3, 1]) == [0, 0]
    assert mixing.targets([10, 100, 0], [3, 1, 2]) == [20, 145, 0]
    r = random.Random(5)
    for _ in range(200):
        sizes, weights = [r.randint(0, 50) for _ in range(r.randint(1, 9))], [3, 1, 2] * 3
        got = mixing.targets(sizes, weights)
        assert sum(got) == Fraction(3, 2) * sum(sizes) and all(0 <= t <= 2 * s for t, s in zip(got, sizes, strict=True))
        free = [t / w for t, s, w in zip(got, sizes, weights, strict=False) if t < 2 * s]
        assert len(set(free)) <= 1  # what isn't stopped is in proportion to the weights
        assert all(2 * s <= free[0] * w for t, s, w in zip(got, sizes, weights, strict=False) if free and t == 2 * s)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    p = mixing.Permutation(n, 7, 0, 1)
    out = p(np.arange(n))
    assert sorted(out.tolist()) == list(range(n)) and p(out, back=True).tolist() == list(range(n))
    assert n < 1000 or (out != mixing.Permutation(n, 8, 0, 1)(np.arange(n))).mean() > 0.9


def test_draw_meets_the_target_to_the_word():
    r = random.Random(1)
    for _ in range(500):
        size, block = r.randint(1, 200), r.randint(1, 30)
        words = r.randint(0, 2 * size)
        s = mixing.draw(3, size, words, block, 9)
        of = lambda b: min(block, size - b * block)  # noqa: E731, B023
        order = [int(b) for e in range(3) for b in mixing.Permutation(s.blocks, 9, 3, e)(np.arange(s.blocks))][: s.quota]
        got = [of(b) for b in order]
        if s.more:
            assert 0 < s.last <= got[-1]
            got[-1] = s.last
        assert sum(got) == words and max(Counter(order).values(), default=0) <= 2


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_splitting_tree(shards):
    quotas = np.array([5, 0, 1000, 33, 1], "i8")
    known: dict = {}
    walks = [mixing.own_share(i, shards, quotas, 3, known) for i in range(shards)]
    at = np.zeros(5, "i8")
    for i, (start, own) in enumerate(walks):
        assert (start == at).all() and own.sum() == 1039 * (i + 1) // shards - 1039 * i // shards
        again = mixing.own_share(i, shards, quotas, 3, {})  # as an executor that starts here would
        assert (again[0] == start).all() and (again[1] == own).all()
        at += own
    assert (at == quotas).all()


def test_split_has_the_hypergeometric_mean():
    quotas = np.array([300, 100], "i8")
    first = [mixing.own_share(0, 4, quotas, seed, {})[1][0] for seed in range(400)]
    assert abs(np.mean(first) - 75) < 1 and 3 < np.var(first) < 25  # the variance is 14.1


def corpus():
    r = random.Random(2)
    text = lambda n: " \n".join(f"w{i}" for i in range(n))
    rows = [(i, text(r.choice([0, 1, 5, 40])), r.choice(["a", "b", "é", None])) for i in range(300)]
    rows += [(500, text(5000), "a"), (501, None, "empty"), (502, " \t\x0b", None), (None, "x y", "b"), (None, "x y", "b"), (600, "x y", "b"), (600, "x y", "b")]
    return rows


@pytest.mark.parametrize("block", [7, 64])
def test_mixture(spark, block):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, start int").repartition(5)
    mix = mixing.mixed(docs, block=block, shard=300, seed=4)
    found = mixing.taken(mix).collect()
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r["size"]) for r in found) == Counter((i, size(t)) for i, t, _ in rows)
    own = defaultdict(int)
    for _, t, s in rows:
        own[s] += size(t)
    order = sorted(own, key=lambda s: (s is None, s))
    aims = dict(zip(order, mixing.targets([own[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))]), strict=True))
    by_id = {i: s for i, t, s in rows if i is not None}
    got = defaultdict(int)
    for r in found:
        s = "b" if r.doc_id is None else by_id[r.doc_id]
        assert (r.source_size, r.target) == (own[s], float(aims[s])) and 0 <= r.taken <= 2 * r["size"]
        got[s] += r.taken
    assert got == {s: int(aims[s]) for s in order}
    pieces = mix.pieces.collect()
    shards = defaultdict(list)
    for p in pieces:
        shards[p.shard].append(p)
    assert len(shards) > 5 and all(sorted(p.place for p in own) == list(range(len(own))) for own in shards.values())
    assert all(len({p.source_no for p in own}) > 1 for own in shards.values() if len(own) > 20)
    met = [(p.source_no, p.epoch, w) for p in pieces for w in range(p.start + p.from_word, p.start + p.to_word)]
    assert len(met) == len(set(met))  # a word is drawn once an epoch
    again = mixing.taken(mixing.mixed(docs.repartition(2), block=block, shard=300, seed=4)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(key, found)) == sorted(map(key, again))


def test_piece_texts(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{i}.{j}" for j in range(30)), "ab"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    mix = mixing.mixed(docs, block=11, shard=100)
    words = Counter(w for r in mixing.piece_texts(mix, docs).collect() for w in r.text.split())
    assert sum(words.values()) == 900 and max(words.values()) <= 2
    by = Counter()
    for w, n in words.items():
        by[int(w.split(".")[0])] += n
    assert by == {r.doc_id: r.taken for r in mixing.taken(mix).collect()}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mixed(docs)).collect() == []
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert [tuple(r)[:6] for r in mixing.taken(mixing.mixed(none)).collect()] == [(1, 0, 0, 0.0, 0, 0)]
