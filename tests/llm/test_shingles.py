"""The shingle join against all pairs."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_sets():
    r = random.Random(1)
    parts = ["a", "B", "é", "É", " ", "\t", "\x0b", "\n", "\x1f", "\x85", "word", "  "]
    texts = ["", " ", "one"] + ["".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(500)]
    arrow = pa.array(["skip me", *texts]).slice(1)
    names = {}
    for t, own in zip(texts, shingles.sets(arrow), strict=True):
        want = brute(t)
        assert len(own) == len(want) and (own[1:] > own[:-1]).all()
        assert names.setdefault(frozenset(want), own.tolist()) == own.tolist()
    assert len({tuple(v) for v in names.values()}) == len(names)


@pytest.mark.parametrize("n", [1, 3, 7, 20, 90, 130, 300, 1500])
def test_linked_sets_share_a_signature_and_close_sketches(n):
    r = np.random.default_rng(n)
    for _ in range(30):
        a = np.unique(r.integers(0, 1 << 63, n, dtype="u8") * 2)
        lost, new = (int(r.integers(0, len(a) // 4 + 1)) for _ in range(2))
        b = np.unique(np.concatenate([r.permutation(a)[lost:], r.integers(0, 1 << 63, new, dtype="u8") * 2 + 1]))
        hot = np.sort(r.permutation(shingles.signatures(a, shingles.NONE))[: n // 3])
        frequent = (hot, r.permutation(len(hot)))
        apart = len(np.setxor1d(a, b))
        assert shingles.distance(shingles.sketch(a), shingles.sketch(b)) <= apart
        if shingles.links(a, b):
            assert apart <= (len(a) + len(b)) // 7
            assert np.intersect1d(shingles.signatures(a, shingles.NONE), shingles.signatures(b, shingles.NONE)).size
            assert np.intersect1d(shingles.signatures(a, frequent), shingles.signatures(b, frequent)).size


def test_runs_do_not_depend_on_batches():
    r = np.random.default_rng(2)
    rows = sorted({(int(a), int(b)) for a, b in zip(r.zipf(1.4, 800) % 60, r.integers(0, 90, 800))})
    sig, key = (np.array(x) for x in zip(*rows))

    def pairs(cuts):
        runs, out = shingles.Runs(), []
        for a, b in zip([0, *cuts], [*cuts, len(sig)]):
            if b > a:
                out += list(zip(*runs.take(sig[a:b], key[a:b])))
        return sorted(out + list(zip(*runs.rest())), key=repr)

    want = []
    for s in np.unique(sig):
        own = key[sig == s].tolist()
        if len(own) > shingles.SHORT:
            want += [(own[0], b, int(s)) for b in own[1:]]
            want += [(own[j], b, None) for i, b in enumerate(own) for j in range(max(1, i - shingles.CHAIN), i)]
        else:
            want += [(a, b, None) for i, a in enumerate(own) for b in own[i + 1 :]]
    want = [(a, b, run) for a, b, run in want if run is not None or shingles.sizes_fit(a, b)]
    for cuts in ([], [1, 2, 3], list(range(len(sig))), [100, 200, 400]):
        assert pairs(cuts) == sorted(want, key=repr)


def test_keys_never_part_sizes_that_may_link():
    for n in [*range(1, 300), 1000, 4097, 10**6, 10**9]:
        for m in {n, math.ceil(n * 0.75), n * 4 // 3}:
            if shingles.NUM * max(n, m) <= shingles.DEN * min(n, m):
                assert shingles.sizes_fit(round(64 * math.log2(n)), round(64 * math.log2(m)))
    assert not shingles.sizes_fit(round(64 * math.log2(100)), round(64 * math.log2(140)))


def test_operator(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    doc = lambda n: [r.choice(words) for _ in range(n)]
    rows, passage = [], doc(60)
    for size in (8, 20, 60, 130, 260, 600):
        base = doc(size)
        for _ in range(25):
            v = list(base)
            for _ in range(r.randint(1, max(1, size // 22))):
                v[r.randrange(len(v))] = r.choice(words)
            rows.append(" ".join(v))
    rows += [" ".join(doc(r.randint(5, 20)) + passage + doc(r.randint(5, 20))) for _ in range(60)]
    rows += [rows[0], rows[0].upper(), None, "", " \n", "one", "ONE", "a b c d e", "A b\tc d\x0be"]
    ids = list(range(len(rows)))
    r.shuffle(ids)
    docs = spark.createDataFrame([(i, t, 1, "h") for i, t in zip(ids, rows)], "doc_id long, text string, n int, sketch string")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in shingles.near_duplicates(docs).collect()}
    own = {i: brute(t) for i, t in zip(ids, rows)}
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in ids:
        for b in ids:
            both = len(own[a] & own[b])
            if a < b and both and 100 * both >= 75 * len(own[a] | own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: (len(own[i]), find(i)) for i in ids}


def test_edges(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "alone here"), (9, "x y"), (9, "x y"), (9, "other text of some words"), (2, "other text of some words")]
    got = shingles.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, ((x.doc_id, x.component_id) for x in got))) == sorted(map(repr, [(None, 4), (4, 4), (None, None), (9, 9), (9, 9), (9, 2), (2, 2)]))
    assert shingles.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_without_ids_link_others(spark):
    """A row without an id bridges two documents, and groups without any id have no name."""
    words = [f"w{i}" for i in range(60)]
    a, b, c = " ".join(words), " ".join(["x0", *words[1:]]), " ".join(["x0", *words[1:59], "y0"])
    far = " ".join([*[f"x{i}" for i in range(6)], *words[6:55], *[f"y{i}" for i in range(5)]])
    docs = [(7, a, 1), (None, b, 2), (3, c, 3), (None, "p q r s t u v", 4), (None, "p q r s t u v", 5), (9, "", 6), (9, "", 7), (4, far, 8)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, node int")
    got = {(x.doc_id, x.n_shingles): x.component_id for x in shingles.near_duplicates(frame).collect()}
    assert got[7, 56] == got[None, 56] == got[3, 56] == 3 and got[None, 3] is None and got[9, 0] == 9
    kept = shingles.deduplicated(frame).collect()
    assert kept[0].__fields__ == ["doc_id", "text", "node"]
    assert sorted(x.node for x in kept if x.node not in (4, 5)) == [3, 6, 7, 8] and sum(x.node in (4, 5) for x in kept) == 1


def test_deduplicated_tells_rows_by_text(spark):
    """Of rows with one id only the copy goes; repeated rows stay once."""
    long = " ".join(f"k{i}" for i in range(30))
    docs = [(1, long, "a"), (2, long, "b"), (2, "one clean text of its own here", "c"), (5, "said twice in the very same words", "d"), (5, "said twice in the very same words", "d")]
    kept = sorted(x.row for x in shingles.deduplicated(spark.createDataFrame(docs, "doc_id long, text string, row string")).collect())
    assert kept == ["a", "c", "d"]
    assert shingles.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []
