"""Packers against slow models and fixed vectors."""

import random

import pytest

from tessera.operators import row_packing as P


def linear_plan(documents, length):
    """Scans all rows for the tightest."""
    left, out = [], []
    for doc, n in documents:
        start = 0
        while start == 0 or start < n:
            k = min(n - start, length)
            fitting = [(x, i) for i, x in enumerate(left) if x >= k + 1] if start == 0 else []
            row = min(fitting)[1] if fitting else len(left)
            if not fitting:
                left.append(length + 1)
            left[row] -= k + 1
            out.append((row, doc, start, k))
            start += k
            if k == 0:
                break
    return out


@pytest.mark.parametrize("seed", range(12))
def test_best_fit_equals_linear_scan(seed):
    r = random.Random(seed)
    length = r.randint(1, 12)
    docs = list(enumerate([0, length, length + 1, 2 * length] + [r.randint(0, 4 * length) for _ in range(60)]))
    assert [(p[0], p[2], p[3], p[4]) for p in P.best_fit(docs, length)] == linear_plan(docs, length)


def test_ties_go_to_the_earliest_row():
    rows = {}
    for row, _, doc, *_ in P.best_fit([(0, 5), (10, 5), (20, 3)], 9):
        rows.setdefault(row, []).append(doc)
    assert list(rows.values()) == [[0, 20], [10]]


def test_each_token_is_supervised_once(spark):
    docs = [(0, i, [1000 * i + k for k in range(n)]) for i, n in enumerate([0, 3, 9, 20, 8, 1, 0, 17])]
    df = spark.createDataFrame(docs, "shard_index int, doc_id long, ids array<int>").selectExpr("*", "size(ids) as n_tokens")
    rows = P.materialised(P.best_fit_rows(df, 8, "shard_index"), df.select("shard_index", "doc_id", "ids"), 8, -7, "shard_index").collect()
    seen = []
    for r in rows:
        assert len(r.inputs) == len(r.targets) == len(r.mask) == 8
        assert r.inputs[1:] == r.targets[:-1]
        seen += [t for t, m in zip(r.targets, r.mask) if m and t != -7]
        for x, t, m in zip(r.inputs, r.targets, r.mask):
            if m and t != -7 and t % 1000:
                assert x == t - 1
            elif m and t != -7:
                assert x == -7
    assert sorted(seen) == sorted(t for _, _, ids in docs for t in ids)


def test_buffered_golden_batch():
    def source():
        yield [(0, [10, 11]), (1, [20, 21, 22])]
        while True:
            yield [(2, [30, 31, 32, 33, 34])]

    rows = list(P.buffered(source(), 2, 5, 99, 3))
    assert [r for r, _ in rows] == [[99, 30, 31, 32, 33, 34], [99, 30, 31, 32, 33, 34]]
    assert rows[0][1] == [(2, 5)]


def test_buffered_crops_the_shortest():
    row, kept = next(P.buffered(iter([[(0, [1, 2, 3, 4, 5, 6, 7]), (1, [8, 9, 10, 11, 12, 13])]]), 1, 3, 99, 2))
    assert row == [99, 8, 9, 10] and kept == [(1, 3)]


def test_conversation_rows_take_the_largest_that_fits():
    rows = {}
    for row, _, conv, n in P.conversation_rows([(1, 4), (2, 6), (3, 3), (4, 40)], 9, 10):
        rows.setdefault(row, []).append((conv, n))
    assert list(rows.values()) == [[(4, 10)], [(2, 6), (1, 4)], [(3, 3)]]


def test_mixture_repeats_sources():
    order = P.mixture_order([("a", 3, 1), ("b", 2, 4)], 5, 0)
    assert sorted(order) == ["a"] * 3 + ["b"] * 8 and order != P.mixture_order([("a", 3, 1), ("b", 2, 4)], 5, 1)


def test_labels(spark):
    df = spark.createDataFrame([([1, 2, 3], [True, False, True])], "ids array<int>, mask array<boolean>")
    assert df.select(P.labels("ids", "mask")).first()[0] == [-1, 3]
