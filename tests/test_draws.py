"""Draws against their definitions."""

import random
from collections import defaultdict

import pytest

from tessera.operators import draws


def test_few_shot_partners(spark):
    rows = [(t, i) for t, n in (("a", 1), ("b", 2), ("c", 4), ("d", 50)) for i in range(n)]
    found = draws.few_shot(spark.createDataFrame(rows, "task string, example int"), 3, 9)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    got = defaultdict(dict)
    for r in found.collect():
        got[r.task, r.example][r["rank"]] = r.shot
    sizes = {"a": 1, "b": 2, "c": 4, "d": 50}
    assert {k: len(v) for k, v in got.items()} == {(t, i): min(3, sizes[t] - 1) for t, i in rows if sizes[t] > 1}
    for (t, i), shots in got.items():
        assert sorted(shots) == list(range(1, len(shots) + 1)) and len(set(shots.values())) == len(shots) and i not in shots.values()
    drawn = [s for (t, _), v in got.items() if t == "d" for s in v.values()]
    assert len(set(drawn)) > 40


def published(n, k, most):
    """The draw as it is defined: candidates listed, the own place left out."""
    pool = list(range(n))
    random.Random(1337).shuffle(pool)
    pool = pool[:most]
    return [(i, x, [pool[c] for c in random.Random(1234 + i).sample([c for c in range(len(pool)) if c != i], k)]) for i, x in enumerate(pool)]


@pytest.mark.parametrize("k,most", [(0, None), (1, None), (5, None), (10, 40)])
def test_task_cases(spark, k, most):
    sizes = {"x": 11, "y": 90, "z": 300}
    rows = [(t, i) for t, n in sizes.items() for i in range(n)]
    got = draws.cases(spark.createDataFrame(rows, "task string, example long"), k, most).collect()
    assert sorted((r.task, r.place, r.example, list(r.shots)) for r in got) == [(t, *x) for t, n in sizes.items() for x in published(n, k, most)]


def test_too_few_examples_raise(spark):
    with pytest.raises(Exception, match="need a pool of 4"):
        draws.cases(spark.createDataFrame([("x", i) for i in range(3)], "task string, example long"), 3).collect()


def shuffled(n, size, seed):
    """The buffer as it is defined, over an iterator of rows."""
    rows, rng = iter(range(n)), random.Random(seed)
    buffer = [next(rows) for _ in range(min(size, n))]
    out = []
    for incoming in rows:
        at = rng.randrange(len(buffer))
        out.append(buffer[at])
        buffer[at] = incoming
    rng.shuffle(buffer)
    return out + buffer


@pytest.mark.parametrize("n,size", [(0, 5), (1, 5), (5, 5), (6, 5), (200, 7), (200, 1), (30, 1000)])
def test_buffered_shuffle(n, size):
    want = shuffled(n, size, 3)
    assert list(draws.BufferedShuffle(n, size, 3)) == want
    for stop in {0, min(1, n), n // 2, n - min(n, size), max(0, n - 2), n}:
        first = draws.BufferedShuffle(n, size, 3)
        head = [next(first) for _ in range(stop)]
        assert head + list(draws.BufferedShuffle.resumed(first.state())) == want


def test_states_that_do_not_fit_raise():
    state = draws.BufferedShuffle(10, 3, 0).state()
    for bad in (state.replace("[0, 1, 2]", "[0, 1]"), state.replace("[0, 1, 2]", "[0, 1, 9]"), state.replace("[0, 1, 2]", "[0, 1, 1]")):
        with pytest.raises(ValueError, match="fit its cursor"):
            draws.BufferedShuffle.resumed(bad)


def test_order_by_shard_and_resumption(spark, monkeypatch):
    monkeypatch.setattr(draws, "ROWS", 7)
    sizes = {0: 50, 1: 0, 2: 3}
    shards = spark.createDataFrame(list(sizes.items()), "shard_index int, n_rows int")
    whole = sorted((r.shard_index, r.position, r.row_index) for r in draws.buffered_order(shards, 10, 5).collect())
    assert whole == [(s, i, x) for s, n in sizes.items() for i, x in enumerate(shuffled(n, 10, 5))]
    got, states = [], shards
    for _ in range(4):
        rows = draws.buffered_order(states, 10, 5, most=13).collect()
        got += [(r.shard_index, r.position, r.row_index) for r in rows if r.row_index is not None]
        after = {r.shard_index: r.state for r in rows if r.row_index is None}
        states = spark.createDataFrame([(s, n, after[s]) for s, n in sizes.items()], "shard_index int, n_rows int, state string")
    assert sorted(got) == whole
