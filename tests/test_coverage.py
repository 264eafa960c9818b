"""The sweep over packed pieces against counting each token."""

import random
from collections import Counter

import pytest

from tessera.operators import coverage
from tessera.operators import row_packing as P

LENGTH = 7
PLAN = "shard_index int, " + P.PIECES


def slow(plan, sizes):
    out = {}
    for at in {(p[0], p[3]) for p in plan} | set(sizes):
        own = [p for p in plan if (p[0], p[3]) == at]
        met = Counter(i for p in own for i in range(p[4], p[4] + p[5]))
        n = sizes.get(at)
        missing = 0 if n is None else sum(i not in met for i in range(n))
        gaps = sum(i not in met for i in range(max(met, default=-1) + 1))
        beyond = 0 if n is None else max(0, max((p[4] + p[5] for p in own), default=0) - n)
        repeated = sum(k - 1 for k in met.values())
        ends = [p for p in own if p[7]]
        marks = len(ends) != 1 or ends[0][4] + ends[0][5] != max(p[4] + p[5] for p in own) or any(p[6] != (p[4] > 0) for p in own)
        fault = "no document" if n is None else "no piece" if not own else "beyond the end" if beyond else "missing tokens" if missing else "repeated tokens" if repeated else "marks" if marks else None
        out[at] = (len(own), gaps if n is None else missing, repeated, beyond, sum(p[5] + p[7] for p in own), fault)
    return out


def test_faults_are_named(spark):
    r = random.Random(9)
    sizes = {(g, i): r.choice([0, 1, 6, 7, 8, 14, 15, 40]) for g in range(3) for i in range(60)}
    plan = [(g, *x) for g in range(3) for x in P.best_fit([(i, n) for (h, i), n in sizes.items() if h == g], LENGTH)]
    planted = [list(p) for p in plan for _ in range(1 if r.random() > 0.03 else r.choice([0, 2]))]
    for p in planted:
        kind = r.randrange(40)
        if kind == 0:
            p[7] = not p[7]
        elif kind == 1:
            p[4] += 2
        elif kind == 2:
            p[5] = max(0, p[5] - 1)
        elif kind == 3:
            p[3] += 1000
        elif kind == 4:
            p[6] = not p[6]
    sized = spark.createDataFrame([(*k, n) for k, n in sizes.items()], "shard_index int, doc_id long, n_tokens int")
    for rows, sound in ((plan, True), ([tuple(p) for p in planted], False)):
        got = {(x[0], x[1]): tuple(x)[2:] for x in coverage.coverage(spark.createDataFrame(rows, PLAN), sized, "shard_index").collect()}
        assert got == slow(rows, sizes)
        assert {x[-1] for x in got.values()} == ({None} if sound else {None, "no document", "no piece", "beyond the end", "missing tokens", "repeated tokens", "marks"})
    assert coverage.row_faults(spark.createDataFrame(plan, PLAN), LENGTH, "shard_index").collect() == []
    bad = spark.createDataFrame([(0, 0, 0, 1, 0, 7, False, True), (0, 0, 1, 2, 0, 1, False, True), (0, 1, 1, 3, 0, 1, False, True)], PLAN)
    assert {(x.row, x.fault) for x in coverage.row_faults(bad, LENGTH, "shard_index").collect()} == {(0, "too many tokens"), (1, "slots")}


@pytest.mark.parametrize("kind", ["plan", "sizes"])
def test_empty(spark, kind):
    plan, sizes = spark.createDataFrame([], PLAN), spark.createDataFrame([(0, 1, 3)], "shard_index int, doc_id long, n_tokens int")
    got = coverage.coverage(plan, sizes if kind == "plan" else sizes.limit(0), "shard_index").collect()
    assert [x.fault for x in got] == (["no piece"] if kind == "plan" else [])
