"""Rank selection against sorted values."""

import math
import random

import pytest

from tessera.operators.quantiles import quantiles

SHARES = (0, 0.01, 0.5, 0.9, 0.95, 1)


def slow(values, p):
    own = sorted(values, key=lambda v: (math.isnan(v), v))
    place = (len(own) - 1) * p
    a, b = own[math.floor(place)], own[math.ceil(place)]
    return a if a == b or math.isnan(a) and math.isnan(b) else (math.floor(place) + 1 - place) * a + (place - math.floor(place)) * b


def groups():
    r = random.Random(4)
    near = [1.0]
    while len(near) < 500:
        near.append(math.nextafter(near[-1], 2))
    return {
        "spread": [r.gauss(0, 1) * 10 ** r.randint(-300, 300) for _ in range(2000)], "near": r.sample(near, 400), "copies": [3.5] * 900 + [-7.0] * 100, "one": [2.0], "zeros": [0.0, -0.0, 5e-324, -5e-324, 0.0],
        "odd": [math.inf, -math.inf, 1.0, 2.0, math.inf, math.nan, math.nan], "wide": [-1.7e308, 1.7e308, 1.0, 2.0, 3.0], None: [float(i) for i in range(77)], "cluster": [10 ** (-i / 7) for i in range(1500)],
    }


def test_quantiles_by_group(spark):
    rows = [(g, v) for g, own in groups().items() for v in own] + [("spread", None), ("none", None)]
    random.Random(0).shuffle(rows)
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], SHARES).collect()}
    want = groups()
    assert got.keys() == want.keys()
    for g, own in want.items():
        assert got[g].n == len(own)
        for i, p in enumerate(SHARES):
            a, b = got[g][f"q{i}"], slow(own, p)
            assert a == b or math.isnan(a) and math.isnan(b), (g, p, a, b)


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_all_rows(spark, n):
    r = random.Random(n)
    values = [r.choice([r.random(), 0.25]) for _ in range(n)]
    got = quantiles(spark.createDataFrame([(v,) for v in values], "v double"), "v", [], (0.5, 0.9)).collect()
    assert [(x.n, x.least, x.largest, x.q0, x.q1) for x in got if x.n] == ([(n, min(values), max(values), slow(values, 0.5), slow(values, 0.9))] if n else [])
