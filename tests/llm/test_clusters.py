"""Exponion rounds against full scans."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import clusters


def slow(rows, k, rounds, dim, scale, seed):
    """(vec_id, cluster, distance) by full scans with Python integers; and the centroids."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            if own := [v for (_, v), c in zip(kept, of, strict=True) if c == n]:
                centroids[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    return [(i, *near(v)[::-1]) for i, v in kept], centroids


def sort(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("kind", ["spread", "ties", "copies"])
def test_rounds_equal_full_scans(spark, kind):
    r = random.Random(kind)
    value = {"spread": lambda: r.gauss(0, 1), "ties": lambda: r.randint(-1, 1) / 256, "copies": lambda: 0.5}[kind]
    rows = [(i // 2, [value() for _ in range(4)]) for i in range(300)]
    rows += [(None, [0.1, 0.2, 0.3, -0.4]), (7, None), (8, []), (9, [1.0, None, 0.0, 0.0]), (10, [1.0, float("nan"), 0.0, 0.0]), (11, [float("inf")] * 4), (12, [0.0] * 3)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    found, centroids = clusters.clustered(df, k=9, rounds=4, dim=4)
    want, means = slow(rows, 9, 4, 4, 256, 2)
    assert centroids.tolist() == means
    assert sort(found.collect()) == sort(want)


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    found, centroids = clusters.clustered(df, dim=2)
    assert centroids.tolist() == [[256, 512]] * 2 and sort(found.collect()) == [(1, 0, 0), (2, 0, 0)]
    rows = clusters.with_inertia(found, centroids).collect()
    assert {(r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows} == {(0, 0, hashlib.sha256(b"256,512").hexdigest())}
    empty, centroids = clusters.clustered(df.limit(0), dim=2)
    assert empty.collect() == [] and clusters.with_inertia(empty, centroids).collect() == []
    with pytest.raises(Exception, match="beyond"):
        clusters.clustered(spark.createDataFrame([(1, [1e9])], "vec_id long, embedding array<double>"), dim=1)


@pytest.mark.parametrize("seed", range(20))
def test_search_computes_less_and_finds_the_same(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(1, 30))
    hubs = r.integers(-4000, 4000, (k, 3))
    x = (hubs[r.integers(0, k, 2000)] + r.integers(-60, 60, (2000, 3))).astype("i8")
    old, new = hubs.astype("i8"), (hubs + r.integers(-20, 20, (k, 3))).astype("i8")
    new[-1] = new[0]  # equal centroids
    now, seen = clusters.updated(x, clusters.nearest(x, old, np.arange(k)), clusters.moved(old, new), clusters.Search.of(new))
    d = clusters.squares(x, new)
    assert (now.cluster == d.argmin(axis=1)).all()
    least = np.sqrt(np.sort(d, axis=1))
    assert (now.upper >= least[:, 0]).all() and (k == 1 or (now.lower <= least[:, 1]).all())
    assert k < 8 or seen < len(x) * k / 2


def test_products_are_exact_for_large_components():
    x = np.array([[1 << 26, -(1 << 26)], [3, 5]], "i8")
    assert clusters.squares(x, x).tolist() == [[0, sum(int(v) ** 2 for v in x[0] - x[1])], [sum(int(v) ** 2 for v in x[0] - x[1]), 0]]
