"""Embedding near-duplicates against all pairs in double precision."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest

from tessera.llm import vectors
from tessera.llm.components import components


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_is_lost(seed):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, 24))
    x = vectors.unit_rows(np.concatenate([base, base + r.normal(size=base.shape) * r.uniform(0.05, 0.6, (40, 1))]))
    codes = vectors.Codes(*vectors.quantised(x))
    found, tried = set(), 0
    for part, sure, doubt in vectors.strips(codes, codes, 0.9):
        tried += int(doubt.sum())
        i, j = np.nonzero(sure | vectors.true_pairs(x[part], x, doubt, 0.9))
        found |= set(zip((i + part.start).tolist(), j.tolist()))
    want = x @ x.T >= 0.9
    assert found == set(zip(*map(np.ndarray.tolist, np.nonzero(want)))) and tried < want.size / 4


def test_error_bound_holds():
    r = np.random.default_rng(1)
    x = vectors.unit_rows(r.normal(size=(200, 64)))
    q, s, e = vectors.quantised(x)
    rough = (q.astype("f8") @ q.T.astype("f8")) * s[:, None] * s[None]
    assert (np.abs(rough - x @ x.T) <= e[:, None] + e[None] + e[:, None] * e[None]).all()


def test_operator(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + 0.05 * r.normal(size=base.shape), base[:5] * 3]))]
    rows += [(900 + i, v) for i, v in enumerate([None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [], [1.0], [2.0], [1e300] * 16, [1e-300] * 16])]
    rows += [(7, base[7].tolist()), (None, base[8].tolist())]
    df = spark.createDataFrame([(i, v, 1, "k") for i, v in rows], "vec_id long, embedding array<double>, n_links int, key string")
    got = vectors.near_duplicates(df, tile=37).collect()
    ok = [(k, np.array(v)) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    unit = {k: vectors.unit_rows(v[None])[0] for k, v in ok}
    near = {k: [m for m in unit if m != k and len(unit[m]) == len(unit[k]) and unit[m] @ unit[k] >= 0.9] for k in unit}
    want = expected(rows, near)
    assert sorted(map(repr, want)) == sorted(repr((x.vec_id, x.n_links, x.component_id, x.kept)) for x in got)
    assert vectors.near_duplicates(df.limit(0)).collect() == []


def expected(rows, near):
    want = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for m in near.get(todo.pop(), []):
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min((rows[m][0] for m in seen if rows[m][0] is not None), default=None)
        want.append((i, len(near.get(k, [])), least, None if i is None or least is None else i == least))
    return want


def test_null_id_links_others(spark):
    """A vector without an id joins two groups that have no other link."""
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    rows = [(4, at(0)), (None, at(20)), (3, at(40)), (9, at(180))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(x.vec_id, x.n_links, x.component_id) for x in got} == {(4, 1, 3), (None, 2, 3), (3, 1, 3), (9, 0, 9)}


def test_dense_cluster_in_little_memory():
    """All pairs of 8,192 close vectors link; a task keeps counts and a forest, not the links."""
    code = """if True:
        import resource, sys
        import numpy as np
        from tessera.llm import vectors
        r = np.random.default_rng(2)
        x = vectors.unit_rows(r.normal(size=64) + 0.02 * r.normal(size=(8192, 64)))
        codes = vectors.Codes(*vectors.quantised(x))
        before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        met, at = vectors.Met(np.ones(len(x), dtype="i8")), np.arange(len(x))
        for part, sure, doubt in vectors.strips(codes, codes, 0.9):
            met.add(at[part], at, sure | vectors.true_pairs(x[part], x, doubt, 0.9), False)
        print(int(met.links.min()), len(met.groups.edges), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
    """
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    links, edges, mb = map(int, out.stdout.split()[-3:])
    assert links == 8192 and edges == 8191 and mb < 300


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5), (None, 3)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {a: find(a) for a in root}
