"""Centroid clustering of integer vectors: Lloyd rounds with Exponion search.

Vectors are kept in blocks, a row a block, with what the search knows of each: its centroid, an upper bound of its
distance to it and a lower bound of its distance to any other. After centroids have moved, a vector
whose upper bound stays below the lower one, or below half the way to the nearest other centroid, keeps its
centroid unseen. Any other looks only at centroids inside a ball around its centroid, of radius
``2 * upper + gap`` (``gap``: the way to the nearest other centroid): the ball holds the two nearest ones. Balls are
prefixes of the sorted list of distances between centroids; the radius is inclusive, and squared
distances are whole numbers, so that ties are seen and go to the smaller number. Bounds are
doubles that are rounded outwards and never decide between two centroids.

A round is one pass over the blocks, written as a table, from which only sums by cluster are read
(``k`` rows of ``dim`` sums). The driver sees centroids only. The list of distances has ``k * k`` entries,
so ``k`` is for hundreds or a few thousand centroids, not for more.

Defined results: vectors of another length, or null, or with null or non-finite components, are left
out; rows with a null id are vectors like others, but start no centroid before those with an id; repeated ids and rows are a vector
each; with fewer vectors than centroids every vector starts one; an empty table gives an empty result; other columns are ignored.
A component of more than 2**27 in size after scaling is refused with an error, as distances wouldn't fit 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, record, sliced, table, tidy, written

K, ROUNDS, DIM, SCALE, SEED = 40, 5, 64, 256, 2
#: Vectors of a block.
BLOCK = 4096
#: The largest component, and the largest whose products are exact in doubles.
MOST, EXACT = 1 << 27, 1 << 22
#: Far above what square roots and sums of bounds lose, relative to the distance.
SLACK = 1e-9
BLOCKS = "ids array<long>, v binary, cluster binary, upper binary, lower binary, moved binary"


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) <= EXACT // math.isqrt(max(1, x.shape[1])):
        a, b = x.astype("f8"), c.astype("f8")
        return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)).astype("i8")
    out = np.empty((len(x), len(c)), "i8")
    for j, own in enumerate(c):
        out[:, j] = ((x - own) ** 2).sum(axis=1)
    return out


class Search(NamedTuple):
    """Centroids, and the sorted lists of distances between them."""

    centroids: np.ndarray  # int64, k rows
    order: np.ndarray  # for each centroid all of them by distance, itself first
    far: np.ndarray  # those distances, rounded down
    gap: np.ndarray  # the way to the nearest other centroid, rounded down

    @classmethod
    def of(cls, centroids: np.ndarray) -> Search:
        between = np.sqrt(squares(centroids, centroids)) * (1 - SLACK)
        np.fill_diagonal(between, -1.0)  # itself first, also among equals
        order = np.argsort(between, axis=1, kind="stable")
        far = np.maximum(np.take_along_axis(between, order, axis=1), 0)
        return cls(centroids, order, far, far[:, 1] if len(centroids) > 1 else np.full(len(centroids), np.inf))


class Bounds(NamedTuple):
    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def nearest(x: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> Bounds:
    """The nearest of some centroids (their numbers ascending), and the distance to the second as a lower bound."""
    d = squares(x, centroids[among])
    best = d.argmin(axis=1)  # the first of equals
    rows = np.arange(len(x))
    least = np.sqrt(d[rows, best])
    if len(among) > 1:
        d[rows, best] = np.iinfo("i8").max
        second = np.sqrt(d.min(axis=1))
    else:
        second = np.full(len(x), np.inf)
    return Bounds(among[best], least * (1 + SLACK), second * (1 - SLACK))


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each centroid has moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(axis=1)) * (1 + SLACK)


def updated(x: np.ndarray, known: Bounds, step: np.ndarray, search: Search) -> tuple[Bounds, int]:
    """Bounds of vectors after centroids have moved by ``step``; and how many distances were computed."""
    own, upper, lower = (a.copy() for a in known)
    top = int(step.argmax())
    others = np.full(len(step), step[top])
    others[top] = np.delete(step, top).max(initial=0)
    upper = (upper + step[own]) * (1 + SLACK)
    lower = np.maximum(0, lower - others[own]) * (1 - SLACK)
    safe = np.maximum(search.gap[own] / 2 * (1 - SLACK), lower)
    at = np.flatnonzero(upper >= safe)
    upper[at] = np.sqrt(((x[at] - search.centroids[own[at]]) ** 2).sum(axis=1)) * (1 + SLACK)
    seen = len(at)
    at = at[upper[at] >= safe[at]]
    radius = (2 * upper[at] + search.gap[own[at]] * (1 + 3 * SLACK)) * (1 + SLACK)
    for c in np.unique(own[at]):
        of = at[own[at] == c]
        inside = np.searchsorted(search.far[c], radius[own[at] == c], side="right")  # inclusive
        # vectors whose balls hold about as many centroids are looked at together
        sizes = np.minimum(len(step), 1 << np.ceil(np.log2(np.maximum(inside, 1))).astype("i8"))
        for size in np.unique(sizes):
            rows = of[sizes == size]
            found = nearest(x[rows], search.centroids, np.sort(search.order[c, :size]))
            own[rows], upper[rows], lower[rows] = found
            seen += len(rows) * int(size)
    return Bounds(own, upper, lower), seen


def sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each cluster its number of vectors, then the sums of their components."""
    out = np.zeros((k, x.shape[1] + 1), "i8")
    order = np.argsort(cluster, kind="stable")
    there, first = np.unique(cluster[order], return_index=True)
    if len(there):
        out[there, 1:] = np.add.reduceat(x[order], first, axis=0)
        out[there, 0] = np.diff(np.append(first, len(x)))
    return out


def blocks(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int) -> DataFrame:
    """``ids, v``: sound vectors as integers, a block a row."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    own = df.where(sound).select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, BLOCK):
            x = np.floor(scale * b["x"].values.to_numpy()[b["x"].offsets[0].as_py() : b["x"].offsets[-1].as_py()])
            if np.abs(x).max() > MOST:
                raise ValueError(f"a component is beyond {MOST} after scaling")
            yield record(ids=pa.array([b["id"].to_pylist()], pa.list_(pa.int64())), v=pa.array([x.astype("<i4").tobytes()], pa.binary()))

    return own.mapInArrow(tidy(run), "ids array<long>, v binary")


def first_centroids(df: DataFrame, id_col: str, vector_col: str, dim: int, scale: int, k: int, seed: int) -> np.ndarray:
    """The ``k`` sound vectors whose ids have the least hashes; of equal ids the lesser vector first."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    sound = vector.isNotNull() & (F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("long").cast("string")), 256)
    rows = df.where(sound).select(name.alias("h"), F.transform(vector, lambda x: F.floor(x * scale).cast("long")).alias("v"))
    found = rows.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in found], dtype="i8").reshape(-1, dim)


def _vectors(v: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(v, "<i4").reshape(-1, dim).astype("i8")


def cluster_means(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Each cluster's componentwise floor of the mean; a cluster without vectors keeps its centroid. Only sums are read."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), "i8")
        for b in batches:
            for own in b["moved"].to_pylist():
                total += np.frombuffer(own, "<i8").reshape(k, dim + 1)
        some = np.flatnonzero(total[:, 0])
        if len(some):
            yield record(cluster=pa.array(some, pa.int32()), sums=pa.array(total[some].tolist(), pa.list_(pa.int64())))

    parts = blocks.select("moved").mapInArrow(run, "cluster int, sums array<long>")
    out = centroids.copy()
    for row in parts.groupBy("cluster").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim + 1)]).collect():  # k rows
        c, n, *total = row
        out[c] = [x // n for x in total]
    return out


def clustered(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, cluster, distance`` (squared) of each sound vector after ``rounds`` moves of the centroids and a last assignment; and the centroids."""
    centroids = first_centroids(df, id_col, vector_col, dim, scale, k, seed)
    k = len(centroids)
    if not k:
        return df.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    state, old = written(blocks(df, id_col, vector_col, dim, scale), "vector_blocks"), None

    def assigned(state: DataFrame, centroids: np.ndarray, old: np.ndarray | None) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((Search.of(centroids), None if old is None else moved(old, centroids)))  # k rows, k * k distances

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search, step = shared.value
            for b in sliced(batches, 1):
                x = _vectors(b["v"][0].as_py(), dim)
                if step is None:
                    now = nearest(x, search.centroids, np.arange(k))
                else:
                    known = Bounds(*(np.frombuffer(b[c][0].as_py(), t) for c, t in (("cluster", "<i4"), ("upper", "<f8"), ("lower", "<f8"))))
                    now, _ = updated(x, known, step, search)
                parts = {"cluster": now.cluster.astype("<i4"), "upper": now.upper.astype("<f8"), "lower": now.lower.astype("<f8"), "moved": sums(x, now.cluster, k).astype("<i8")}
                yield record(ids=b["ids"], v=b["v"], **{c: pa.array([a.tobytes()], pa.binary()) for c, a in parts.items()})

        return written(state.mapInArrow(tidy(run), BLOCKS), "clustered_blocks")

    for _ in range(rounds):
        before, state = state, assigned(state, centroids, old)
        dropped(before)
        old, centroids = centroids, cluster_means(state, centroids, dim)
    before, state = state, assigned(state, centroids, old)
    dropped(before)
    final = centroids

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1):
            x, own = _vectors(b["v"][0].as_py(), dim), np.frombuffer(b["cluster"][0].as_py(), "<i4")
            distance = ((x - final[own]) ** 2).sum(axis=1)
            yield record(vec_id=b["ids"].flatten(), cluster=pa.array(own, pa.int32()), distance=pa.array(distance, pa.int64()))

    return state.select("ids", "v", "cluster").mapInArrow(tidy(listed), "vec_id long, cluster int, distance long"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the sums of distances by cluster and over all, and each centroid's digest: a row a centroid is broadcast."""
    spark = found.sparkSession
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    by = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = by.agg(F.sum("cluster_inertia").alias("inertia"))
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    rows = by.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(total))  # one row
    return found.join(F.broadcast(rows), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    return with_inertia(written(found, "vector_clusters"), centroids)


def oracle(k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> str:
    """The same result by full scans in SQL."""
    def nearest(r: int) -> str:
        d = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        return f"a{r} AS MATERIALIZED (SELECT r, min({{'d': {d}, 'n': c.n}}) AS best FROM kept x, c{r} c GROUP BY r)"

    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS n, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for r in range(rounds):
        parts += [
            nearest(r),
            f"s{r} AS MATERIALIZED (SELECT n, list(mean ORDER BY i) AS v FROM (SELECT n, i, ((s - ((s % m) + m) % m) // m)::BIGINT AS mean FROM (SELECT best.n AS n, i, sum(v[i]) AS s, count(*) AS m FROM a{r} JOIN kept USING (r), range(1, {dim + 1}) t(i) GROUP BY ALL)) GROUP BY n)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.n, coalesce(s.v, c.v) AS v FROM c{r} c LEFT JOIN s{r} s ON s.n = c.n)",
        ]
    parts.append(nearest(rounds))
    return f"""WITH {', '.join(parts)}
SELECT vec_id, best.n::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.n))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (r) JOIN c{rounds} c ON c.n = best.n"""
