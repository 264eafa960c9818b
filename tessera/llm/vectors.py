"""Near-duplicates among embeddings: int8 tile products with rigorous error bounds.

Each unit vector u is stored once as s*q with int8 codes q. Two such products differ from the true
cosine by at most ``e_a + e_b + e_a*e_b`` plus rounding, where ``e`` is the length of u - s*q, measured for
each vector in double precision and rounded up. So a pair whose quantised product falls short of
the threshold by more than that can't link, and one that exceeds it by as much surely does; only the
others are computed again in double precision. Codes are multiplied as float32 matrices, in which
sums of int8 products are exact.

Vectors are dealt into tiles by a hash; each task multiplies the codes of one pair of tiles, a
strip at a time, and keeps of a strip the number of links of each vector and a spanning forest
of the links, never the links themselves. So memory is bounded by the codes of two tiles and a
strip, whatever the vectors. Vectors that have a pair in doubt are sent to a second pass over the same tile
pair in full precision, and only these. Vectors with equal components are one class, computed
once and counted as often as they occur, so a group of copies of any size costs nothing.

Defined results: a null vector, a zero vector, or one with null or non-finite components links with
nothing (0 links, its own component); vectors of other lengths link only within their length;
repeated ids are a vector each; rows with a null id link like others, also between others, but name no
component, so one that meets no other id has a null component and a null ``kept``; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import record, sliced, table, written
from .components import components

THRESHOLD = 0.9
#: Vectors of a tile, at most about; and tiles, at least, so that small tables give many tasks, too.
TILE, TILES = 8192, 16
#: Rows of a tile that are multiplied at a time.
STRIP = 128
#: Room for the rounding of double sums and square roots, far above what they can lose.
ROUNDING = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scales, error lengths) of unit row vectors."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype("i1")
    error = np.sqrt(((unit - scale[:, None] * codes) ** 2).sum(axis=1)) + ROUNDING
    return codes, scale, error


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows over their length; scaled first, so that neither squares overflow nor vanish."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


class Codes(NamedTuple):
    """Quantised unit vectors: int8 codes, scales, error lengths."""

    q: np.ndarray
    scale: np.ndarray
    error: np.ndarray


def strips(a: Codes, b: Codes, threshold: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """For strips of ``a``: the slice, and masks over ``b`` of the pairs that surely link and of those in doubt."""
    exact = np.float32 if a.q.shape[1] <= (1 << 24) // (127 * 127) else np.float64  # sums stay below 2**24
    far = np.ascontiguousarray(b.q.T.astype(exact))
    for at in range(0, len(a.q), STRIP):
        part = slice(at, at + STRIP)
        rough = (a.q[part].astype(exact) @ far).astype("f8")
        rough *= a.scale[part, None]
        rough *= b.scale
        off = a.error[part, None] * (1 + b.error) + (b.error + ROUNDING)
        sure = rough - off >= threshold
        yield part, sure, (rough + off >= threshold) & ~sure


class Groups:
    """Groups of linked vectors by label, and the forest that links them."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def join(self, x: int, found: np.ndarray) -> None:
        """Links vector ``x`` with all of ``found``."""
        others = self.label[found]
        own = int(self.label[x])
        if (others == own).all():
            return
        new, first = np.unique(others, return_index=True)
        for g, i in zip(new.tolist(), first.tolist(), strict=True):
            if g != own:
                self.edges.append((x, int(found[i])))
        self.label[np.isin(self.label, new)] = own


class Met:
    """What the links between two tiles add up to; ``weight``: how many vectors each class stands for."""

    def __init__(self, weight: np.ndarray) -> None:
        self.weight = weight.astype("f8")
        self.links = np.zeros(len(weight))
        self.groups = Groups(len(weight))

    def add(self, own: np.ndarray, far: np.ndarray, mask: np.ndarray, both: bool) -> None:
        """Links of vectors ``own`` (rows) and ``far`` (columns); ``both``: also count them for the columns."""
        self.links[own] += mask @ self.weight[far]
        if both:
            self.links[far] += self.weight[own] @ mask
        for r in np.flatnonzero(mask.any(axis=1)).tolist():
            self.groups.join(int(own[r]), far[mask[r]])


def true_pairs(a: np.ndarray, b: np.ndarray, doubt: np.ndarray, threshold: float) -> np.ndarray:
    """Those pairs in doubt of rows of two arrays of unit vectors that reach the threshold in double precision."""
    i, j = np.nonzero(doubt)
    out = np.zeros(doubt.shape, dtype=bool)
    step = max(1, 4_000_000 // a.shape[1])
    for k in range(0, len(i), step):
        x, y = i[k : k + step], j[k : k + step]
        true = (a[x] * b[y]).sum(axis=1) >= threshold
        out[x[true], y[true]] = True
    return out


CODED = "tile int, key binary, n long, dim int, scale double, error double, q binary"
OUT = "key binary, links long, a binary, b binary, low int, high int"


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    stored = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    sound = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf)) & F.exists(vector, lambda x: x != 0)
    key = F.unhex(F.substring(F.sha2(F.to_json(F.struct("v")).cast("binary"), 256), 1, 32))
    rows = written(df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(sound, F.transform(vector, lambda x: x + F.lit(0.0))).alias("v")).withColumn("key", key), "vectors")
    classes = rows.where("v is not null").groupBy("key").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    n_classes = rows.where("v is not null").select("key").distinct().count()
    tiles = max(1, math.ceil(n_classes / tile), min(TILES, math.ceil(n_classes / 512)))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The codes of vectors; they and the vectors as bytes."""
        for b in sliced(batches, 2000):
            raw = [np.asarray(v, dtype=stored) for v in b["v"].to_pylist()]
            q, scale, error = [b""] * len(raw), np.empty(len(raw)), np.empty(len(raw))
            dims = np.array([len(v) for v in raw])
            for dim in np.unique(dims):
                of = np.flatnonzero(dims == dim)
                codes, scale[of], error[of] = quantised(unit_rows(np.stack([raw[i] for i in of]).astype("f8")))
                for i, c in zip(of.tolist(), codes, strict=True):
                    q[i] = c.tobytes()
            yield record(tile=b["tile"], key=b["key"], n=b["n"], dim=pa.array(dims, pa.int32()), scale=pa.array(scale), error=pa.array(error), q=pa.array(q, pa.binary()), v=pa.array([v.tobytes() for v in raw], pa.binary()))

    dealt = classes.withColumn("tile", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int")).select("tile", "key", "n", "v")
    coded = written(dealt.mapInArrow(code, CODED + ", v binary"), "vector_codes")
    # each tile meets every tile once, itself included: the pair (low, high) is the group
    met_at = coded.drop("v").withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")}).drop("other")

    def sides(group: pa.Table, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray, Codes, Codes]]:
        """For each length of vectors: the places and codes of both tiles."""
        side, dims, scale, error, q = (group[c].to_numpy() for c in ("tile", "dim", "scale", "error", "q"))
        for dim in np.unique(dims):
            places = [np.flatnonzero((side == t) & (dims == dim)) for t in (low, high)]
            if all(map(len, places)):
                yield *places, *(Codes(np.frombuffer(b"".join(q[p]), dtype="i1").reshape(-1, dim), scale[p], error[p]) for p in places)

    def result(low: int, high: int, keys: np.ndarray, met: Met, doubted: np.ndarray) -> pa.Table:
        at, more, edges = np.flatnonzero(met.links), np.flatnonzero(doubted), met.groups.edges
        n, e, d = len(at), len(edges), len(more)
        key = pa.array([*keys[at], *[None] * e, *keys[more]], pa.binary())
        a, b = (pa.array([*[None] * n, *(keys[x[i]] for x in edges), *[None] * d], pa.binary()) for i in (0, 1))
        links = pa.array([*met.links[at].astype("i8").tolist(), *[None] * (e + d)], pa.int64())
        where = [pa.array([*[None] * (n + e), *[t] * d], pa.int32()) for t in (low, high)]
        return pa.table({"key": key, "links": links, "a": a, "b": b, "low": where[0], "high": where[1]})

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        """By codes: sure links, and the vectors that have a pair in doubt."""
        low, high = key[0].as_py(), key[1].as_py()
        met, doubted = Met(group["n"].to_numpy()), np.zeros(group.num_rows, dtype=bool)
        for own, far, qa, qb in sides(group, low, high):
            for part, sure, doubt in strips(qa, qb, threshold):
                if low == high:  # a vector isn't its own partner
                    own_at = np.arange(part.start, part.start + len(sure))
                    sure[np.arange(len(sure)), own_at] = doubt[np.arange(len(sure)), own_at] = False
                met.add(own[part], far, sure, low != high)
                doubted[own[part]] |= doubt.any(axis=1)
                doubted[far] |= doubt.any(axis=0)
        return result(low, high, group["key"].to_numpy(), met, doubted)

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        """In full precision: the pairs in doubt."""
        low, high = key[0].as_py(), key[1].as_py()
        met, raw = Met(group["n"].to_numpy()), group["v"].to_numpy()
        for own, far, qa, qb in sides(group, low, high):
            unit = lambda at, dim=qa.q.shape[1]: unit_rows(np.frombuffer(b"".join(raw[at]), dtype=stored).reshape(-1, dim).astype("f8"))
            b = unit(far)
            for part, _, doubt in strips(qa, qb, threshold):
                if low == high:
                    own_at = np.arange(part.start, part.start + len(doubt))
                    doubt[np.arange(len(doubt)), own_at] = False
                met.add(own[part], far, true_pairs(unit(own[part]), b, doubt, threshold), low != high)
        return result(low, high, group["key"].to_numpy(), met, np.zeros(group.num_rows, dtype=bool))

    first = written(met_at.groupBy("low", "high").applyInArrow(meet, OUT), "met")
    doubted = first.where("low is not null").select("key", "low", "high").join(coded, "key")
    second = written(doubted.groupBy("low", "high").applyInArrow(settle, OUT), "settled")
    met = first.where("low is null").union(second)
    found = components(met.where("a is not null").select("a", "b"))
    totals = met.where("links is not null").groupBy("key").agg(F.sum("links").alias("links"))
    groups = classes.select("key", "node", "n").join(totals, "key", "left").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    names = groups.groupBy("component").agg(F.min("node").alias("component_id"))  # the least id of any member
    groups = groups.join(names, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    shown = lambda df: df.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
    # unsound vectors share a key, however many they are, so they are never joined
    alone = rows.where("v is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    return shown(rows.where("v is not null").select("id", "key").join(groups, "key", "left")).union(shown(alone))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: The same result from all pairs in SQL.
ORACLE = """
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0 THEN list_transform(embedding, lambda x: x::DOUBLE) END AS v FROM embeddings),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM v a JOIN v b ON a.r != b.r WHERE CASE WHEN len(a.v) = len(b.v) THEN list_cosine_similarity(a.v, b.v) >= 0.9 ELSE false END),
reach AS (SELECT r AS a, r AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a AS r, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = reach.b GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (r) LEFT JOIN n USING (r)"""
