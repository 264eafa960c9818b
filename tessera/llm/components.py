"""Connected components of a graph that no one machine holds.

Large-star and small-star steps in turn: each node's neighbours are hung on the least of them,
first the larger ones, then the smaller ones, until nothing changes. A step is an aggregate and a
join on keys; minima are pre-aggregated before the shuffle, and skewed joins are split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x != y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` for the nodes of ``edges`` (columns a, b): the least node reachable.

    Null ends and loops are left out. Nodes without an edge don't appear: they are their own.
    """
    kind = edges.schema["a"].dataType
    now = written(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "stars")
        # stars: each node hangs on one other, and what others hang on hangs on nothing
        twice = now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        if now.select(F.col("b").alias("a")).join(now.select("a"), "a", "left_semi").union(twice).isEmpty():
            return _listed(now, kind)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def roots(parents: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, component`` of a forest in which each node of column b hangs on one lesser node in column a: pointers jump to pointers' pointers."""
    kind = parents.schema["a"].dataType
    now = written(parents.select(F.col("b").alias("a"), F.col("a").alias("b")), "stars")
    for _ in range(most_rounds):
        above = now.select(F.col("a").alias("b"), F.col("b").alias("up"))
        if above.join(now.select("b"), "b", "left_semi").isEmpty():
            return _listed(now, kind)
        now = written(now.join(above, "b", "left").select("a", F.coalesce("up", "b").alias("b")), "stars")
    raise RuntimeError(f"roots were not reached in {most_rounds} rounds")


def _listed(stars: DataFrame, kind: DataType) -> DataFrame:
    """All nodes of stars with their centres."""
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(centres).select(F.col("node").cast(kind), F.col("component").cast(kind))
