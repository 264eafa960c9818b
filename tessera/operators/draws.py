"""Seeded draws: few-shot partners, cases of benchmark tasks, and shuffles through a bounded buffer.

Partners are drawn as places in their task's order, each looked up by one join, so that no example meets all others.
Two generators are offered: hashes, which any engine can repeat, and the standard library's, for results
that other tools have drawn with it.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The seeds of the published task order and of its few-shot examples (fixed values).
TASK_SEED, CASE_SEED = 1337, 1234
#: Rows that a worker gives at a time.
ROWS = 10_000


def hashed(*parts: Column) -> Column:
    """60 bits of a SHA-256, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def few_shot(examples: DataFrame, k: int, seed: int, group: str = "task", key: str = "example") -> DataFrame:
    """``k`` other examples for each (fewer in smaller tasks), distinct, in the order drawn: group, key, shot, rank.

    A task's examples stand in a ring, ordered by hash; an example's partners are ``k`` distinct steps along it, drawn
    by hashes one after another: the j-th is one of ``others - k + j`` steps, and the largest of these where it was drawn before.
    """
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"), 256)
    ring = examples.select(group, key).withColumn("_at", (F.row_number().over(W.partitionBy(group).orderBy(order, key)) - 1).cast("long"))
    ring = ring.join(ring.groupBy(group).agg(F.count(F.lit(1)).alias("_n")), group)
    some = F.least(F.col("_n") - 1, F.lit(k))

    def drawn(steps: Column, j: Column) -> Column:
        most = F.col("_n") - 1 - some + j
        step = F.pmod(hashed(F.lit(seed), F.col(key), j), most) + 1
        return F.concat(steps, F.array(F.when(F.array_contains(steps, step), most).otherwise(step)))

    steps = F.when(some > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), some.cast("long")), F.array().cast("array<long>"), drawn))
    asked = ring.select(group, key, "_at", "_n", F.posexplode(steps).alias("_j", "_step"))
    asked = asked.select(group, key, (F.col("_j") + 1).alias("rank"), F.pmod(F.col("_at") + F.col("_step"), F.col("_n")).alias("_at"))
    return asked.join(ring.select(group, F.col(key).alias("shot"), "_at"), [group, "_at"]).select(group, key, "shot", "rank")


def task_cases(n: int, k: int, most: int | None = None) -> Iterator[tuple[int, int, list[int]]]:
    """(place, example, few-shot examples) of a task of ``n`` examples, as the standard library's generator draws them.

    Examples are shuffled once a task; each place draws its few-shot examples from all other places by a
    generator of its own.
    """
    pool = list(range(n))
    random.Random(TASK_SEED).shuffle(pool)
    pool = pool if most is None else pool[:most]
    if len(pool) <= k:
        raise ValueError(f"{k} few-shot examples need a pool of {k + 1}, there are {len(pool)}")
    for place, example in enumerate(pool):
        drawn = random.Random(CASE_SEED + place).sample(range(len(pool) - 1), k)  # places, its own left out
        yield place, example, [pool[i + (i >= place)] for i in drawn]


def cases(examples: DataFrame, k: int, most: int | None = None, group: str = "task", order: str = "example") -> DataFrame:
    """``group, place, example, shots`` of tasks; ``order`` numbers a task's examples from 0. A task with too few raises when read.

    Only numbers of examples are drawn from, a task a row; what belongs to them is joined by the caller.
    """
    kind = dict(examples.dtypes)[group]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task, n in zip(b[group].to_pylist(), b["n"].to_pylist(), strict=True):
                found = task_cases(n, k, most)
                while part := [x for x, _ in zip(found, range(ROWS), strict=False)]:
                    place, example, shots = zip(*part, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([task] * len(part), b.schema.field(group).type), pa.array(place, pa.int64()), pa.array(example, pa.int64()), pa.array(shots, pa.list_(pa.int64()))], [group, "place", "example", "shots"])

    counts = examples.groupBy(group).agg((F.max(order) + 1).cast("long").alias("n"))
    return counts.mapInArrow(run, f"`{group}` {kind}, place long, example long, shots array<long>")


class BufferedShuffle:
    """The order of ``n`` rows through a buffer of ``size``: each row that comes in replaces a random one, which goes out; the rest is shuffled at the end.

    Holds the buffer's row numbers only. ``state()`` is a JSON text from which ``resumed`` goes on.
    """

    def __init__(self, n: int, size: int, seed: int) -> None:
        self.n, self.size, self.given = n, size, 0
        self.rng, self.buffer = random.Random(seed), list(range(min(n, size)))
        self.next_row, self.draining = len(self.buffer), False

    def __iter__(self) -> BufferedShuffle:
        return self

    def __next__(self) -> int:
        if not self.buffer:
            raise StopIteration
        self.given += 1
        if self.next_row < self.n:
            at = self.rng.randrange(len(self.buffer))
            out, self.buffer[at] = self.buffer[at], self.next_row
            self.next_row += 1
            return out
        if not self.draining:
            self.rng.shuffle(self.buffer)
            self.buffer.reverse()  # so that rows are taken from the end
            self.draining = True
        return self.buffer.pop()

    def state(self) -> str:
        version, words, gauss = self.rng.getstate()
        return json.dumps({"n": self.n, "size": self.size, "given": self.given, "next_row": self.next_row, "draining": self.draining, "buffer": self.buffer, "rng": [version, words, gauss]}, sort_keys=True)

    @classmethod
    def resumed(cls, state: str) -> BufferedShuffle:
        known = json.loads(state)
        out = cls(known["n"], known["size"], 0)
        version, words, gauss = known["rng"]
        out.rng.setstate((version, tuple(words), gauss))
        out.given, out.next_row, out.draining, out.buffer = known["given"], known["next_row"], known["draining"], known["buffer"]
        if len(out.buffer) != min(out.n, out.size, out.n - out.given) or any(not 0 <= i < out.next_row for i in out.buffer) or len(set(out.buffer)) != len(out.buffer):
            raise ValueError("the state's buffer doesn't fit its cursor")
        return out


def buffered_order(shards: DataFrame, size: int, seed: int, group: str = "shard_index", most: int | None = None) -> DataFrame:
    """``group, position, row_index`` for each row of a shard, through a buffer; ``shards``: group, n_rows and, to go on from, state (null: from the start).

    With ``most``, a shard gives so many rows, and then one with null ``row_index`` and the ``state`` to go on from.
    A shard's order is drawn in one task, which holds the buffer and ROWS row numbers.
    """
    kind = dict(shards.dtypes)[group]
    schema = f"`{group}` {kind}, position long, row_index long, state string"
    own = shards if "state" in shards.columns else shards.withColumn("state", F.lit(None).cast("string"))

    def rows(key: object, kind_: pa.DataType, first: int, part: list[int | None], state: str | None = None) -> pa.RecordBatch:
        n = len(part)
        return pa.RecordBatch.from_arrays([pa.array([key] * n, kind_), pa.array(range(first, first + n), pa.int64()), pa.array(part, pa.int64()), pa.array([state] * n, pa.string())], [group, "position", "row_index", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, n, state in zip(b[group].to_pylist(), b["n_rows"].to_pylist(), b["state"].to_pylist(), strict=True):
                order = BufferedShuffle(n, size, seed) if state is None else BufferedShuffle.resumed(state)
                end = n if most is None else min(n, order.given + most)
                while order.given < end:
                    first = order.given
                    part = [next(order) for _ in range(min(ROWS, end - first))]
                    yield rows(key, b.schema.field(group).type, first, part)
                if most is not None:
                    yield rows(key, b.schema.field(group).type, order.given, [None], order.state())

    return own.select(group, F.col("n_rows").cast("long").alias("n_rows"), "state").mapInArrow(run, schema)
