"""Packing of documents and conversations into training rows.

These packers are sequential by definition: where a document goes depends on all before it. They see
lengths only, never tokens, and run once a group; a group is a shard or an epoch of bounded size.
Whoever wants one plan over a whole corpus makes it one group and pays for a single task.
"""

from __future__ import annotations

import heapq
import itertools
import json
import random
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Piece = tuple[int, int, int, int, int, bool, bool]  # row, slot, document, start, tokens, continues, ends the document


class OpenRows:
    """Rows by what is left in them: the tightest that holds a need, the earliest of equals."""

    def __init__(self) -> None:
        self.rows: dict[int, list[int]] = {}
        self.left: list[int] = []

    def add(self, left: int, row: int) -> None:
        if left:
            if left not in self.rows:
                self.rows[left] = []
                insort(self.left, left)
            heapq.heappush(self.rows[left], row)

    def take(self, need: int) -> tuple[int, int] | None:
        i = bisect_left(self.left, need)
        if i == len(self.left):
            return None
        left = self.left[i]
        row = heapq.heappop(self.rows[left])
        if not self.rows[left]:
            del self.rows[left]
            del self.left[i]
        return left, row


def best_fit(documents: Iterable[tuple[int, int]], length: int) -> Iterator[Piece]:
    """Plans rows of ``length`` + 1 places for ``(document, tokens)`` in order; a piece takes its tokens and one place more.

    A document's first piece goes to the tightest row with room, else to a new one; what follows always
    begins a new row, whose rest stays open to others. Empty documents take one place.
    """
    rows, open_, slots = 0, OpenRows(), {}
    for doc, tokens in documents:
        start = 0
        while True:
            n = min(tokens - start, length)
            found = open_.take(n + 1) if start == 0 else None
            if found is None:
                found, rows = (length + 1, rows), rows + 1
            left, row = found
            slot = slots.get(row, 0)
            slots[row] = slot + 1
            open_.add(left - n - 1, row)
            yield row, slot, doc, start, n, start > 0, start + n == tokens
            start += n
            if start >= tokens:
                break


PIECES = "row int, slot int, doc_id long, start int, n_tokens int, is_continuation boolean, is_end boolean"


def best_fit_rows(docs: DataFrame, length: int, group: str, order: str = "doc_id") -> DataFrame:
    """The plan of each group; ``docs``: the group, doc_id, n_tokens."""
    kind = dict(docs.dtypes)[group]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = pd.DataFrame(best_fit(zip(pdf["doc_id"].tolist(), pdf["n_tokens"].tolist(), strict=True), length), columns=["row", "slot", "doc_id", "start", "n_tokens", "is_continuation", "is_end"])
        out.insert(0, group, key[0])
        return out

    return docs.select(group, *dict.fromkeys(["doc_id", "n_tokens", order])).groupBy(group).applyInPandas(run, f"{group} {kind}, {PIECES}")


def materialised(plan: DataFrame, tokens: DataFrame, length: int, bos: int, group: str) -> DataFrame:
    """``inputs, targets, mask`` of each row; ``tokens``: the group, doc_id, ids.

    A piece begins with BOS, one that continues with the token before it. Content is supervised, and so
    is the first BOS after a document's end; the rest of a row is BOS.
    """
    ids = F.slice("ids", F.col("start") + 1, F.col("n_tokens"))
    first = F.when(F.col("is_continuation"), F.get("ids", F.col("start") - 1)).otherwise(F.lit(bos))
    # place i of a piece is supervised if it has a target: its tokens, and after the last the next BOS
    marks = F.concat(F.array_repeat(F.lit(True), F.col("n_tokens")), F.array(F.col("is_end")))
    parts = plan.join(tokens, [group, "doc_id"]).select(group, "row", "slot", F.concat(F.array(first), ids).alias("w"), marks.alias("m"))
    rows = parts.groupBy(group, "row").agg(F.array_sort(F.collect_list(F.struct("slot", "w", "m"))).alias("p"))
    flat = rows.select(group, "row", F.flatten(F.transform("p", lambda x: x["w"])).alias("w"), F.flatten(F.transform("p", lambda x: x["m"])).alias("m"))
    lack = F.lit(length + 1) - F.size("w")
    window = F.concat("w", F.array_repeat(F.lit(bos), lack))
    mask = F.slice(F.concat("m", F.array_repeat(F.lit(False), lack)), 1, length)
    return flat.select(group, "row", F.slice(window, 1, length).alias("inputs"), F.slice(window, 2, length).alias("targets"), mask.alias("mask"))


def padded_rows(rows: DataFrame, batch: int, length: int, bos: int, group: str) -> DataFrame:
    """Rows of a group filled up to whole batches with empty rows."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    lack = F.pmod(-F.col("n"), F.lit(batch))
    extra = counts.where(lack > 0).select(group, F.explode(F.sequence(F.col("n").cast("int"), (F.col("n") + lack - 1).cast("int"))).alias("row"))
    fill = F.array_repeat(F.lit(bos), length)
    return rows.unionByName(extra.select(group, "row", fill.alias("inputs"), fill.alias("targets"), F.array_repeat(F.lit(False), length).alias("mask")))


def epoch_order(docs: DataFrame, seed: int, epoch: int, key: str = "doc_id") -> DataFrame:
    """Adds ``epoch_rank``, a seeded order that any engine can repeat: by the SHA-256 of seed, epoch and id."""
    return docs.withColumn("epoch_rank", F.sha2(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(key).cast("string")), 256))


def buffered(batches: Iterable[list[tuple[int, Sequence[int]]]], rows: int | None, length: int, bos: int, least: int) -> Iterator[tuple[list[int], list[tuple[int, int]]]]:
    """Destructive packing: rows of ``length`` + 1 ids and, of each, the (document, prefix) it kept.

    A buffer of at least ``least`` documents is refilled in batches from the source. A row takes the
    first largest document that fits with its BOS; if none does, the first shortest one, whose tail is lost.
    Where the source ends, the buffer runs empty and the last row is filled up with BOS; ``rows`` None
    goes on until then.
    """
    buffer: list[tuple[int, Sequence[int]]] = []
    source = iter(batches)
    for _ in itertools.count() if rows is None else range(rows):
        row: list[int] = []
        kept: list[tuple[int, int]] = []
        while len(row) < length + 1:
            while len(buffer) < least and (more := next(source, None)) is not None:
                buffer += more
            if not buffer:
                break
            room = length + 1 - len(row)
            sizes = [len(ids) + 1 for _, ids in buffer]
            fitting = [n for n in sizes if n <= room]
            doc, ids = buffer.pop(sizes.index(max(fitting) if fitting else min(sizes)))
            taken = [bos, *ids[: room - 1]]
            row += taken
            kept.append((doc, len(taken) - 1))
        if not kept:
            return
        yield row + [bos] * (length + 1 - len(row)), kept


def mixture_order(sizes: list[tuple[str, int, int]], seed: int, epoch: int) -> list[str]:
    """Source names of an epoch: each as often as its size times its repeats, shuffled by a seed of the epoch."""
    names = [name for name, size, repeats in sizes for _ in range(size * repeats)]
    random.Random(f"{seed}:{epoch}").shuffle(names)
    return names


def mixture(conversations: DataFrame, repeats: dict[str, int], seed: int, epoch: int, source: str = "source", key: str = "conv_id") -> DataFrame:
    """Conversations of an epoch with their order: each source repeated, every cycle in an order of its own."""
    times = F.coalesce(F.element_at(F.create_map(*[x for k, v in sorted(repeats.items()) for x in (F.lit(k), F.lit(v))]), F.col(source)), F.lit(0))
    cycles = conversations.withColumn("cycle", F.explode(F.when(times > 0, F.sequence(F.lit(1), times))))
    return cycles.withColumn("order_key", F.sha2(F.concat_ws(":", F.lit(f"{seed}:{epoch}"), F.col(source), F.col("cycle").cast("string"), F.col(key).cast("string")), 256))


class ConversationPacker:
    """Packs whole conversations into rows of ``length`` + 1 places, one after another as they come.

    A row takes the largest buffered conversation that fits, the first of equals, until none does. It picks only while at least
    ``least`` are buffered, or no more will come. ``state()`` is a JSON text from which ``resumed`` goes on.
    """

    def __init__(self, length: int, least: int) -> None:
        self.length, self.least = length, least
        self.buffer: list[tuple[int, int]] = []
        self.row, self.slot, self.left, self.taken, self.ended = 0, 0, length + 1, 0, False

    def feed(self, conv: int, tokens: int, last: bool = False) -> Iterator[tuple[int, int, int, int]]:
        """Takes one conversation and gives the (row, slot, conversation, tokens) that are decided by now."""
        if self.ended:
            raise ValueError("nothing may follow the last conversation")
        self.taken += 1
        self.buffer.append((conv, min(tokens, self.length + 1)))
        self.ended = last
        return self._decided()

    def end(self) -> Iterator[tuple[int, int, int, int]]:
        self.ended = True
        return self._decided()

    def _decided(self) -> Iterator[tuple[int, int, int, int]]:
        while self.buffer and (self.ended or len(self.buffer) >= self.least):
            fitting = [n for _, n in self.buffer if n <= self.left]
            if not fitting:
                self.row, self.slot, self.left = self.row + 1, 0, self.length + 1
                continue
            most = max(fitting)
            conv, n = self.buffer.pop(next(i for i, (_, n) in enumerate(self.buffer) if n == most))
            yield self.row, self.slot, conv, n
            self.slot, self.left = self.slot + 1, self.left - n

    def state(self) -> str:
        return json.dumps(vars(self), sort_keys=True)

    @classmethod
    def resumed(cls, state: str) -> ConversationPacker:
        known = json.loads(state)
        out = cls(known["length"], known["least"])
        if known.keys() != vars(out).keys():
            raise ValueError("the state has other fields")
        vars(out).update(known, buffer=[tuple(x) for x in known["buffer"]])
        if not 0 <= out.left <= out.length + 1 or len(out.buffer) > max(out.least, 1) or out.taken < len(out.buffer) or (out.ended and out.buffer):
            raise ValueError("the state's buffer doesn't fit its cursor")
        return out


def conversation_rows(items: Iterable[tuple[int, int]], length: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(row, slot, conversation, tokens) of all conversations."""
    packer = ConversationPacker(length, least)
    for conv, tokens in items:
        yield from packer.feed(conv, tokens)
    yield from packer.end()


def packed_conversations(convs: DataFrame, length: int, least: int, group: str, order: str) -> DataFrame:
    """Rows of whole conversations, cropped to ``length`` + 1 and with something supervised; ``convs``: group, order, conv_id, tokens, supervised."""
    kind = dict(convs.dtypes)[group]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, "conv_id"])
        out = pd.DataFrame(conversation_rows(zip(pdf["conv_id"].tolist(), pdf["tokens"].tolist(), strict=True), length, least), columns=["row", "slot", "conv_id", "n_tokens"])
        out.insert(0, group, key[0])
        return out

    own = convs.where("supervised > 0").select(*dict.fromkeys([group, order, "conv_id", "tokens"]))
    return own.groupBy(group).applyInPandas(run, f"{group} {kind}, row int, slot int, conv_id long, n_tokens int")


def labels(ids: str, mask: str, ignored: int = -1) -> Column:
    """Next-token labels of a row; unsupervised ones are ignored."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    return F.zip_with(F.slice(ids, 2, n), F.slice(mask, 2, n), lambda t, m: F.when(m, t).otherwise(ignored))
