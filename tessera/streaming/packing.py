"""Conversation packing as a stream: the buffer and the cursor are state, so a restart goes on where it stopped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.row_packing import ConversationPacker

SCHEMA = "split string, row long, slot long, conv_id long, n_tokens long"


class Packing(StatefulProcessor):
    """Rows of a split; input: split, position (from 0, without gaps), conv_id, tokens, and last (true for the last of an epoch).

    Positions that were met before are left out, so replayed input adds nothing; a gap stops the query.
    """

    def __init__(self, length: int, least: int) -> None:
        self.length, self.least = length, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("packer", "state string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        packer = ConversationPacker.resumed(self.kept.get()[0]) if self.kept.exists() else ConversationPacker(self.length, self.least)
        if (packer.length, packer.least) != (self.length, self.least):
            raise ValueError("the state was kept by a packer with other settings")
        out = []
        for position, conv, tokens, last in sorted(x for b in rows for x in zip(b["position"], b["conv_id"], b["tokens"], b["last"], strict=True)):
            if position < packer.taken:
                continue
            if position > packer.taken:
                raise ValueError(f"position {packer.taken} of {key[0]} is missing")
            out += packer.feed(int(conv), int(tokens), bool(last))
        self.kept.update((packer.state(),))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["split", "row", "slot", "conv_id", "n_tokens"])

    def close(self) -> None:
        pass


def packed(conversations: DataFrame, length: int, least: int) -> DataFrame:
    """What ``row_packing.conversation_rows`` gives for each split's conversations, as they come."""
    own = conversations.select("split", "position", "conv_id", "tokens", "last")
    return own.groupBy("split").transformWithStateInPandas(Packing(length, least), SCHEMA, "Append", "None")


