"""Tokenizers as plug-ins, a byte tokenizer, a BPE tokenizer with its artifacts, and parts-aware chat rendering."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators import bpe
from ..operators.bpb import SPECIALS
from .identity import identity


class Tokenizer(ABC):
    """What a tokenizer must have to be used on DataFrames; it is pickled to the workers."""

    @abstractmethod
    def encode(self, text: str) -> list[int]: ...

    @abstractmethod
    def decode(self, ids: list[int]) -> str: ...

    @property
    @abstractmethod
    def vocab_size(self) -> int:
        """Ids of ordinary tokens; control tokens follow."""

    def special(self, name: str) -> int:
        return self.vocab_size + SPECIALS.index(name)

    def encoded(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """``key, ids`` in Arrow batches."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({key: b[key], "ids": [self.encode(t) for t in b[text]]})

        return docs.select(key, text).mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, ids array<int>")


class ByteTokenizer(Tokenizer):
    vocab_size = 256

    def encode(self, text: str) -> list[int]:
        return list(text.encode())

    def decode(self, ids: list[int]) -> str:
        """Control tokens appear as their names; broken bytes as replacement characters."""
        parts = [bytes([i]) if i < 256 else SPECIALS[i - 256].encode() for i in ids]
        return b"".join(parts).decode("utf-8", errors="replace")


class BPETokenizer(Tokenizer):
    """Regex chunks and ranked merges."""

    def __init__(self, merges: list[bpe.Merge]) -> None:
        self.merges = merges
        self.ranks = {(m.left, m.right): (m.rank, m.token) for m in merges}
        self.vocab = bpe.vocabulary(merges)

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def encode(self, text: str) -> list[int]:
        import regex

        from .text import SPLIT_PATTERN

        return [i for chunk in regex.findall(SPLIT_PATTERN, text) for i in bpe.encode(chunk.encode(), self.ranks)]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(self.vocab[i] if i in self.vocab else SPECIALS[i - self.vocab_size].encode() for i in ids)
        return raw.decode("utf-8", errors="replace")

    def encoded(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        return bpe.encoded(docs, self.merges, key, text)

    @property
    def identity(self) -> str:
        """Of merges, vocabulary and control tokens; counts don't matter."""
        return identity({"merges": [[m.left, m.right, m.token] for m in self.merges], "special": list(SPECIALS), "vocab": [self.vocab[i].hex() for i in range(self.vocab_size)]})

    def save(self, directory: str) -> None:
        """Two views of the same and the identity, for ``load`` to hold against each other."""
        os.makedirs(directory, exist_ok=True)
        views = {"merges.json": [[m.rank, m.left, m.right, m.token, m.count] for m in self.merges], "vocab.json": {str(i): b.hex() for i, b in self.vocab.items()}, "identity.json": self.identity}
        for name, value in views.items():
            with open(os.path.join(directory, name), "w") as f:
                json.dump(value, f, sort_keys=True)

    @classmethod
    def load(cls, directory: str) -> BPETokenizer:
        def read(name: str):
            with open(os.path.join(directory, name)) as f:
                return json.load(f)

        out = cls([bpe.Merge(*m) for m in read("merges.json")])
        if {str(i): b.hex() for i, b in out.vocab.items()} != read("vocab.json") or out.identity != read("identity.json"):
            raise ValueError("the views of the tokenizer don't agree")
        return out


def rendered(messages: list[dict], tokenizer: Tokenizer) -> tuple[list[int], list[bool]]:
    """Ids and supervision of a checked conversation with parts (see ``sources.jsonl``).

    Assistants' text and Python calls, their delimiters included, and the end of an answer are supervised;
    what a call put out isn't. A leading system text goes before the first user's.
    """
    system = [m for m in messages[:1] if m["role"] == "system"]
    lead = "".join(p["text"] for m in system for p in m["parts"])
    ids, mask = [tokenizer.special("<|bos|>")], [False]

    def put(new: list[int], learned: bool) -> None:
        ids.extend(new)
        mask.extend([learned] * len(new))

    for k, m in enumerate(messages[len(system) :]):
        user = m["role"] == "user"
        role = "user" if user else "assistant"
        put([tokenizer.special(f"<|{role}_start|>")], False)
        for p in m["parts"]:
            text = f"{lead}\n\n{p['text']}" if system and k == 0 else p["text"]
            around = {"python": "python", "python_output": "output"}.get(p["type"])
            learned = not user and p["type"] != "python_output"
            own = tokenizer.encode(text)
            put([tokenizer.special(f"<|{around}_start|>"), *own, tokenizer.special(f"<|{around}_end|>")] if around else own, learned)
        put([tokenizer.special(f"<|{role}_end|>")], not user)
    return ids, mask
