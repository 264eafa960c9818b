"""Exact tokenizer encoding through a cache of chunks that white space delimits.

Every pre-tokenizer used here starts a new pre-token at a space or a line feed that stands
between characters that aren't white space. So the ids of a text are the ids of its chunks
(``"w0"``, ``" w1"``, ``"\\nw2"``, …) one after another, as long as no two white-space characters meet and
none is first or last; other texts are encoded whole. Arrow splits a group of texts and finds
its distinct chunks; only these are looked up, and only unknown ones are encoded. The cache holds
arrays: hashes of 128 bits, and the ids. It starts anew when it is full and with each task; what it drops changes no result.

This holds for two kinds of tokenizer files, which ``kind_of`` tells by their settings. Texts of
any other file, and texts in which an added token is spelled, are given to the library whole.
"""

from __future__ import annotations

import functools
import gc
import json
import os
import re
import sys
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A run of letters that Unicode tables of any version agree on, and what follows it, of ASCII.
WORD = r"\A(?P<before>\n?)(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<after>[\x21-\x7E]*)\z"
#: Chunks that the cache holds, some 40 bytes each.
LIMIT = 500_000


def even(text: str) -> bool:
    """Whether white space stands alone and neither first nor last."""
    words = text.split()
    return sum(map(len, words)) + len(words) - 1 == len(text) if words else not text


def flat(ids: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each has, and the ids of all."""
    return np.fromiter((len(x) // 4 for x in ids), dtype="i8", count=len(ids)), np.frombuffer(b"".join(ids), dtype="<u4")


def strung(at: np.ndarray, first: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers ``at`` of runs of ids that lie in ``ids``, strung together: where each ends, and all their ids."""
    each = size[at]
    after = np.cumsum(each)
    return after, ids[np.repeat(first[at] - (after - each), each) + np.arange(after[-1] if len(after) else 0)]


class ChunkCache:
    """``encode(texts)`` yields the little-endian uint32 ids of each text as bytes.

    ``whole(strings)`` encodes complete strings. ``glued(chunks)`` encodes an array of chunks as they stand inside a
    text: one that begins with a line feed as it is, any other after a space; it gives their ids as ``flat`` does.
    Without it, all texts are encoded whole. ``blank_free``: the tokenizer drops white space, so a first chunk is like any
    other and nothing else matters. ``apart``: texts in which this is found are encoded whole.
    """

    def __init__(self, whole: Callable[[Sequence[str]], list[bytes]], glued: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] | None, blank_free: bool = False, apart: re.Pattern | None = None, limit: int = LIMIT):
        self.whole, self.glued, self.blank_free, self.apart, self.limit = whole, glued, blank_free, apart, limit
        self.forget()

    def forget(self) -> None:
        self.keys, self.checks = np.empty(0, "u8"), np.empty(0, "u8")  # sorted by key
        self.first, self.size, self.ids = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "<u4")

    def __enter__(self) -> ChunkCache:
        return self

    def __exit__(self, *_: object) -> None:
        """A task has ended: its worker keeps the tokenizer, but no chunks."""
        self.forget()

    def encode(self, texts: Sequence[str], group_chars: int = 1_000_000) -> Iterator[bytes]:
        group: list[str] = []
        size = 0
        for text in texts:
            if self.apart and self.apart.search(text):
                if group:
                    yield from self._group(group)
                    group, size = [], 0
                yield from self.whole([text])
                continue
            group.append(text)
            size += len(text)
            if size > group_chars:
                yield from self._group(group)
                group, size = [], 0
        if group:
            yield from self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if self.glued is None:
            return self.whole(texts)
        if self.blank_free:
            return self._joined(texts)
        cuts = [m.start() if even(t) and (m := re.search("[ \n]", t)) else len(t) for t in texts]
        heads = self.whole([t[:k] for t, k in zip(texts, cuts, strict=True)])
        # without its head a text begins with a space or a line feed; the space is no part of a chunk
        tails = [t[k + (t[k] == " ") :] if k < len(t) else "" for t, k in zip(texts, cuts, strict=True)]
        return [h + r if t else h for h, r, t in zip(heads, self._joined(tails), tails, strict=True)]

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts whose every chunk follows a space or begins with a line feed."""
        rows = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        ends = rows.offsets.to_numpy()
        # a line feed that is first leaves an empty chunk before it
        found = rows.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        after, ids = strung(found.indices.to_numpy(), *self._looked_up(found.dictionary))
        bounds = np.append(0, after)[ends - ends[0]].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]

    def _looked_up(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The place and number of each distinct chunk's ids, and the ids."""
        keys, checks = hashes(chunks)
        at = np.searchsorted(self.keys, keys)
        there = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        there[inside] = (self.keys[at[inside]] == keys[inside]) & (self.checks[at[inside]] == checks[inside])
        first, size = np.zeros(len(keys), "i8"), np.zeros(len(keys), "i8")
        first[there], size[there] = self.first[at[there]], self.size[at[there]]
        lacking = np.flatnonzero(~there & (pc.binary_length(chunks).to_numpy() > 0))
        size[lacking], new = self.glued(chunks.take(pa.array(lacking)))
        first[lacking] = len(self.ids) + np.cumsum(size[lacking]) - size[lacking]
        ids = np.concatenate([self.ids, new])
        if len(self.keys) + len(lacking) > self.limit:
            self.forget()
        else:
            of = np.append(self.keys, keys[lacking])
            order = np.argsort(of, kind="stable")
            self.keys, self.checks, self.ids = of[order], np.append(self.checks, checks[lacking])[order], ids
            self.first, self.size = np.append(self.first, first[lacking])[order], np.append(self.size, size[lacking])[order]
        return first, size, ids


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) ^ (x >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _factors(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Two odd random factors for each place in a chunk of up to ``most`` bytes; those of a place don't depend on ``most``."""
    place = np.arange(1, 2 * most + 1, dtype="u8") * np.uint64(0x9E3779B97F4A7C15)
    both = _mixed(place) | np.uint64(1)
    return both[::2], both[1::2]


def hashes(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each string: sums of bytes times factors of their places."""
    ends = pc.binary_length(chunks).to_numpy().astype("i8").cumsum()
    begins = np.append(0, ends[:-1]) if len(ends) else ends
    size = ends - begins
    raw = chunks.buffers()[2]
    if raw is None or not len(ends) or not ends[-1]:
        return np.zeros(len(ends), "u8"), np.zeros(len(ends), "u8")
    offsets = np.frombuffer(chunks.buffers()[1], dtype="i8" if pa.types.is_large_string(chunks.type) else "i4", count=1, offset=(8 if pa.types.is_large_string(chunks.type) else 4) * chunks.offset)
    data = np.frombuffer(raw, dtype="u1", count=int(ends[-1]), offset=int(offsets[0])).astype("u8") + np.uint64(1)
    place = np.arange(len(data)) - np.repeat(begins, size)
    out = []
    for factors in _factors(1 << int(size.max()).bit_length()):
        sums = np.append(np.zeros(1, "u8"), np.cumsum(data * factors[place]))
        out.append(_mixed(sums[ends] - sums[begins] + size.astype("u8") * factors[0]))
    return out[0], out[1]


def packed(ids: Sequence[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


def byte_characters() -> dict[int, int]:
    """The public byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 0x100 + i for i, b in enumerate(other)}


def kind_of(spec: dict) -> str | None:
    """"bytes" for byte-level BPE with its own pattern, "words" for BPE of lower-case words without white space; None for all else."""
    model, normal, pre = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if not plain or any(t["normalized"] for t in spec.get("added_tokens") or ()):
        return None
    if not normal and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre.get("use_regex", True) and not model.get("end_of_word_suffix"):
        return "bytes"
    steps = [n.get("type") for n in (normal or {}).get("normalizers", ())]
    split, *rest = pre.get("pretokenizers") or [{}]
    dropped = split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and split["pattern"].get("Regex") == WORDS
    after = [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest]
    if steps == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"} and normal["normalizers"][1]["content"] == " " and dropped and after == [("ByteLevel", False, False)]:
        return "words"
    return None


#: The pattern of word tokenizers whose chunks stand alone (a fixed value).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def spec_of(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def width_of(path: str) -> int:
    """Bytes that each id of a tokenizer file takes: 2 or 4."""
    spec = spec_of(path)
    top = max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens") or ())], default=0) if isinstance(spec["model"]["vocab"], dict) else 1 << 16
    return 2 if top < 1 << 16 else 4


@functools.lru_cache(maxsize=4)
def library_cache(path: str, special_as_text: bool = False) -> ChunkCache:
    """A cache over a ``tokenizers`` file; one a worker process. ``special_as_text``: added tokens that a text spells are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t, spec = Tokenizer.from_file(path), spec_of(path)
    t.encode_special_tokens = special_as_text
    kind = kind_of(spec)
    names = [re.escape(x["content"]) for x in spec.get("added_tokens") or () if not (special_as_text and x["special"])]
    apart = re.compile("|".join(names)) if names else None
    blank_free = kind == "words"
    merge, letters = t.model.tokenize, byte_characters()
    space = "" if blank_free else chr(letters[0x20])

    def whole(texts: Sequence[str]) -> list[bytes]:
        return [packed(x.ids) for x in t.encode_batch_fast(list(texts), add_special_tokens=False)]

    def run_of_letters(word: str) -> list[int]:
        """A run of letters is one pre-token, so it goes straight to the library's merges. One behind a line feed has no space."""
        first, word = ("", word[1:]) if word[0] == "\n" else (space, word)
        return [x.id for x in merge(first + (word if word.isascii() else word.encode().decode("latin-1").translate(letters)))]

    def glued(chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A chunk is a line feed or nothing, a word, and what follows it. Of each, only distinct ones are encoded; chunks of other forms are encoded whole."""
        found = pc.extract_regex(chunks, WORD)
        plain = found.is_valid()
        before, word, after = found.filter(plain).flatten()
        words = (pc.utf8_lower(word) if blank_free else pc.binary_join_element_wise(before, word, pa.scalar("", word.type))).dictionary_encode()
        after = after.dictionary_encode()
        other = [c if blank_free or c[0] == "\n" else " " + c for c in chunks.filter(pc.invert(plain)).to_pylist()]
        n, ids = flat(whole(["", "\n", *after.dictionary.to_pylist(), *other]))
        runs, size = array("I"), [0]
        for own in map(run_of_letters, words.dictionary.to_pylist()):
            runs.extend(own)
            size.append(len(runs))
        size, ids = np.append(n, np.diff(size)), np.append(ids, np.array(runs, dtype="<u4"))
        parts, plain = np.zeros((len(chunks), 3), "i8"), plain.to_numpy(zero_copy_only=False)
        parts[plain, 0] = pc.binary_length(before).to_numpy()
        parts[plain, 1] = len(n) + words.indices.to_numpy()
        parts[plain, 2] = 2 + after.indices.to_numpy()
        parts[~plain, 0] = np.arange(len(n) - len(other), len(n))
        ends, ids = strung(parts.ravel(), np.cumsum(size) - size, size, ids)
        return np.diff(ends[2::3], prepend=0), ids

    return ChunkCache(whole, glued if kind else None, blank_free, apart)


def released() -> None:
    """Gives back what this worker keeps for tokenizers; for tasks that need the memory and no tokenizer."""
    if library_cache.cache_info().currsize:
        library_cache.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
