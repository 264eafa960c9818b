"""Secret scan in DataFrame functions only: patterns, and windows of high Shannon entropy.

Pattern spans are found with Java's matcher; their places follow from the lengths of what
``split`` leaves between matches, as both use the same leftmost, non-overlapping search. Lengths
are added up in blocks, so many matches in a text cost little more than their number.

Access keys, hex and entropy candidates all lie in long runs of one class of characters. These runs
are found once, and the finer patterns are looked for in the runs alone. A window slides
over a candidate, and the sum of c*log2(c) over its character counts is updated for the character
that enters and the one that leaves, so the work is linear in the run. A candidate is
reported when some window reaches the entropy of its class and no allow-list rule matches; a run of several
words, as in paths and slugs, must also have enough characters in parts that aren't words or numbers.

Lambdas are evaluated for each element, and so is every expression in them that isn't a variable;
``bound`` gives an expression a name, so that it is evaluated once a row.

Defined results: null text is empty and has no spans; ids, ties and repeated rows need no care,
as rows are independent; a text may be of any length; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: For runs of one class, a least length in the pattern finds what dropping short matches would leave.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
LEAST_VALUE = 6
#: Each match of ASSIGN has one of these in lower case.
WORDS = ("password", "passwd", "secret", "token", "api")
#: All characters of candidates, and runs of them; what is looked for in a run has no other character and is at least as long.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LONG = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"


@dataclass(frozen=True)
class CharClass:
    """A kind of candidate: its pattern within a long run (None: the whole run), the window, and the least entropy in bits a character."""

    kind: str
    pattern: str | None
    window: int
    entropy: float


#: Next to a hex run, "=", "/", "-", "_" and "+" end a name, as in HMAC_KEY=9F86...
CLASSES = (CharClass("entropy_hex", r"(?<![A-Za-z0-9])[0-9a-fA-F]{20,}(?![A-Za-z0-9])", 20, 2.9), CharClass("entropy_base64", None, 20, 3.9))
#: Never secrets: words without digits, numbers, UUIDs, runs of one character, and marked examples. Hex runs are left to their own class.
ALLOWED = {
    "entropy_hex": (r"^[0-9]+$", r"^[A-Fa-f]+$", r"^(.)\1+$"),
    "entropy_base64": (r"^[A-Za-z_=/+-]+$", r"^[0-9_=/+-]+$", r"^[0-9a-fA-F]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|placeholder|changeme|xxxx"),
}
#: Parts of a run that people write: words, also joined by capitals, with a number behind; ordinals; numbers; times; hex digits, which have a class of their own.
PLAIN = r"^(?:(?:[A-Z]?[a-z]++(?:[A-Z][a-z]++)*+|[A-Z]++)?+[0-9]*+[a-z]{0,3}|(?:[A-Z]?[a-z]{2,}+[0-9]{0,4}+)++|[0-9]{8}T[0-9]{4,6}Z?|[0-9a-f]++|[0-9A-F]++)$"
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
#: Characters that a run must have in other parts than these, so that names, paths and slugs aren't taken for secrets.
LEAST_RANDOM = 14

SPANS = "array<struct<start:int,end:int,match:string>>"
#: Matches that are walked one by one; blocks of them are then put one after another.
BLOCK = 256


def nothing() -> Column:
    return F.array().cast(SPANS)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def located(text: Column, pattern: str) -> Column:
    """Array of ``(start, end, match)`` in code points of all matches of ``pattern``."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        one = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def shifted(by: Column, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["match"].alias("match")))

    def walked(pairs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(pairs), F.lit(BLOCK))
        blocks = F.transform(starts, lambda i: F.aggregate(F.slice(pairs, i, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), nothing().alias("out")), step))
        none = F.array().cast(f"array<{SPANS}>")
        add = lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(shifted(acc["at"], x["out"]))).alias("out"))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"]))

    def paired(found: Column) -> Column:
        return F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), bound(bound(found, paired), walked)).otherwise(nothing())


def within(runs: Column, pattern: str) -> Column:
    """Spans of ``pattern`` in spans that hold all its matches."""
    inner = lambda r: F.transform(located(r["match"], pattern), lambda x: F.struct((x["start"] + r["start"]).alias("start"), (x["end"] + r["start"]).alias("end"), x["match"].alias("match")))
    return F.flatten(F.transform(runs, inner))


def top_entropy(word: Column, window: int) -> Column:
    """The largest Shannon entropy of a window of a string, by incremental counts; null if it is shorter.

    Characters outside the alphabet of candidates count as one.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    state = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), F.lit(1e9).alias("least"))

    def slid(places: Column) -> Column:
        def step(acc: Column, enters: Column) -> Column:
            full = acc["i"] >= window
            leaves = F.when(full, F.get(places, acc["i"] - window)).otherwise(F.lit(-1))
            out = F.when(full, F.get(acc["n"], leaves)).otherwise(F.lit(0))
            into = F.get(acc["n"], enters) - F.when(leaves == enters, 1).otherwise(0)
            s = acc["s"] - F.when(full, F.get(weight, out) - F.get(weight, out - 1)).otherwise(F.lit(0.0)) + F.get(weight, into + 1) - F.get(weight, into)
            n = F.when(leaves == enters, acc["n"]).otherwise(F.transform(acc["n"], lambda c, k: c + F.when(k == enters, 1).when(k == leaves, -1).otherwise(0)))
            least = F.when((acc["i"] >= window - 1) & (s < acc["least"]), s).otherwise(acc["least"])
            return F.struct((acc["i"] + 1).alias("i"), n.alias("n"), s.alias("s"), least.alias("least"))

        return F.aggregate(places, state, step, lambda acc: F.lit(math.log2(window)) - acc["least"] / window)

    places = F.transform(F.split(word, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(word) >= window, bound(places, slid))


def random_length(word: Column) -> Column:
    """How many characters of a run lie in parts that aren't plain; "/", "-", "_", "=" and "+" part it."""
    parts = F.filter(F.split(F.regexp_replace(word, UUID, ""), "[/_=+-]+"), lambda p: ~F.regexp(p, F.lit(PLAIN)))
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))


def entropy_spans(runs: Column, c: CharClass) -> Column:
    allowed = lambda m: F.exists(F.array(*[F.lit(p) for p in ALLOWED[c.kind]]), lambda p: F.regexp(m, p))
    found = runs if c.pattern is None else within(runs, c.pattern)
    odd = lambda m: random_length(m) >= LEAST_RANDOM if c.pattern is None else F.lit(True)
    return F.filter(found, lambda x: ~allowed(x["match"]) & odd(x["match"]) & (top_entropy(x["match"], c.window) >= c.entropy))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and an array of spans ``(start, end, match)`` for each kind."""
    text, runs = F.col("text"), F.col("runs")
    lower = F.lower(text)
    named = lower.contains(WORDS[0])
    for w in WORDS[1:]:
        named = named | lower.contains(w)
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= LEAST_VALUE)
    found = text_of(docs, id_col, text_col).select("id", F.when(named, assign).otherwise(nothing()).alias("assign"), located(text, LONG).alias("runs"))
    return found.select(F.col("id").alias("doc_id"), "assign", within(runs, ACCESS).alias("access"), within(runs, HEX).alias("hex"), *[entropy_spans(runs, c).alias(c.kind) for c in CLASSES])


def joined(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then kind as listed, with commas between."""

    def keyed(i: int, kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("s"), F.lit(i).alias("i"), x["end"].alias("e"), F.lit(kind).alias("k")))

    parts = [keyed(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, found = ["assign", "access", "hex"], scan(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(base + [c.kind for c in CLASSES]).alias("spans"))
