"""Text functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits text before merges (a fixed value). Java needs (?U), else its white space is ASCII only.
SPLIT_PATTERN = r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"
#: A final number after the answer marker.
ANSWER = r"#### (-?[0-9.,]+)"
FENCE = "```"
#: How a prompt ends (a fixed value).
INSTRUCTION = "Respond only with the letter of the correct answer."
#: Units from the least on.
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
COUNT_UNITS = ("", "K", "M", "B", "T", "Q")
#: The least double that two decimals show as 1000.
THOUSAND = next(x for x in (999.995, math.nextafter(999.995, 1000.0)) if f"{x:.2f}" == "1000.00")


def regex_chunks(text: Column) -> Column:
    """Chunks that together are the text again."""
    return F.regexp_extract_all(text, F.lit("(?U)" + SPLIT_PATTERN), F.lit(0))


def regex_byte_chunks(text: Column) -> Column:
    return F.transform(regex_chunks(text), lambda c: F.encode(c, "utf-8"))


def multiple_choice_prompt(question: Column, labels: Column, choices: Column) -> Column:
    """A question, a line for each choice with its letter, and the instruction; null unless there are as many labels as choices."""
    lines = F.array_join(F.zip_with(labels, choices, lambda label, c: F.concat(F.lit("- "), c, F.lit("="), label, F.lit("\n"))), "")
    return F.when((F.size(labels) == F.size(choices)) & (F.size(labels) > 0), F.concat(F.lit("Multiple Choice question: "), question, F.lit("\n"), lines, F.lit("\n" + INSTRUCTION)))


def occurrences(text: Column, part: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def fence_class(text: Column) -> Column:
    """Plain code, one whole Markdown fence (typed as Python or untyped), or a malformed one."""
    n = occurrences(text, FENCE)
    lines = F.filter(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", -1), lambda x: x.startswith(FENCE))
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    whole = (n == 2) & (F.size(lines) == 2) & (second == FENCE)
    return F.when(n == 0, "plain_code").when(whole & (first == FENCE + "python"), "balanced_python_fence").when(whole & (first == FENCE), "balanced_untyped_fence").otherwise("malformed_fence")


def gsm8k_answer(text: Column) -> Column:
    """The first marked number without commas; null if there is none."""
    found = F.regexp_extract(text, ANSWER, 1)
    return F.when(text.rlike(ANSWER), F.replace(found, F.lit(","), F.lit("")))


def same_answer(a: Column, b: Column) -> Column:
    return F.coalesce(gsm8k_answer(a) == gsm8k_answer(b), F.lit(False))


def status_class(return_code: Column, stderr: Column, sentinel: str = "INFRASTRUCTURE") -> Column:
    """What became of a run program, by rules in order."""
    return (
        F.when((return_code == -25) | stderr.contains("File too large") | stderr.contains("file too large"), "output_limit")
        .when(stderr.contains(sentinel), "infrastructure_error").when(return_code == 0, "passed").when(stderr.contains("MemoryError"), "memory_limit")
        .when(stderr.contains("SyntaxError"), "syntax_error").when(stderr.contains("AssertionError"), "test_failure").otherwise("runtime_error")
    )


def slug(label: Column) -> Column:
    """Small letters and digits, with underscores for all else between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def markdown_cell(text: Column) -> Column:
    """Text that stays within a cell of a Markdown table; null is a dash."""
    return F.coalesce(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), F.lit("—"))


def assembled(*sections: Column) -> Column:
    """The non-empty sections with blank lines between."""
    return F.concat_ws("\n\n", *[F.nullif(s, F.lit("")) for s in sections])


def few_shot_prompt(examples: Column, current: Column) -> Column:
    """Solved examples and the current one, with blank lines between."""
    return F.array_join(F.concat(examples, F.array(current)), "\n\n")


def two_decimals(x: Column) -> Column:
    """A double of at least 0.5 with two decimals: its exact binary value, half to even, as ``f"{x:.2f}"`` has it."""
    whole = F.floor(x)
    part = ((x - whole) * float(1 << 53)).cast("long") * 100  # exact, as no such double has finer digits
    rest = part.bitwiseAND((1 << 53) - 1)
    down = F.shiftright(part, 53)
    cents = down + ((rest > 1 << 52) | ((rest == 1 << 52) & (down % 2 == 1))).cast("long")
    return F.concat((whole + (cents == 100).cast("long")).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def with_unit(n: Column, size: Column, units: tuple[str, ...], base: float, least: float) -> Column:
    """``n`` as it is, or with two decimals in the unit after the last one in which its ``size`` is at least ``least``."""
    out = F.concat(n.cast("long").cast("string"), F.lit(units[0]))
    for unit in units[1:]:
        out = F.when(size >= least, F.concat(F.when(n < 0, "-").otherwise(""), two_decimals(size / base), F.lit(unit))).otherwise(out)
        size = size / base
    return out


def format_bytes(n: Column, largest: str = "EiB") -> Column:
    """IEC units up to ``largest``."""
    return with_unit(n, n.cast("double"), tuple(f" {u}" for u in BYTE_UNITS[: BYTE_UNITS.index(largest) + 1]), 1024.0, 1024.0)


def format_count(n: Column, largest: str = "Q") -> Column:
    """Whole numbers with K, M, B, T and Q from a thousand on, by the rounded value; none above ``largest``."""
    return with_unit(n, F.abs(n.cast("double")), COUNT_UNITS[: COUNT_UNITS.index(largest) + 1], 1000.0, THOUSAND)


def longest_run(text: Column, char: str) -> Column:
    """The longest run of a character."""
    runs = F.regexp_extract_all(text, F.lit(f"[{char}]+"), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def fenced(text: Column) -> Column:
    """Text in a fence that is longer than any run of backquotes in it."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest_run(text, "`") + 1))
    return F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence)
