"""Chat conversations: validity, rendering, fitting and cutting back.

Conversations are arrays of ``(turn, role, text)`` structs in order of turns; one aggregate makes
them from flat rows, and all else are functions of the array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gathered(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a conversation with its ``messages`` in order."""
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))


def without_system(m: Column) -> Column:
    """Messages after a leading system message."""
    return F.when(F.get(m, F.lit(0))["role"] == "system", F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))).otherwise(m)


def alternates(m: Column) -> Column:
    """Nothing, or user and assistant in turns, the user first."""
    indexed = F.transform(m, lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    return F.forall(indexed, lambda ok: ok)


def valid_roles(m: Column) -> Column:
    """A system message only first and never alone; then strict turns from a user."""
    rest = without_system(m)
    return (F.size(rest) > 0) & alternates(rest)


def long_enough(m: Column) -> Column:
    """After a system message there are at least two messages."""
    return F.size(without_system(m)) >= 2


def ends_with_user(m: Column) -> Column:
    return F.coalesce(F.element_at(m, -1)["role"] == "user", F.lit(False))


def merged_system(m: Column) -> Column:
    """A leading system text becomes the beginning of the first user's, with a blank line between."""
    first, second = F.get(m, F.lit(0)), F.get(m, F.lit(1))
    joined = F.struct(second["turn"].alias("turn"), second["role"].alias("role"), F.concat(first["text"], F.lit("\n\n"), second["text"]).alias("text"))
    return F.when((first["role"] == "system") & (second["role"] == "user"), F.concat(F.array(joined), F.slice(m, 3, F.greatest(F.size(m) - 2, F.lit(0))))).otherwise(m)


def total(m: Column, of) -> Column:
    return F.aggregate(m, F.lit(0).cast("long"), lambda acc, x: acc + of(x))


def render_counts(m: Column) -> dict[str, Column]:
    """Tokens and supervised tokens of a rendered conversation with a token a byte.

    One token begins it; each turn stands between two control tokens; assistants' text and their end
    token are supervised.
    """
    rendered = merged_system(m)
    size = lambda x: F.octet_length(x["text"])
    return {"tokens": (total(rendered, lambda x: size(x) + 2) + 1).cast("long"), "supervised": total(rendered, lambda x: F.when(x["role"] == "assistant", size(x) + 1).otherwise(0))}


BOS, USER_START, USER_END, ASSISTANT_START, ASSISTANT_END = range(256, 261)


def render_bytes(m: Column) -> tuple[Column, Column]:
    """(ids, mask) of a conversation of plain texts with byte ids; control tokens follow the bytes."""
    from .byte_pairs import byte_encode

    def turn(x: Column) -> Column:
        user = x["role"] == "user"
        start, end = F.when(user, USER_START).otherwise(ASSISTANT_START), F.when(user, USER_END).otherwise(ASSISTANT_END)
        return F.concat(F.array(start), byte_encode(x["text"]), F.array(end))

    def mask(x: Column) -> Column:
        talks = x["role"] == "assistant"
        return F.concat(F.array(F.lit(False)), F.array_repeat(talks, F.octet_length(x["text"])), F.array(talks))

    rendered = merged_system(m)
    return F.concat(F.array(F.lit(BOS)), F.flatten(F.transform(rendered, turn))), F.concat(F.array(F.lit(False)), F.flatten(F.transform(rendered, mask)))


def completion_fit(turns: DataFrame, budget: int, key: str = "conv_id") -> DataFrame:
    """How a prompt is cut to ``budget`` tokens: the oldest whole (user, assistant) pairs go first, then the head of the last user text.

    For valid conversations that end with a user: tokens kept, dropped turns, and whether the text was cut.
    The prompt costs one token to begin, two a turn, a byte a token, and one to open the answer. Null
    ``kept_tokens``: not even the control tokens fit.
    """
    m = F.col("messages")
    convs = gathered(turns, key).where(valid_roles(m) & ends_with_user(m)).select(key, merged_system(m).alias("messages"))
    costs = F.transform("messages", lambda x: F.octet_length(x["text"]) + 2)
    last = F.size("messages")
    # suffixes that begin with a user, the longest first; the last message alone always is one
    starts = F.sequence(F.lit(1), last, F.lit(2))
    suffix = F.transform(starts, lambda i: F.struct(i.alias("from"), (F.aggregate(F.slice(F.col("costs"), i, last - i + 1), F.lit(0), lambda a, c: a + c) + 2).alias("n")))
    fits = F.filter(F.col("suffixes"), lambda s: s["n"] <= budget)
    found = convs.withColumn("costs", costs).withColumn("suffixes", suffix).withColumn("fit", F.get(fits, F.lit(0)))
    kept = F.when(F.col("fit").isNotNull(), F.col("fit.n")).when(F.lit(budget) >= 4, F.lit(budget))
    return found.select(key, kept.cast("long").alias("kept_tokens"), (F.coalesce(F.col("fit.from"), last) - 1).cast("long").alias("dropped_turns"), F.col("fit").isNull().alias("cut"))


def rolled_back(m: Column) -> Column:
    """Without the newest user message and what follows it."""
    users = F.filter(F.transform(m, lambda x, i: F.struct(x["role"].alias("role"), i.alias("i"))), lambda x: x["role"] == "user")
    return F.when(F.size(users) > 0, F.slice(m, 1, F.element_at(users, -1)["i"])).otherwise(m)
