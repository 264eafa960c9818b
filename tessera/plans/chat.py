"""Queries over conversations and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import conversations as C
from ..registry import Registry
from ..sources.shards import table

#: Messages as lists, in order of turns.
LISTS = "SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id"
REST = f"SELECT *, CASE WHEN roles[1] = 'system' THEN roles[2:] ELSE roles END AS rest FROM ({LISTS})"
VALID = "len(rest) > 0 AND list_bool_and(list_transform(rest, lambda x, i: x = CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END))"
MERGED = f"""SELECT conv_id, CASE WHEN roles[1] = 'system' AND roles[2] = 'user' THEN roles[2:] ELSE roles END AS roles,
    CASE WHEN roles[1] = 'system' AND roles[2] = 'user' THEN list_concat([texts[1] || chr(10) || chr(10) || texts[2]], texts[3:]) ELSE texts END AS texts, rest FROM ({REST})"""


def convs(s: SparkSession, d: str) -> DataFrame:
    return C.gathered(table(s, d, "conversations"))


def register(r: Registry) -> None:
    m = lambda: F.col("messages")
    r.add("chat_valid_roles", lambda s, d: convs(s, d).select("conv_id", C.valid_roles(m()).alias("valid")), f"SELECT conv_id, coalesce({VALID}, false) AS valid FROM ({REST})")
    r.add("chat_smoltalk_filter", lambda s, d: convs(s, d).where(C.valid_roles(m()) & C.long_enough(m())).select("conv_id", F.size(m()).cast("long").alias("messages")), f"SELECT conv_id, len(roles) AS messages FROM ({REST}) WHERE {VALID} AND len(rest) >= 2")
    r.add("chat_ends_user", lambda s, d: convs(s, d).where(C.ends_with_user(m())).select("conv_id"), f"SELECT conv_id FROM ({LISTS}) WHERE roles[-1] = 'user'")
    r.add("chat_merge_system", lambda s, d: convs(s, d).select("conv_id", C.merged_system(m()).alias("messages")).select("conv_id", F.size(m()).cast("long").alias("messages"), F.get(m(), F.lit(0))["text"].alias("first_text")), f"SELECT conv_id, len(roles) AS messages, texts[1] AS first_text FROM ({MERGED})")
    counts = lambda: C.render_counts(m())
    r.add("chat_render_counts", lambda s, d: convs(s, d).where(C.valid_roles(m())).select("conv_id", *[c.alias(n) for n, c in counts().items()]), f"""
        SELECT conv_id, CAST(1 + list_sum(list_transform(texts, lambda t: strlen(t) + 2)) AS BIGINT) AS tokens,
               CAST(coalesce(list_sum(list_transform(texts, lambda t, i: CASE WHEN roles[i] = 'assistant' THEN strlen(t) + 1 ELSE 0 END)), 0) AS BIGINT) AS supervised
        FROM ({MERGED}) WHERE {VALID}""")

    def rendered(s: SparkSession, d: str) -> DataFrame:
        ids, mask = C.render_bytes(m())
        return convs(s, d).where(C.valid_roles(m())).select("conv_id", F.size(ids).cast("long").alias("tokens"), F.size(F.filter(mask, lambda x: x)).cast("long").alias("supervised"))

    r.add("chat_render_tokens", rendered, r.oracles["chat_render_counts"])
    r.add("chat_completion_fit", lambda s, d: C.completion_fit(table(s, d, "conversations"), 400), f"""
        WITH v AS (SELECT conv_id, list_transform(texts, lambda t: strlen(t) + 2) AS c FROM ({MERGED}) WHERE {VALID} AND roles[-1] = 'user'),
        x AS (SELECT conv_id, len(c) AS n, i, 2 + list_sum(c[i:]) AS k FROM v, range(1, 100, 2) t(i) WHERE i <= len(c)),
        f AS (SELECT conv_id, any_value(n) AS n, min(i) FILTER (k <= 400) AS i, max(k) FILTER (k <= 400) AS k FROM x GROUP BY conv_id)
        SELECT conv_id, CAST(coalesce(k, 400) AS BIGINT) AS kept_tokens, CAST(coalesce(i, n) - 1 AS BIGINT) AS dropped_turns, i IS NULL AS cut FROM f""")
    r.add("chat_rollback", lambda s, d: convs(s, d).select("conv_id", F.size(C.rolled_back(m())).cast("long").alias("messages")), f"""
        SELECT conv_id, CASE WHEN list_contains(roles, 'user') THEN len(roles) - list_position(list_reverse(roles), 'user') ELSE len(roles) END AS messages FROM ({LISTS})""")

    bench = lambda s, d: table(s, d, "benchmark")
    labels = lambda: F.array(*[F.lit(x) for x in "ABCD"])
    words = lambda: F.slice(F.split("text", " ", -1), 1, 4)
    r.add("mc_prompt", lambda s, d: bench(s, d).select("item_id", T.multiple_choice_prompt(F.col("text"), labels(), words()).alias("prompt")), """
        SELECT item_id, CASE WHEN len(w) = 4 THEN 'Multiple Choice question: ' || text || chr(10) || array_to_string(list_transform(w, lambda c, i: '- ' || c || '=' || ['A','B','C','D'][i] || chr(10)), '')
               || chr(10) || 'Respond only with the letter of the correct answer.' END AS prompt FROM (SELECT *, string_split(text, ' ')[1:4] AS w FROM benchmark)""")
    k = lambda: F.col("doc_id") % 5
    fence = lambda: F.when(k() == 0, F.col("text")).when(k() == 1, F.concat(F.lit("```python\n"), F.col("text"), F.lit("\n```"))).when(k() == 2, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).when(k() == 3, F.concat(F.lit("```\n"), F.col("text"))).otherwise(F.concat(F.lit("```js\n"), F.col("text"), F.lit("\n```")))
    r.add("code_fence_class", lambda s, d: table(s, d, "documents").select("doc_id", T.fence_class(fence()).alias("fence")), """
        SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'plain_code' WHEN 1 THEN 'balanced_python_fence' WHEN 2 THEN 'balanced_untyped_fence' ELSE 'malformed_fence' END AS fence FROM documents""")
    answer = lambda c: F.concat(F.lit("so "), F.when(k() == 4, "####  ").otherwise("#### "), F.format_string("%s", c))
    amount = lambda: F.concat(F.when(k() == 1, "-").otherwise(""), (F.col("doc_id") * 37).cast("string"), F.lit(",500.25"))
    r.add("gsm8k_extract", lambda s, d: table(s, d, "documents").select("doc_id", T.gsm8k_answer(answer(amount())).alias("answer"), T.same_answer(answer(amount()), F.concat(F.lit("#### "), (F.col("doc_id") * 37).cast("string"), F.lit("500.25"))).alias("same")), """
        SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE CASE WHEN doc_id % 5 = 1 THEN '-' ELSE '' END || (doc_id * 37) || '500.25' END AS answer, doc_id % 5 NOT IN (1, 4) AS same FROM documents""")
    err = lambda: F.concat_ws(" ", F.when(F.col("event_id") % 7 == 1, "MemoryError"), F.when(F.col("event_id") % 7 == 2, "SyntaxError"), F.when(F.col("event_id") % 7 == 3, "AssertionError"), F.when(F.col("event_id") % 11 == 0, "file too large"))
    r.add("status_classify", lambda s, d: table(s, d, "events").select("event_id", T.status_class(F.col("event_id") % 2, err()).alias("status")), """
        SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'output_limit' WHEN event_id % 2 = 0 THEN 'passed' WHEN event_id % 7 = 1 THEN 'memory_limit' WHEN event_id % 7 = 2 THEN 'syntax_error'
               WHEN event_id % 7 = 3 THEN 'test_failure' ELSE 'runtime_error' END AS status FROM events""")
    r.add("task_slug", lambda s, d: table(s, d, "part").select("p_partkey", T.slug(F.concat(F.lit(" "), "p_name", F.lit("--"), "p_type", F.lit("!"))).alias("slug")), """
        SELECT p_partkey, regexp_replace(regexp_replace(lower(' ' || p_name || '--' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM part""")
    r.add("markdown_escape", lambda s, d: table(s, d, "documents").select("doc_id", T.markdown_cell(F.nullif(F.col("text"), F.lit(""))).alias("cell")), r"""
        SELECT doc_id, coalesce(replace(replace(nullif(text, ''), '|', '\|'), chr(10), ' '), '—') AS cell FROM documents""")
    r.add("assemble_program", lambda s, d: table(s, d, "documents").select("doc_id", T.assembled(F.when(k() != 0, "import os").otherwise(""), F.col("text"), F.when(k() == 2, "").otherwise("check()")).alias("program")), """
        SELECT doc_id, concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 5 != 0 THEN 'import os' END, nullif(text, ''), CASE WHEN doc_id % 5 != 2 THEN 'check()' END) AS program FROM documents""")
    r.add("few_shot_prompt", lambda s, d: bench(s, d).select("item_id", T.few_shot_prompt(F.array(F.lit("Q=A"), F.lit("R=B")), F.col("text")).alias("prompt")), """
        SELECT item_id, 'Q=A' || chr(10) || chr(10) || 'R=B' || chr(10) || chr(10) || text AS prompt FROM benchmark""")
    r.add("fenced_text", lambda s, d: bench(s, d).select("item_id", T.longest_run(F.col("text"), "e").cast("int").alias("run"), T.fenced(F.col("text")).alias("fenced")), """
        SELECT item_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, 'e+'), lambda x: length(x))), 0) AS INT) AS run, '```' || chr(10) || text || chr(10) || '```' AS fenced FROM benchmark""")
    r.add("regex_chunks", lambda s, d: table(s, d, "documents").select("doc_id", T.regex_chunks(F.col("text")).alias("c")).select("doc_id", F.size("c").alias("chunks"), (F.array_join("c", "")).alias("joined")))
