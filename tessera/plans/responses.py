"""Queries over prompts, answers and responses: whole documents, with markers, fences and faults set between their words.

The SQL doesn't parse: it states from the words what each shape must give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters
from ..registry import Registry
from ..sources.shards import table

WORDS = "SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[^0-9A-Za-zÀ-ÿ]+'), lambda x: x != '') AS w FROM documents"


def words() -> Column:
    """Runs of letters and digits; splitting at all else took six times as long with eight tasks at once."""
    return F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9A-Za-zÀ-ÿ]++"), F.lit(0))


def answers() -> Column:
    """Every fifth word in a marker; of seven documents three are malformed."""
    marked = F.transform(words(), lambda x, i: F.when(i % 5 == 4, F.concat(F.lit("<<"), x, F.lit("+"), i.cast("string"), F.lit("="), x, i.cast("string"), F.lit(">>"))).otherwise(x))
    kind = F.col("doc_id") % 7
    return F.concat(F.array_join(marked, " "), F.when(kind == 3, " <<open").when(kind == 5, " <<1+1= >>").when(kind == 6, " b>>").otherwise(""))


def prompts() -> Column:
    """Imports, comments and blank lines by turns, up to a line of code; imports go on after it."""
    cut = F.col("doc_id") % 50
    say = lambda before, x, after="": F.concat(F.lit(before), x, F.lit(after))
    line = lambda x, i: F.when(i == cut, say("v_", x, " = 1")).when(i % 4 == 0, say("import ", x)).when(i % 4 == 1, say("  from ", x, " import y ")).when(i % 4 == 2, say(" # ", x)).otherwise("")
    lines = F.transform(words(), line)
    return F.when(F.col("doc_id") % 2 == 0, F.array_join(lines, "\n")).otherwise(F.array_join(lines, "\r\n"))


def completions() -> Column:
    """A word a line; a fence of one of four kinds, then a Python fence that two documents of three close."""
    w, a = words(), (F.col("doc_id") % 5).cast("int")
    n = (F.col("doc_id") % 7).cast("int")
    row = lambda x: F.array(F.lit(x))
    kind = F.col("doc_id") % 4
    tag = F.when(kind == 0, "```").when(kind == 1, "```python").when(kind == 2, "```js").otherwise("``` python3")
    end = F.when(F.col("doc_id") % 3 < 2, row("```")).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.slice(w, F.lit(1), a), F.array(tag), F.slice(w, a + 1, n), row("```"), F.slice(w, a + n + 1, F.lit(2)), row(" ``` python"), F.slice(w, a + n + 3, F.greatest(F.size(w), F.lit(1))), end, row("end")), "\n")


def responses() -> Column:
    """A JSON object of each document, in ten shapes that are sound, fenced, cut, repeated or not JSON at all."""
    d, base = F.col("doc_id"), F.to_json(F.struct("lang", "source", F.coalesce("text", F.lit("")).alias("text")))
    cut = base.substr(F.lit(1), (d % (F.length(base) - 1) + 1).cast("int"))
    bare = base.substr(F.lit(1), F.length(base) - 1)
    fence = lambda tag, x: F.concat(F.lit(f"```{tag}\n"), x, F.lit("\n```"))
    kinds = [base, fence("json", base), fence("", base), cut, F.concat(bare, F.lit(',"text":1}')), F.concat(F.lit("["), base, F.lit(",1.5]")), F.concat(F.lit('{"n":NaN,'), base.substr(F.lit(2), F.length(base))), F.concat(F.lit("x "), F.coalesce("text", F.lit(""))), F.lit(" \n "), fence("json", cut)]
    return F.element_at(F.array(*kinds), (d % 10 + 1).cast("int"))


def register(r: Registry) -> None:
    def query(column: Column, name: str):
        return lambda s, d: table(s, d, "documents").select("doc_id", column().alias(name))

    parts = lambda: F.array_join(F.transform(adapters.gsm8k_parts(answers()), lambda x: F.concat(x["type"], F.lit("="), x["text"])), "|")
    r.add("gsm8k_parts", query(parts, "parts"), f"""
        SELECT doc_id, CASE WHEN doc_id % 7 NOT IN (3, 5, 6) THEN 'text=' || coalesce(array_to_string(list_transform(w, lambda x, i: CASE
            WHEN i % 5 = 0 THEN ' |python=' || x || '+' || (i - 1) || '|python_output=' || x || (i - 1) || '|text=' WHEN i = 1 THEN x ELSE ' ' || x END), ''), '') END AS parts FROM ({WORDS})""")
    r.add("leading_imports", query(lambda: adapters.leading_imports(prompts()), "imports"), f"""
        SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(w[1:doc_id % 50], lambda x, i: CASE i % 4 WHEN 1 THEN 'import ' || x WHEN 2 THEN 'from ' || x || ' import y' END), lambda x: x IS NOT NULL), chr(10)), '') AS imports FROM ({WORDS})""")
    r.add("fenced_program", query(lambda: adapters.program(completions()), "program"), f"""
        SELECT doc_id, coalesce(array_to_string(CASE WHEN doc_id % 4 < 2 THEN w[a + 1:b] WHEN doc_id % 3 < 2 THEN w[b + 3:]
            ELSE list_concat(w[1:a], [CASE doc_id % 4 WHEN 2 THEN '```js' ELSE '``` python3' END], w[a + 1:b], ['```'], w[b + 1:b + 2], [' ``` python'], w[b + 3:], ['end']) END, chr(10)), '') AS program
        FROM (SELECT *, doc_id % 5 AS a, doc_id % 5 + doc_id % 7 AS b FROM ({WORDS}))""")

    def diagnosed(s: SparkSession, d: str) -> DataFrame:
        return table(s, d, "documents").select("doc_id", adapters.json_diagnosis(responses()).alias("x")).select("doc_id", "x.*")

    r.add("json_diagnosis", diagnosed, """
        SELECT doc_id, k = 8 AS blank, k IN (0, 5) AS valid, k = 0 AS is_object, k IN (1, 2, 9) AS fenced, k IN (1, 2) AS fenced_valid, k != 0 AS violation FROM (SELECT doc_id, doc_id % 10 AS k FROM documents)""")
