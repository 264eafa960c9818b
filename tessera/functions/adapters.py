"""Dataset rows as prompts, and checks of generated text that need Python, as Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.jsonl import Invalid, strict_json
from .text import gsm8k_answer, multiple_choice_prompt

LETTERS = ("A", "B", "C", "D")
#: What ends a line, within brackets.
BREAKS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
#: All lines before the first that is neither an import, nor blank, nor a comment. Nothing is tried twice, and the lines are met in a loop, so long heads take no stack.
HEAD = rf"(?U)\A(?:[\s&&[^{BREAKS}]]*+(?:#[^{BREAKS}]*+|(?:import|from) [\s&&[^{BREAKS}]]*+[^\s{BREAKS}][^{BREAKS}]*+)?+(?:\r\n|[{BREAKS}]|\z))*+"


def mmlu(rows: DataFrame) -> DataFrame:
    """``prompt, answer, subject`` of rows with exactly four choices and an answer 0 to 3; others have an ``error``."""
    letters = F.array(*[F.lit(x) for x in LETTERS])
    ok = (F.size("choices") == 4) & F.col("answer").between(0, 3) & (F.trim("question") != "")
    prompt = multiple_choice_prompt(F.col("question"), letters, F.col("choices"))
    return rows.select(F.when(ok, prompt).alias("prompt"), F.when(ok, F.get(letters, F.col("answer").cast("int"))).alias("answer"), "subject", F.when(~F.coalesce(ok, F.lit(False)), "malformed row").alias("error"))


def arc(rows: DataFrame) -> DataFrame:
    """``prompt, answer, labels``: as many texts as labels, unique labels, and an answer among them."""
    labels, texts = F.col("choices.label"), F.col("choices.text")
    ok = (F.size(labels) > 0) & (F.size(labels) == F.size(texts)) & (F.size(F.array_distinct(labels)) == F.size(labels)) & F.array_contains(labels, F.col("answerKey"))
    return rows.select(F.when(ok, multiple_choice_prompt(F.col("question"), labels, texts)).alias("prompt"), F.when(ok, F.col("answerKey")).alias("answer"), labels.alias("labels"), F.when(~F.coalesce(ok, F.lit(False)), "malformed row").alias("error"))


def gsm8k_eval(rows: DataFrame) -> DataFrame:
    """``question, reference``; a row without a marked answer has an ``error``."""
    reference = gsm8k_answer(F.col("answer"))
    return rows.select("question", reference.alias("reference"), F.when(reference.isNull(), "no marked answer").alias("error"))


def _udf(fn: Callable[[str], Any], kind: str) -> Callable[[Column], Column]:
    """A function of one text as an Arrow-batched column function; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fn(t))

    return lambda column: F.pandas_udf(run, kind)(column)  # made when used, as a type needs a session


def answer_parts(answer: str) -> list[dict[str, str]]:
    """Text around ``<<expression=result>>`` markers, each as a Python part and its output. Text is never lost."""
    out, rest = [], answer
    while True:
        text, mark, after = rest.partition("<<")
        if ">>" in text:
            raise Invalid("a marker ends that didn't begin")
        out.append({"type": "text", "text": text})
        if not mark:
            return out
        inner, end, rest = after.partition(">>")
        expression, equals, result = inner.rpartition("=")
        if not end or not equals or re.search("[<>]", inner) or not expression.strip() or not result.strip():
            raise Invalid("a marker must be <<expression=result>>")
        out += [{"type": "python", "text": expression}, {"type": "python_output", "text": result}]


def _parts_or_none(answer: str) -> list[dict[str, str]] | None:
    try:
        return answer_parts(answer)
    except Invalid:
        return None


gsm8k_parts = _udf(_parts_or_none, "array<struct<type:string,text:string>>")


def leading_imports(prompt: Column) -> Column:
    """Import lines at the head of a prompt: all before the first line that is neither one, nor blank, nor a comment."""
    lines = F.split(F.regexp_extract(prompt, HEAD, 0), rf"\r\n|[{BREAKS}]", -1)
    return F.array_join(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x.rlike("^(import|from) ")), "\n")


def program_of(completion: str) -> str:
    """What the first whole untyped or Python fence holds, else the text itself, trimmed."""
    opened: str | None = None
    body: list[str] = []
    for line in completion.splitlines():
        mark = line.strip()
        if opened is None:
            if mark.startswith("```"):
                opened, body = mark[3:].strip(), []
        elif mark == "```":
            if opened in ("", "python"):
                return "\n".join(body).strip()
            opened = None
        else:
            body.append(line)
    return completion.strip()


program = _udf(program_of, "string")


def json_diagnosis_of(response: str) -> dict[str, bool]:
    """Whether a response is strict JSON, alone or in a fence, and an object."""
    text = response.strip()
    inner = re.fullmatch(r"```(?:json)?\n(.*)\n```", text, re.S)

    def parses(t: str) -> Any:
        try:
            return strict_json(t)
        except Invalid:
            return Invalid

    alone = parses(text)
    within = parses(inner[1]) if inner else Invalid
    return {"blank": not text, "valid": alone is not Invalid, "is_object": isinstance(alone, dict), "fenced": inner is not None, "fenced_valid": within is not Invalid, "violation": not isinstance(alone, dict)}


def json_diagnosis(response: Column) -> Column:
    """The diagnosis as a struct; null stays null."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([json_diagnosis_of(t or "") for t in texts])

    found = F.pandas_udf(run, "blank boolean, valid boolean, is_object boolean, fenced boolean, fenced_valid boolean, violation boolean")
    return F.when(response.isNotNull(), found(response))


def humaneval(rows: DataFrame) -> DataFrame:
    """Prompt, leading imports and hashes of what must not be published; a blank field or a bad entry point is an ``error``."""
    fields = ("prompt", "canonical_solution", "test", "entry_point")
    ok = F.col("entry_point").rlike(r"^[A-Za-z_]\w*$")
    for f in fields:
        ok = ok & (F.trim(F.col(f)) != "")
    hashed = [F.sha2(F.col(f).cast("binary"), 256).alias(f"{f}_sha256") for f in fields[1:3]]
    return rows.select("prompt", "entry_point", leading_imports(F.col("prompt")).alias("imports"), *hashed, F.when(~F.coalesce(ok, F.lit(False)), "malformed row").alias("error"))
