"""Strict nested documents: a table of rules compiled to one expression that names the first fault.

Documents are parsed as variants, which refuse duplicate keys and NaN. Rules are looked at in order; the fault is a
struct of the path and the reason, null for a sound document. So a million documents are checked in one pass of built-in
expressions, and adding a rule is adding a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULT = "struct<path:string,reason:string>"


class Rule(NamedTuple):
    """``sound`` is true where the value at ``path`` is as it must be; null counts as false."""

    path: str
    reason: str
    sound: Callable[[Document], Column]


class Document:
    """A parsed document and what there is at its paths (``$.a.b``)."""

    def __init__(self, parsed: Column) -> None:
        self.parsed = parsed

    def value(self, path: str) -> Column:
        return self.parsed if path == "$" else F.try_variant_get(self.parsed, path, "variant")

    def kind(self, path: str) -> Column:
        """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID (for null), or null for what isn't there."""
        return F.regexp_extract(F.schema_of_variant(self.value(path)), "^([A-Z]+)", 1)

    def there(self, path: str) -> Column:
        return self.value(path).isNotNull()

    def get(self, path: str, kind: str) -> Column:
        return F.try_variant_get(self.parsed, path, kind)

    def text(self, path: str) -> Column:
        return F.when(self.kind(path) == "STRING", self.get(path, "string"))

    def keys(self, path: str) -> Column:
        """Names of an object's fields; null for anything else."""
        return F.when(self.kind(path) == "OBJECT", F.map_keys(F.try_variant_get(self.value(path), "$", "map<string,variant>")))

    def whole(self, path: str) -> Column:
        """A whole number; null for anything else, truth values and 1.5 included."""
        return F.when(self.kind(path) == "BIGINT", self.get(path, "long"))

    def number(self, path: str) -> Column:
        return F.when(self.kind(path).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), self.get(path, "double"))

    def is_null(self, path: str) -> Column:
        return self.kind(path) == "VOID"


def keys(path: str, needed: Iterable[str], allowed: Iterable[str] = ()) -> Rule:
    """An object with these fields, of which ``allowed`` may lack."""
    need, may = sorted(needed), sorted({*needed, *allowed})
    return Rule(path, f"must be an object with the fields {', '.join(need)}" + (f" and maybe {', '.join(sorted(set(may) - set(need)))}" if len(may) > len(need) else ""), lambda d: (F.size(F.array_except(F.array(*map(F.lit, need)), d.keys(path))) == 0) & (F.size(F.array_except(d.keys(path), F.array(*map(F.lit, may)))) == 0))


def an_object(path: str) -> Rule:
    return Rule(path, "must be an object", lambda d: d.kind(path) == "OBJECT")


def text(path: str) -> Rule:
    return Rule(path, "must be a text that isn't blank", lambda d: F.length(F.regexp_replace(d.text(path), r"(?U)\s+", "")) > 0)


def one_of(path: str, *values: str) -> Rule:
    return Rule(path, f"must be one of {', '.join(values)}", lambda d: d.text(path).isin(*values))


def whole(path: str, least: int = 0) -> Rule:
    return Rule(path, f"must be a whole number of at least {least}", lambda d: d.whole(path) >= least)


def number(path: str, least: float = 0.0, most: float = float("inf")) -> Rule:
    within = f"of at least {least:g}" + ("" if most == float("inf") else f" and at most {most:g}")
    return Rule(path, f"must be a number {within}", lambda d: d.number(path).between(least, most) & (d.number(path) < float("inf")))


def version(path: str, *known: int) -> Rule:
    return Rule(path, f"must be {' or '.join(map(str, known))}", lambda d: d.whole(path).isin(*known))


def or_null(rule: Rule) -> Rule:
    return Rule(rule.path, rule.reason + ", or null", lambda d: F.coalesce(d.is_null(rule.path), F.lit(False)) | F.coalesce(rule.sound(d), F.lit(False)))


def where(condition: Callable[[Document], Column], rule: Rule) -> Rule:
    """A rule that holds only for some documents."""
    return rule._replace(sound=lambda d: ~F.coalesce(condition(d), F.lit(False)) | F.coalesce(rule.sound(d), F.lit(False)))


def scalars(path: str) -> Rule:
    """An object of numbers, texts, truth values and nulls; numbers beyond a double's range aren't finite."""

    def sound(d: Document) -> Column:
        fields = F.map_values(F.try_variant_get(d.value(path), "$", "map<string,variant>"))
        simple = F.forall(fields, lambda v: v.isNull() | ~F.coalesce(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.lit(False)))
        return (d.kind(path) == "OBJECT") & simple

    return Rule(path, "must hold scalars only", sound)


def fault(json: Column, rules: Iterable[Rule]) -> Column:
    """The first fault of a JSON text: ``path, reason``; null for a sound one."""
    parsed = F.try_parse_json(json)
    document = Document(parsed)
    say = lambda path, reason: F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"))
    return F.coalesce(F.when(parsed.isNull(), say("$", "must be JSON without repeated keys")), *[F.when(~F.coalesce(r.sound(document), F.lit(False)), say(r.path, r.reason)) for r in rules])


#: Run summaries: their fields, and which statuses there are.
SUMMARY = (
    keys("$", ("latest_metrics", "latest_step", "run", "schema_version", "status")), version("$.schema_version", 1), keys("$.run", ("name", "output_dir", "stage")),
    text("$.run.name"), text("$.run.output_dir"), text("$.run.stage"), one_of("$.status", "running", "completed", "failed"), or_null(whole("$.latest_step")), scalars("$.latest_metrics"),
)

#: The two protocols of bits per byte that an evaluation with that mode reports (fixed values).
PROTOCOLS = ("full_documents_v1", "nanochat_compat_v1")
COUNTS = ("source_documents", "source_tokens", "source_bytes", "processed_model_tokens", "counted_target_tokens", "counted_target_bytes", "unique_source_tokens", "unique_source_bytes")
SHARES = ("source_token_retention", "source_byte_retention")
NAMES = ("checkpoint_identity", "tokenizer_identity", "validation_manifest_identity")


def result_rules(protocol: str) -> tuple[Rule, ...]:
    """One protocol's result: its identities, counts that fit one another, and bits per byte that follow from them."""
    at = f"$.results.{protocol}"
    of = lambda name: f"{at}.{name}"
    fits = lambda low, high: Rule(of(low), f"must not exceed {high}", lambda d: d.whole(of(low)) <= d.whole(of(high)))
    near = lambda a, b: F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b), F.lit(1.0))
    share = lambda part, kind: Rule(of(part), f"must be unique over source {kind}", lambda d: near(d.number(of(part)), F.coalesce(F.try_divide(d.whole(of(f"unique_source_{kind}")), d.whole(of(f"source_{kind}"))), F.lit(0.0))))
    same = {"checkpoint_identity": "$.identities.checkpoint.identity", "tokenizer_identity": "$.identities.tokenizer", "validation_manifest_identity": "$.identities.validation_manifest"}
    return (
        keys(at, ("protocol_id", "protocol_version", "reference_commit", "reference_config", "total_nats", "bpb", *COUNTS, *SHARES, *NAMES)),
        one_of(of("protocol_id"), protocol), whole(of("protocol_version"), 1), or_null(text(of("reference_commit"))), an_object(of("reference_config")), *[text(of(n)) for n in NAMES],
        *[whole(of(c), 1 if c in ("counted_target_tokens", "counted_target_bytes", "source_documents") else 0) for c in COUNTS],
        fits("unique_source_tokens", "source_tokens"), fits("unique_source_bytes", "source_bytes"), fits("unique_source_tokens", "counted_target_tokens"), fits("unique_source_bytes", "counted_target_bytes"),
        *[number(of(s), 0, 1) for s in SHARES], share("source_token_retention", "tokens"), share("source_byte_retention", "bytes"), number(of("total_nats")), number(of("bpb")),
        Rule(of("bpb"), "must be total_nats over ln(2) and counted_target_bytes", lambda d: near(d.number(of("bpb")), d.number(of("total_nats")) / F.log(F.lit(2.0)) / d.whole(of("counted_target_bytes")))),
        *[Rule(of(n), f"must equal {path}", lambda d, n=n, path=path: d.text(of(n)) == d.text(path)) for n, path in same.items()],
    )


def evaluation_rules(document_format: str, versions: tuple[int, ...] = (2, 3)) -> tuple[Rule, ...]:
    """Completed base evaluations of a format's versions: modes, bounds, identities and results must fit one another."""
    modes = lambda d, path="$.requested_modes": F.when(d.kind(path) == "ARRAY", d.get(path, "array<string>"))
    with_bpb = lambda d: F.array_contains(modes(d), "bpb")
    bounded = lambda d: d.get("$.bounded", "boolean")
    known = F.array(*map(F.lit, ("bpb", "core", "sample")))
    fitting = lambda mode, field: Rule(f"$.{field}", f"must be an object if {mode} was requested, else absent", lambda d: F.when(F.array_contains(modes(d), mode), d.kind(f"$.{field}") == "OBJECT").otherwise(~d.there(f"$.{field}")))
    manifest = "$.identities.validation_manifest"
    rules = [
        keys("$", ("bounded", "completed_modes", "format", "format_version", "identities", "max_per_task", "requested_modes", "results", "run_kind", "status"), ("core", "samples")),
        one_of("$.format", document_format), version("$.format_version", *versions), one_of("$.status", "completed"),
        Rule("$.requested_modes", "must be a list of different known modes", lambda d: (F.size(modes(d)) > 0) & (F.size(F.array_distinct(modes(d))) == F.size(modes(d))) & (F.size(F.array_except(modes(d), known)) == 0)),
        Rule("$.completed_modes", "must equal requested_modes", lambda d: modes(d, "$.completed_modes") == modes(d)),
        fitting("core", "core"), fitting("sample", "samples"),
        Rule("$.bounded", "must be true or false", lambda d: d.kind("$.bounded") == "BOOLEAN"),
        Rule("$.run_kind", "must be bounded or full, as bounded says", lambda d: d.text("$.run_kind") == F.when(bounded(d), "bounded").otherwise("full")),
        where(bounded, whole("$.max_per_task", 1)), where(lambda d: ~bounded(d), Rule("$.max_per_task", "must be null in a full evaluation", lambda d: d.is_null("$.max_per_task"))),
        keys("$.identities", ("checkpoint", "config", "tokenizer", "validation_manifest")), keys("$.identities.checkpoint", ("identity", "step")),
        text("$.identities.checkpoint.identity"), whole("$.identities.checkpoint.step"), text("$.identities.config"), text("$.identities.tokenizer"),
        where(with_bpb, text(manifest)), where(lambda d: ~with_bpb(d), Rule(manifest, "must be null without bpb", lambda d: d.is_null(manifest))),
        where(with_bpb, keys("$.results", PROTOCOLS)), where(lambda d: ~with_bpb(d), Rule("$.results", "must be empty without bpb", lambda d: F.size(d.keys("$.results")) == 0)),
    ]
    return (*rules, *[where(with_bpb, r) for p in PROTOCOLS for r in result_rules(p)])


def summary_faults(summaries: DataFrame) -> DataFrame:
    """``run, path, reason`` of unsound summaries; input: run (the name its configuration gives), run_dir, text.

    A summary must also name its own run and directory; a trailing slash doesn't matter.
    """
    doc = Document(F.try_parse_json("text"))
    own = fault(F.col("text"), SUMMARY)
    bare = lambda c: F.regexp_replace(c, "/+$", "")
    say = lambda path, reason: F.struct(F.lit(path).alias("path"), F.lit(reason).alias("reason"))
    found = F.coalesce(own, F.when(doc.text("$.run.name") != F.col("run"), say("$.run.name", "must be the configured name")), F.when(bare(doc.text("$.run.output_dir")) != bare(F.col("run_dir")), say("$.run.output_dir", "must be the run's directory")))
    return summaries.select("run", found.alias("x")).where("x is not null").select("run", "x.path", "x.reason")


def snapshots(runs: DataFrame, log: DataFrame, document_format: str) -> DataFrame:
    """``run, status, latest_step, fault`` of runs from their documents: a row a run, ready for comparison only where ``fault`` is null.

    ``runs``: run, run_dir, summary, evaluation (JSON texts; a null evaluation is one that wasn't made); ``log``: run, step. The summary's
    latest step must be the log's; names must be unique.
    """
    doc = Document(F.try_parse_json("summary"))
    steps = log.groupBy("run").agg(F.max("step").alias("_step"))
    names = runs.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    bad = summary_faults(runs.select("run", "run_dir", F.col("summary").alias("text"))).groupBy("run").agg(F.min(F.concat_ws(" ", F.lit("summary"), "path", "reason")).alias("_bad"))
    joined = runs.join(steps, "run", "left").join(names, "run").join(bad, "run", "left")
    evaluation = fault(F.col("evaluation"), evaluation_rules(document_format))
    why = reduce(F.coalesce, [F.when(F.col("_n") > 1, F.lit("the name isn't unique")), F.col("_bad"), F.when(~doc.whole("$.latest_step").eqNullSafe(F.col("_step")), F.lit("summary $.latest_step must be the log's last step")), F.when(F.col("evaluation").isNotNull(), F.when(evaluation.isNotNull(), F.concat_ws(" ", F.lit("evaluation"), evaluation["path"], evaluation["reason"])))])
    return joined.select("run", doc.text("$.status").alias("status"), doc.whole("$.latest_step").alias("latest_step"), why.alias("fault"))


