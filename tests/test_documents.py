"""Sound documents pass; a fault planted at each rule is named."""

import copy
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.sources import documents

FORMAT = "own_base_evaluation"


def summary(name="r1", at="/runs/r1"):
    return {"latest_metrics": {"train/loss": 1.5, "ok": True, "none": None, "text": "x"}, "latest_step": 7, "run": {"name": name, "output_dir": at, "stage": "pretrain"}, "schema_version": 1, "status": "completed"}


def evaluation(version=2, modes=("bpb", "core", "sample"), bounded=False):
    result = {"reference_commit": None, "reference_config": {"n": 1}, "protocol_version": 1, "checkpoint_identity": "c", "tokenizer_identity": "t", "validation_manifest_identity": "m", "source_documents": 4, "source_tokens": 40, "source_bytes": 100, "processed_model_tokens": 64, "counted_target_tokens": 30, "counted_target_bytes": 80, "unique_source_tokens": 30, "unique_source_bytes": 80, "source_token_retention": 0.75, "source_byte_retention": 0.8, "total_nats": 55.5, "bpb": 55.5 / math.log(2) / 80}
    out = {"bounded": bounded, "completed_modes": list(modes), "format": FORMAT, "format_version": version, "identities": {"checkpoint": {"identity": "c", "step": 7}, "config": "k", "tokenizer": "t", "validation_manifest": "m" if "bpb" in modes else None}, "max_per_task": 5 if bounded else None, "requested_modes": list(modes), "results": {p: result | {"protocol_id": p} for p in documents.PROTOCOLS} if "bpb" in modes else {}, "run_kind": "bounded" if bounded else "full", "status": "completed"}
    return out | ({"core": {"x": 1}} if "core" in modes else {}) | ({"samples": {}} if "sample" in modes else {})


def changed(doc, path, value):
    """A copy with another value at ``path``; DROP removes it."""
    out = copy.deepcopy(doc)
    *way, last = path.split(".")[1:]
    at = out
    for k in way:
        at = at[k]
    if value == "DROP":
        del at[last]
    else:
        at[last] = value
    return out


def faults(spark, docs, rules):
    rows = spark.createDataFrame([(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "i int, text string")
    return [None if r.x is None else (r.x.path, r.x.reason) for r in rows.select("i", documents.fault(F.col("text"), rules).alias("x")).orderBy("i").collect()]


def test_sound_documents(spark):
    rules = documents.evaluation_rules(FORMAT)
    sound = [evaluation(v, m, b) for v in (2, 3) for m in (("bpb",), ("core",), ("sample", "bpb"), ("bpb", "core", "sample")) for b in (True, False)]
    assert faults(spark, sound, rules) == [None] * len(sound)
    assert faults(spark, [summary(), summary() | {"latest_step": None, "status": "running"}, summary() | {"latest_metrics": {}}], documents.SUMMARY) == [None] * 3


R = "$.results.full_documents_v1"
EVALUATION = [
    ("$.extra", 1, "$"), ("$.status", "DROP", "$"), ("$.format", "other", "$.format"), ("$.format_version", 4, "$.format_version"), ("$.format_version", True, "$.format_version"), ("$.format_version", 2.0, None), ("$.status", "running", "$.status"),
    ("$.requested_modes", [], "$.requested_modes"), ("$.requested_modes", ["bpb", "bpb"], "$.requested_modes"), ("$.requested_modes", ["other"], "$.requested_modes"), ("$.requested_modes", "bpb", "$.requested_modes"), ("$.completed_modes", ["bpb"], "$.completed_modes"),
    ("$.core", [], "$.core"), ("$.samples", "DROP", "$.samples"), ("$.bounded", 1, "$.bounded"), ("$.run_kind", "bounded", "$.run_kind"), ("$.max_per_task", 3, "$.max_per_task"),
    ("$.identities.more", 1, "$.identities"), ("$.identities.checkpoint", None, "$.identities.checkpoint"), ("$.identities.checkpoint.identity", " ", "$.identities.checkpoint.identity"), ("$.identities.checkpoint.step", -1, "$.identities.checkpoint.step"), ("$.identities.config", 3, "$.identities.config"), ("$.identities.tokenizer", "", "$.identities.tokenizer"), ("$.identities.validation_manifest", None, "$.identities.validation_manifest"),
    ("$.results.other", {}, "$.results"), (R, [], R), (R + ".bpb", "DROP", R), (R + ".protocol_id", "x", R + ".protocol_id"), (R + ".protocol_version", 0, R + ".protocol_version"), (R + ".reference_commit", 5, R + ".reference_commit"), (R + ".reference_config", None, R + ".reference_config"),
    (R + ".source_documents", 0, R + ".source_documents"), (R + ".source_tokens", 1.5, R + ".source_tokens"), (R + ".counted_target_bytes", 0, R + ".counted_target_bytes"), (R + ".unique_source_tokens", 41, R + ".unique_source_tokens"), (R + ".unique_source_bytes", 81, R + ".unique_source_bytes"), (R + ".source_token_retention", 1.2, R + ".source_token_retention"), (R + ".source_byte_retention", 0.7, R + ".source_byte_retention"),
    (R + ".total_nats", -1, R + ".total_nats"), (R + ".total_nats", True, R + ".total_nats"), (R + ".bpb", 2.0, R + ".bpb"), (R + ".checkpoint_identity", "other", R + ".checkpoint_identity"), (R + ".tokenizer_identity", "other", R + ".tokenizer_identity"), (R + ".validation_manifest_identity", "other", R + ".validation_manifest_identity"),
]
SUMMARIES = [
    ("$.run", None, "$.run"), ("$.run.stage", "", "$.run.stage"), ("$.run.more", 1, "$.run"), ("$.schema_version", 2, "$.schema_version"), ("$.schema_version", True, "$.schema_version"), ("$.status", "done", "$.status"), ("$.latest_step", -1, "$.latest_step"), ("$.latest_step", True, "$.latest_step"), ("$.latest_step", "7", "$.latest_step"), ("$.latest_metrics", [], "$.latest_metrics"), ("$.latest_metrics", {"a": [1]}, "$.latest_metrics"), ("$.latest_metrics", {"a": {}}, "$.latest_metrics"), ("$.status", "DROP", "$"),
]


@pytest.mark.parametrize("kind", ["evaluation", "summary"])
def test_planted_faults_are_named(spark, kind):
    doc, planted, rules = (evaluation(), EVALUATION, documents.evaluation_rules(FORMAT)) if kind == "evaluation" else (summary(), SUMMARIES, documents.SUMMARY)
    got = faults(spark, [changed(doc, p, v) for p, v, _ in planted], rules)
    # JSON doesn't tell 2.0 from 2 where a parser keeps it as a decimal; what counts is that no other value passes
    assert [(p, v, x and x[0]) for (p, v, _), x in zip(planted, got, strict=True) if v != 2.0] == [x for x in planted if x[1] != 2.0]
    assert faults(spark, ["", "{", "[]", '{"a": 1, "a": 2}', '{"a": NaN}', "null"], rules) == [("$", "must be JSON without repeated keys")] * 2 + [("$", rules[0].reason)] + [("$", "must be JSON without repeated keys")] * 2 + [("$", rules[0].reason)]


def test_bounded_and_other_modes(spark):
    rules = documents.evaluation_rules(FORMAT)
    bad = [changed(evaluation(bounded=True), "$.max_per_task", None), changed(evaluation(modes=("core",)), "$.identities.validation_manifest", "m"), changed(evaluation(modes=("core",)), "$.results", {"x": 1}), changed(evaluation(modes=("bpb",)), "$.core", {})]
    assert [x[0] for x in faults(spark, bad, rules)] == ["$.max_per_task", "$.identities.validation_manifest", "$.results", "$.core"]


def test_snapshots(spark):
    text = lambda d: None if d is None else json.dumps(d)
    rows = [("r1", "/runs/r1/", summary(), evaluation(3)), ("r2", "/runs/r2", summary("r2", "/runs/r2"), None), ("r3", "/runs/r3", summary("other", "/runs/r3"), None), ("r4", "/runs/r4", summary("r4", "/elsewhere"), None), ("r5", "/runs/r5", summary("r5", "/runs/r5") | {"latest_step": 6}, None), ("r6", "/runs/r6", summary("r6", "/runs/r6"), changed(evaluation(), "$.status", "failed")), ("r7", "/a", summary("r7", "/a"), None), ("r7", "/b", summary("r7", "/b"), None)]
    runs = spark.createDataFrame([(n, d, text(s), text(e)) for n, d, s, e in rows], "run string, run_dir string, summary string, evaluation string")
    log = spark.createDataFrame([(f"r{i}", s) for i in range(1, 8) for s in (1, 7)], "run string, step long")
    got = sorted((r.run, r.fault) for r in documents.snapshots(runs, log, FORMAT).collect() if r.fault)
    assert got == [("r3", "summary $.run.name must be the configured name"), ("r4", "summary $.run.output_dir must be the run's directory"), ("r5", "summary $.latest_step must be the log's last step"), ("r6", "evaluation $.status must be one of completed"), ("r7", "the name isn't unique"), ("r7", "the name isn't unique")]
