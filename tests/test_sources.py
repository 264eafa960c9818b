"""Sources, adapters and streams on small inputs."""

import io
import json
import zipfile

import pytest

from tessera.functions import adapters, identity
from tessera.functions import text as T
from tessera.operators import budget, shard_ops, stats
from tessera.sources import bundles, cache, jsonl, shards

GOOD = {"schema_version": 1, "messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "python", "text": "1"}]}]}


@pytest.mark.parametrize("line, error", [
    (json.dumps(GOOD), None), ('{"schema_version":1,"schema_version":1,"messages":[]}', "duplicate key"), ('{"schema_version":true,"messages":[1]}', "schema_version"), ("", "empty"),
    ('{"schema_version":1,"messages":[{"role":"assistant","content":"x"}]}', "alternate"), ('{"schema_version":NaN,"messages":[1]}', "NaN"), ("{", "not JSON"), ('{"schema_version":1}', "lacks"),
])
def test_strict_lines(spark, line, error):
    row = jsonl.parsed(spark.createDataFrame([(0, line)], "line long, value string")).first()
    assert (row.error is None) if error is None else error in row.error


def test_conversations_round_trip(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text(jsonl.canonical(GOOD) + "\n")
    read = jsonl.read_conversations(spark, str(tmp_path))
    assert jsonl.strict_json(jsonl.written_as(read).first().value) == GOOD


def test_budget_cuts_the_last_document(spark):
    docs = spark.createDataFrame([("t", 0, i, t) for i, t in enumerate(["éé", "", "abcdef", "not observed"])], "split string, shard_index int, doc_id long, text string")
    row = budget.bounded_prefix(docs, 3, 3, 2).agg(*stats.text_measures()).first()
    assert tuple(row) == (3, 3, 5)


def test_statistics_of_shards(spark):
    shards_ = {3: ["Rain all day", "", "Größe: 12 µm", "ネコ"], 4: ["x"], 40: ["tail 🐈", ""]}
    docs = spark.createDataFrame([(i, t) for i, own in shards_.items() for t in own], "shard_index int, text string")
    docs = docs.withColumn("split", shards.split_of(docs.shard_index, 40))
    got = {r.split: tuple(r)[1:] for r in stats.stats_by_split(docs).collect()}
    count = lambda *own: (len(own), sum(map(len, own)), sum(len(t.encode()) for t in own))
    assert got == {"train": count(*shards_[3], *shards_[4]), "val": count(*shards_[40]), "total": count(*(t for own in shards_.values() for t in own))}


def test_shard_plan_errors(spark):
    with pytest.raises(ValueError):
        shard_ops.shard_plan(spark, 5, 3)
    with pytest.raises(ValueError):
        shard_ops.shard_plan(spark, 0, None)


def test_cache(spark, tmp_path):
    for name in ("shard_1.parquet", "shard_12.parquet", "other.txt"):
        (tmp_path / name).write_bytes(name.encode())
    assert [r.shard_index for r in cache.listed(spark, str(tmp_path)).orderBy("shard_index").collect()] == [1, 12]
    there = cache.identities(spark, str(tmp_path))
    manifest = spark.createDataFrame([*there.where("file_name != 'other.txt'").collect(), ("gone", 1, "sha256:0")], there.schema)
    assert {tuple(r) for r in cache.faults(there, manifest).collect()} == {("other.txt", "unexpected"), ("gone", "missing")}
    (tmp_path / "shard_01.parquet").write_bytes(b"x")
    with pytest.raises(Exception, match="several files"):
        cache.listed(spark, str(tmp_path)).collect()


def test_text_column(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    with pytest.raises(Exception, match="null text"):
        cache.text_column(df).collect()
    with pytest.raises(ValueError):
        cache.text_column(df.selectExpr("*", "t as u"))


def test_bundle():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("b.csv", "Eval Task,Random baseline\nx,25\ny,0\n")
        z.writestr("r.csv", "Task, Accuracy, Centered\nx, 0.5, 0.3\nCORE, , 0.3\n")
        z.writestr("t.jsonl", '{"context":"a","continuation":"b"}\n')
    b = bundles.Bundle(raw.getvalue())
    assert b.baselines("b.csv") == {"x": 0.25, "y": 0.0} and b.references("r.csv")[-1][2] == 0.3 and b.examples("t.jsonl", "language_modeling")[0]["context"] == "a"
    with pytest.raises(bundles.Invalid):
        bundles.Bundle(raw.getvalue(), "0" * 64)
    assert not bundles.safe_path("../x") and not bundles.safe_path("/x") and bundles.safe_path("a/b.csv")


def test_adapters(spark):
    assert [p["type"] for p in adapters.answer_parts("a <<1+1=2>> b")] == ["text", "python", "python_output", "text"]
    for bad in ("a >> b", "<<1+1>>", "<<=2>>", "<<1=2", "<<a<b=2>>"):
        with pytest.raises(adapters.Invalid):
            adapters.answer_parts(bad)
    assert adapters.program_of("x\n```js\n1\n```\n```python\ny = 1\n```\n") == "y = 1" and adapters.program_of(" z ") == "z" and adapters.program_of("```\nopen") == "```\nopen"
    got = spark.createDataFrame([("# c\n\nimport os\n  from a import b\nx = 1\nimport no\n",)], "p string")
    assert got.select(adapters.leading_imports(got.p)).first()[0] == "import os\nfrom a import b"
    d = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("```json\n{}\n```",), (None,)], "t string")
    rows = [r.x for r in d.select(adapters.json_diagnosis(d.t).alias("x")).collect()]
    assert rows[0].valid and not rows[0].violation and not rows[1].valid and rows[2].fenced_valid and rows[3] is None
    m = spark.createDataFrame([("q", ["a", "b", "c", "d"], 2, "s"), ("q", ["a"], 0, "s")], "question string, choices array<string>, answer int, subject string")
    assert [(r.answer, r.error) for r in adapters.mmlu(m).collect()] == [("C", None), (None, "malformed row")]
    a = spark.createDataFrame([("q", (["A", "B"], ["x", "y"]), "B"), ("q", (["A", "A"], ["x", "y"]), "A")], "question string, choices struct<label:array<string>,text:array<string>>, answerKey string")
    assert [r.answer for r in adapters.arc(a).collect()] == ["B", None]
    h = spark.createDataFrame([("import os\ndef f():", "pass", "assert f", "f"), ("p", "c", "t", "1f")], "prompt string, canonical_solution string, test string, entry_point string")
    assert [(r.imports, r.error) for r in adapters.humaneval(h).collect()] == [("import os", None), ("", "malformed row")]


@pytest.mark.parametrize("text, answer", [("#### 1,234.50", "1234.50"), ("#### -2.75", "-2.75"), ("#### 1 #### 2", "1"), ("none", None), ("####  3", None)])
def test_answers(spark, text, answer):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(T.gsm8k_answer(df.t)).first()[0] == answer


def test_units(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (999_999,), (2_500_000,)], "n long")
    assert [tuple(r) for r in df.select(T.format_bytes(df.n), T.format_count(df.n)).collect()] == [("0 B", "0"), ("1023 B", "1.02K"), ("1.50 KiB", "1.54K"), ("976.56 KiB", "1.00M"), ("2.38 MiB", "2.50M")]


def test_identities(spark):
    df = spark.createDataFrame([("é\"/\n", 3)], "s string, n long")
    assert df.select(identity.row_identity(z=df.s, a=df.n)).first()[0] == identity.identity({"z": "é\"/\n", "a": 3})
    assert 0 <= identity.seed_of([1, 2]) < 1 << 63


def test_finite_source(spark):
    from tessera.sources.finite import ConversationSource

    spark.dataSource.register(ConversationSource)
    records = [[["user", "a"], ["assistant", "b"]], [["user", "c"]], [["user", "d"]]]
    got = spark.read.format("tessera_conversations").option("records", json.dumps(records)).option("slices", "2").load()
    assert sorted((r.conv_id, r.turn, r.text) for r in got.collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c"), (2, 0, "d")]
