"""Streams that keep state or offsets: stopped anywhere and started again, they give what one run gives."""

import json
import random

import pytest

from tessera.operators import row_packing
from tessera.sources import metric_logs
from tessera.streaming import packing, sinks

EVENTS = "event_id string, name string, value double"


def events(spark, at, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(at))


def once(spark, tmp_path):
    log = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    sinks.appended_once(log, str(tmp_path / "out"), str(tmp_path / "state"), buckets=4).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("event_id", "name", "value").collect()))


def test_events_are_appended_once(spark, tmp_path):
    rows = [(f"e{i}", "loss", float(i)) for i in range(20)] + [("n", None, None)]
    events(spark, tmp_path / "in", rows[:12] + rows[:3])
    assert once(spark, tmp_path) == sorted(rows[:12])
    assert once(spark, tmp_path) == sorted(rows[:12])  # nothing new
    events(spark, tmp_path / "in", rows[5:] + [rows[-1]])  # a replay with new events
    assert once(spark, tmp_path) == sorted(rows, key=lambda r: r[0])
    events(spark, tmp_path / "in", rows)
    assert once(spark, tmp_path) == sorted(rows, key=lambda r: r[0])
    events(spark, tmp_path / "in", [("e3", "loss", 99.0)])
    with pytest.raises(Exception, match="conflicting event e3"):
        once(spark, tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 21


def test_nulls_conflict_with_values(spark, tmp_path):
    events(spark, tmp_path / "in", [("a", None, 1.0)])
    once(spark, tmp_path)
    events(spark, tmp_path / "in", [("a", "x", 1.0)])
    with pytest.raises(Exception, match="conflicting event a"):
        once(spark, tmp_path)


@pytest.mark.parametrize("seed", range(30))
def test_packer_goes_on_from_any_state(seed):
    r = random.Random(seed)
    length, least = r.randint(3, 30), r.randint(1, 8)
    items = [(i, r.randint(1, length + 5)) for i in range(r.randint(0, 60))]
    want = list(row_packing.conversation_rows(items, length, least))
    packer, got = row_packing.ConversationPacker(length, least), []
    for i, x in enumerate(items):
        got += packer.feed(*x, last=i == len(items) - 1)
        packer = row_packing.ConversationPacker.resumed(packer.state())
    assert got == want and sorted(c for _, _, c, _ in want) == list(range(len(items)))


def test_states_that_do_not_fit_raise():
    packer = row_packing.ConversationPacker(5, 3)
    list(packer.feed(1, 2))
    for change in ({"left": 9}, {"taken": 0}, {"buffer": [[1, 2]] * 4, "taken": 4}, {"extra": 1}):
        with pytest.raises(ValueError):
            row_packing.ConversationPacker.resumed(json.dumps(json.loads(packer.state()) | change))


ITEMS = "split string, position long, conv_id long, tokens long, last boolean"


def test_packing_stream_restarts(spark, tmp_path):
    r = random.Random(3)
    items = {s: [(i, r.randint(1, 25)) for i in range(40)] for s in ("a", "b")}
    rows = [(s, i, c, n, i == 39) for s, own in items.items() for i, (c, n) in enumerate(own)]
    got = []
    # pieces of both splits, the second with positions that were there before
    for part in (lambda i: i < 7, lambda i: 3 <= i < 20, lambda i: i >= 20):
        spark.createDataFrame([x for x in rows if part(x[1])], ITEMS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = packing.packed(spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in")), 30, 5)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        got.append(spark.read.parquet(str(tmp_path / "out")).count())
    found = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("split", "row", "slot", "conv_id", "n_tokens").collect()))
    assert found == sorted((s, *x) for s, own in items.items() for x in row_packing.conversation_rows(own, 30, 5)) and got[0] < got[1] < got[2]


def test_a_gap_in_positions_stops_the_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1, 1, False)], ITEMS).write.parquet(str(tmp_path / "in"))
    q = packing.packed(spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in")), 30, 5).writeStream.format("memory").queryName("gap").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="position 0 of a is missing"):
        q.awaitTermination()


CONFIG = json.dumps({"record_type": "config", "config": {"run": {"name": "x"}}}) + "\n"


def line(step, **metrics):
    return json.dumps({"record_type": "metrics", "step": step, "event_id": f"e{step}", "metrics": metrics}) + "\n"


def drained(spark, at, name, checkpoint, out):
    metric_logs.register(spark)
    stream = spark.readStream.format("metric_logs").load(str(at))
    stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.parquet(str(out)))


def rows(df):
    return sorted(map(tuple, df.select("run_dir", "at", "event_id", "step", "name", "value", "text").collect()), key=str)


def test_growing_logs(spark, tmp_path):
    logs, (a, b) = tmp_path / "logs", (tmp_path / "logs" / "run_a", tmp_path / "logs" / "run_b")
    a.mkdir(parents=True)
    whole = CONFIG + line(1, loss=2.5, note="ok") + line(1, lr=None) + json.dumps({"record_type": "artifact", "name": "m", "path": "p", "type": "t"}) + "\n" + line(4, loss=True)
    (a / "metrics.jsonl").write_text(whole[: len(CONFIG) + 30])  # half a line
    step = lambda: drained(spark, logs, "x", tmp_path / "state", tmp_path / "out")
    assert step() == []
    (a / "metrics.jsonl").write_text(whole[:-5])
    assert {r[3:] for r in step()} == {(1, "loss", 2.5, None), (1, "note", None, "ok"), (1, "lr", None, None)}
    b.mkdir()
    (b / "metrics.jsonl").write_text(CONFIG + line(9, loss=1))
    (a / "metrics.jsonl").write_text(whole)
    got = step()
    assert {r[0] for r in got} == {"run_a", "run_b"} and len(got) == 5 and ("run_a", "e4", 4, "loss", 1.0) in {(r[0], *r[2:6]) for r in got}
    assert got == step() == rows(spark.read.format("metric_logs").load(str(logs)))


@pytest.mark.parametrize("text,why", [(line(1, loss=1.0), "configuration comes first"), (CONFIG + CONFIG, "configuration comes first"), (CONFIG + line(3, a=1) + line(2, a=1), "move backwards from 3 to 2"), (CONFIG + '{"record_type": "other"}\n', "unknown record"), (CONFIG + line(1, a=[1]), "not a scalar"), (CONFIG + line(1).replace("{}", '{"a": NaN}'), "NaN"), (CONFIG + line(-1, a=1), "whole number"), (CONFIG + line(1).replace('"e1"', '" "'), "event_id"), (CONFIG + '{"record_type": "metrics", "record_type": "metrics", "metrics": {}}\n', "duplicate key")])
def test_faults_stop_the_query(spark, tmp_path, text, why):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "metrics.jsonl").write_text(text)
    metric_logs.register(spark)
    with pytest.raises(Exception, match=why):
        spark.read.format("metric_logs").load(str(tmp_path)).collect()


def test_steps_are_checked_over_spans_and_long_lines_stay_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(metric_logs, "TASK", 100)
    monkeypatch.setattr(metric_logs, "CHUNK", 13)
    (tmp_path / "r").mkdir()
    path = str(tmp_path / "r" / "metrics.jsonl")
    text = CONFIG + "".join(line(i, loss=float(i), note="y" * (300 * (i == 5))) for i in range(12))
    (tmp_path / "r" / "metrics.jsonl").write_text(text)
    parts = list(metric_logs.spans(path, 0, len(text)))
    assert len(parts) > 5 and [p.start for p in parts[1:]] == [p.end for p in parts[:-1]] and all(text[p.end - 1] == "\n" for p in parts)
    assert [r[3] for p in parts for r in metric_logs.read_span(p) if r[4] == "loss"] == list(range(12))
    (tmp_path / "r" / "metrics.jsonl").write_text(text + line(3, loss=1.0))
    last = list(metric_logs.spans(path, len(text), len(text) + len(line(3, loss=1.0))))
    with pytest.raises(ValueError, match="backwards from 11 to 3"):
        list(metric_logs.read_span(last[-1]))


def test_lines_longer_than_tasks_and_chunks(tmp_path, monkeypatch):
    """A line of several tasks' bytes ends the division and is read whole, wherever it stands."""
    monkeypatch.setattr(metric_logs, "TASK", 64)
    monkeypatch.setattr(metric_logs, "CHUNK", 7)
    path = tmp_path / "r" / "metrics.jsonl"
    path.parent.mkdir()
    for long in ({0}, {2}, {5}, {1, 2, 5}):
        text = CONFIG + "".join(line(i, loss=float(i), note="y" * (1000 * (i in long))) for i in range(6))
        path.write_text(text)
        parts = list(metric_logs.spans(str(path), 0, len(text)))
        assert [parts[0].start, *(p.end for p in parts)] == [*(p.start for p in parts), len(text)]
        assert all(text[p.end - 1] == "\n" and (p.end - p.start <= 64 or text[p.start : p.end].count("\n") == 1) for p in parts)
        rows = [r for p in parts for r in metric_logs.read_span(p)]
        assert [r[5] for r in rows if r[4] == "loss"] == list(range(6))
        assert [len(r[6]) for r in rows if r[4] == "note"] == [1000 * (i in long) for i in range(6)]
        with open(path, "rb") as f:
            assert list(metric_logs._lines_back(f, len(text))) == text.encode().splitlines()[::-1]
