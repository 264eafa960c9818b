"""Batches by row group against reading groups one by one."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.sources import row_groups


@pytest.fixture
def path(tmp_path):
    """Two files with uneven groups, an empty group among them, whose rows aren't sorted."""
    at = tmp_path / "shards"
    at.mkdir()
    for name, sizes in (("a.parquet", [5, 1, 300, 128, 2]), ("b c.parquet", [129])):
        with pq.ParquetWriter(str(at / name), pa.schema([("text", pa.string()), ("n", pa.int64())])) as w:
            for g, n in enumerate(sizes):
                w.write_table(pa.table({"text": [f"{name} {g} {i * 7919 % 1000}" for i in range(n)], "n": pa.array(range(n), pa.int64())}), row_group_size=max(n, 1))
    return str(at)


def wanted(path, size):
    out = set()
    for name in ("a.parquet", "b c.parquet"):
        file, at = pq.ParquetFile(f"{path}/{name}"), 0
        for g in range(file.num_row_groups):
            for i, text in enumerate(file.read_row_group(g)["text"].to_pylist()):
                out.add((name, text, at, g, i // size, i % size))
                at += 1
    return out


@pytest.mark.parametrize("size", [1, 100, 128])
def test_batches_end_with_their_group(spark, path, size):
    got = row_groups.text_batches(spark, path, size=size).collect()
    assert {(r.file.split("/")[-1].replace("%20", " "), r.text, r.row_index, r.row_group, r.batch, r.row) for r in got} == wanted(path, size) and len(got) == len(wanted(path, size))


def test_footers_through_hadoop(spark, path, monkeypatch):
    rows = lambda: sorted((r.file, list(r.starts), r.n_rows) for r in row_groups.footers(spark, path).collect())
    by_workers = rows()
    monkeypatch.setattr(row_groups, "ARROW", ())
    assert rows() == by_workers and [r[2] for r in by_workers] == [436, 129]


def test_faults(spark, tmp_path):
    pq.write_table(pa.table({"text": ["a", None], "n": [1, 2]}), str(tmp_path / "x.parquet"))
    with pytest.raises(Exception, match="null text in .*x.parquet, row group 0"):
        row_groups.text_batches(spark, str(tmp_path)).collect()
    for column in ("n", "other"):
        with pytest.raises(ValueError, match="expected one text column"):
            row_groups.text_batches(spark, str(tmp_path), column)
