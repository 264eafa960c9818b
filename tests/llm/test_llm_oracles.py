"""Queries with SQL give what DuckDB gives, on the smallest tables and on planted rows."""

import os
import random

import duckdb
import numpy as np
import pytest

from tessera.llm import queries, shingles, vectors

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


def same(df, duck, sql):
    columns = sorted(df.columns)
    cursor = duck.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)
    return got


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_given_tables(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    assert same(queries.QUERIES[name](spark, DATA), duck, queries.ORACLES[name])


def test_planted_documents(spark, tmp_path):
    r = random.Random(3)
    texts = [None, "", " \t", "One two", "one  TWO", "a b c d e", "A\x0bb c d e", "é É x y z"]
    for _ in range(12):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(30, 90))]
        texts += [" ".join(w), " ".join(w).upper(), " ".join(w[:-1] + ["other"]), " ".join(w[: len(w) // 2])]
        for _ in range(3):  # chains of copies that are ever further from the first
            w[r.randrange(len(w))] = "new"
            texts.append("\n".join(w))
    spark.createDataFrame(list(enumerate(texts, 7)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = same(shingles.op3(spark, str(tmp_path)), duck, shingles.ORACLE)
    assert len({g[0] for g in got}) < len(texts) - 20


def test_planted_vectors(spark, tmp_path):
    r = np.random.default_rng(4)
    base = r.normal(size=(40, 16))
    near = base + r.normal(size=base.shape) * r.uniform(0.05, 0.6, (40, 1))
    rows = [v.tolist() for v in np.concatenate([base, near, base[:9], 3 * base[:5]]).astype("f4")] + [None, [], [0.0] * 16, [1.0, float("nan")], [float("inf")] * 16, [1.0, None], [2.0, 0.0], [1.0, 0.1]] + [None] * 30
    spark.createDataFrame([(i * 3, v) for i, v in enumerate(rows)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    got = same(vectors.op4(spark, str(tmp_path)), duck, vectors.ORACLE)
    assert any(n > 1 for *_, n, _ in got)
