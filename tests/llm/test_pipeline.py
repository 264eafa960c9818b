"""The pipeline: each stage's decisions take effect on what the stage before kept."""

import os
import random

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from pyspark import SparkContext  # noqa: E402
from pyspark.sql import DataFrameWriter  # noqa: E402
from tessera.llm import pii, queries, quality, shingles  # noqa: E402
from tessera.llm.common import BATCH  # noqa: E402

DATA = os.environ.get("TESSERA_TEST_DATA", "/root/testdata/sf0.001")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "pii", "packing"]
    kept = corpus_pipeline.classify(spark, docs, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.classified(docs, labels).where("keep").collect()}
    alone = corpus_pipeline.deduplicate(spark, kept, DATA)
    assert sorted(r.doc_id for r in alone.collect()) == sorted({r.component_id for r in shingles.near_duplicates(kept).collect()})
    masked = corpus_pipeline.mask(spark, alone, DATA)
    assert masked.columns == docs.columns and masked.dtypes == docs.dtypes
    rows = masked.collect()
    assert len(rows) == alone.count() and all(r.n_chars == len(r.text) and not any(pii.base_spans(r.text).values()) for r in rows)
    packed = corpus_pipeline.pack(spark, masked, DATA).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}


def test_run_and_edges(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["the", "and", "thing", "other"]) for _ in range(30)), "en", "s", 1) for i in range(40)] + [(None, None, None, None, None), (50, "", "en", "s", 0), (51, "mail a@b.cd now", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} >= {None, 50} and max(x.offset + x.length for x in got) <= 2048


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    """Executors hold a batch of texts twice while they make it, and keep each kind of worker that ever ran: no stage sends whole partitions or starts workers of RDDs."""
    at, write, seen = f"{DATA}/documents.parquet", DataFrameWriter.parquet, {}

    def noted(self, path, *args, **kwargs):
        seen[path.rpartition("/")[2].rpartition("-")[0]] = spark.conf.get(BATCH, None)
        return write(self, path, *args, **kwargs)

    def no_rows(*_, **__):
        raise AssertionError("rows of the driver dealt out by workers of RDDs")

    before = spark.conf.get(BATCH, None)
    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    monkeypatch.setattr(SparkContext, "parallelize", no_rows)
    assert corpus_pipeline.run(spark, DATA).count() >= spark.read.parquet(at).count() // 2
    assert {n: seen.get(n) for n in ("kn_scores", "pii", "masked", "pieces")} == {"kn_scores": "1000", "pii": "1000", "masked": "1000", "pieces": "200"}
    assert spark.conf.get(BATCH, None) == before


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
