"""Corpus pipeline: quality classifier, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept; all but
the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet in
the shared folder and reads it back, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, pii, quality, shingles
from tessera.llm.common import ROWS, table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.filtered(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id."""
    return shingles.deduplicated(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data masked in the texts; ``n_chars`` follows the text."""
    masked = written(pii.redacted(docs), "masked", rows=ROWS)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row a piece."""
    import public_tokenizers

    # small groups: executors still hold what earlier stages took
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), rows=200, chars=200_000)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("pii", mask), ("packing", pack)]
#: The stages are models and tokenizers; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
