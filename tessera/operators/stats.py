"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_measures(text: str = "text") -> list[Column]:
    """Documents, code points and UTF-8 bytes; empty texts are documents."""
    return [
        F.count(F.lit(1)).alias("documents"),
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("long").alias("characters"),
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).cast("long").alias("utf8_bytes"),
    ]


def stats_by_split(docs: DataFrame) -> DataFrame:
    """A row for each split and one for the total, in one pass."""
    return docs.select("split", "text").rollup("split").agg(*text_measures()).withColumn("split", F.coalesce("split", F.lit("total")))
