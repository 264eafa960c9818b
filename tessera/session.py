"""Spark sessions with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
#: For stateful processors.
STREAMING = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session; settings with dots go in as a dictionary, ``session(**{"spark.x": "y"})``."""
    builder = SparkSession.builder.config(map=SETTINGS | STREAMING | settings)
    return (builder.master(master) if master else builder).getOrCreate()
