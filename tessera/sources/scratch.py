"""Tables that iterative jobs write between rounds, in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, as in notebooks, a temporary folder, for local sessions only."""
    if at := spark.conf.get(CONF, None):
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError(f"set {CONF} to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own[app]


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Kept:
    """A table on disk that rounds replace; the one before goes once the new one is written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base, self.path = spark, f"{shared_dir(spark)}/tessera/{name}", None

    def added(self, df: DataFrame) -> DataFrame:
        """Written and read again; stays until the folder is cleared, for results that are read later."""
        path = f"{self.base}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def replaced(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.dropped()
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)

    def dropped(self) -> None:
        if self.path:
            delete(self.spark, self.path)
            self.path = None


@contextmanager
def kept(spark: SparkSession, name: str) -> Iterator[Kept]:
    """A ``Kept`` that is deleted at the end."""
    table = Kept(spark, name)
    try:
        yield table
    finally:
        table.dropped()
