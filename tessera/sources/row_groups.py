"""Rows in the order of their Parquet files, and batches that end with each row group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stores whose footers workers can read by themselves; those of others are read through Hadoop's by the driver.
ARROW = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
FOOTERS = "file string, starts array<long>, n_rows long"


def plain(uri: Column) -> Column:
    """A file's name in one form: Spark writes one or three slashes behind a scheme without a host."""
    return F.regexp_replace(uri, "^([a-z0-9]+):///", "$1:/")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """``file, starts, n_rows``: of each Parquet file the number of the first row of each group. Only footers are read, by workers."""
    files = spark.read.parquet(path).inputFiles()  # Spark lists them on the driver, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for b in batches:
            for file in b["file"].to_pylist():
                store, at = fs.FileSystem.from_uri(file)
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                yield _row(file, [meta.row_group(i).num_rows for i in range(meta.num_row_groups)])

    if all(f.split(":", 1)[0] in ARROW for f in files):
        own = spark.createDataFrame([(f,) for f in files], "file string")
        return own.repartition(max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, FOOTERS)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    rows = []
    for file in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)), conf))
        try:
            rows += _row(file, [g.getRowCount() for g in reader.getRowGroups()]).to_pylist()
        finally:
            reader.close()
    return spark.createDataFrame([(r["file"], r["starts"], r["n_rows"]) for r in rows], FOOTERS)


def _row(file: str, sizes: list[int]) -> pa.RecordBatch:
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([starts], pa.list_(pa.int64())), pa.array([sum(sizes)], pa.int64())], ["file", "starts", "n_rows"])


def batches(spark: SparkSession, path: str, size: int, *columns: str) -> DataFrame:
    """``columns`` of all rows with ``file, row_index, row_group, batch`` (within the group) and ``row`` (within the batch).

    A batch has ``size`` rows, fewer where its row group ends. Row numbers are those that the reader gives, so no row is sorted or counted; a row a file is broadcast, and Spark
    lists files on the driver anyway.
    """
    rows = spark.read.parquet(path).select(*columns, plain(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.row_index").alias("row_index"))
    found = rows.join(F.broadcast(footers(spark, path).select(plain(F.col("file")).alias("file"), "starts")), "file")
    group = F.size(F.filter("starts", lambda s: s <= F.col("row_index"))) - 1
    placed = found.withColumn("row_group", group).withColumn("_in", F.col("row_index") - F.get("starts", F.col("row_group")))
    return placed.select(*columns, "file", "row_index", "row_group", F.floor(F.col("_in") / size).cast("long").alias("batch"), F.pmod("_in", F.lit(size)).alias("row"))


def text_batches(spark: SparkSession, path: str, column: str = "text", size: int = 128) -> DataFrame:
    """``batches`` of the one text column; a null text raises when it is read, with its file and row group."""
    fields = [f for f in spark.read.parquet(path).schema if f.name == column]
    if len(fields) != 1 or fields[0].dataType.simpleString() != "string":
        raise ValueError(f"expected one text column {column}")
    out = batches(spark, path, size, column)
    why = F.concat(F.lit("null text in "), "file", F.lit(", row group "), F.col("row_group").cast("string"))
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(why)))
