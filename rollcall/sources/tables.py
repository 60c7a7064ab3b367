"""Parquet tables, as batch or as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``<folder>/<name>.parquet`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def table_stream(
    spark: SparkSession,
    folder: str,
    name: str,
    max_bytes_per_trigger: int = 4 << 30,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Read the same table as a file stream.

    The limits bound a micro-batch; every file is read. The jobs in ``rollcall.streaming`` give
    the same answers however rows are cut into micro-batches.
    """
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    else:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    # A file stream takes a plain path for a directory only; as a pattern it may be
    # either a directory or a single file.
    return reader.parquet(f"{folder}/{{{name}.parquet}}")
