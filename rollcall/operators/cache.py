"""Tables pinned in columnar memory.

How tables are pinned and looked at is this library's own choice. Spark's own cache is the columnar store: scans of it read only the needed columns
and skip batches by their statistics, and blocks lost with an executor are built
again from their lineage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.sources.workspace import new_folder


def cached(
    df: DataFrame,
    columns: list[str] | None = None,
    level: StorageLevel = StorageLevel.MEMORY_AND_DISK,
) -> DataFrame:
    """Pin the chosen columns (all by default); what does not fit goes to disk.

    Spark finds pinned tables by their plan. A condition that always holds sets the plans of
    two pins of one table apart, so that releasing one leaves the other.
    """
    own = F.lit(uuid.uuid4().hex).isNotNull()
    return df.select(*(columns or df.columns)).where(own).persist(level)


def release(df: DataFrame) -> DataFrame:
    """Drop a pinned table; later queries go back to its source."""
    return df.unpersist(blocking=True)


def on_pinned(
    df: DataFrame, columns: list[str] | None, queries: list[Callable[[DataFrame], DataFrame]]
) -> DataFrame:
    """The rows of all queries (of one schema) over one pin, which is released after the last.

    The results are written to the job's folder, as the pin is gone when they are read.
    """
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "pinned")
    pinned = cached(df, columns)
    try:
        for number, query in enumerate(queries):
            query(pinned).write.parquet(f"{folder}/query={number}")
    finally:
        release(pinned)
    return spark.read.parquet(*[f"{folder}/query={number}" for number in range(len(queries))])


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows of each partition that has any."""
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def partition_footprint(df: DataFrame) -> DataFrame:
    """One row: partitions with rows, rows in all, in the largest, and largest / mean."""
    return (
        partition_rows(df)
        .agg(
            F.count(F.lit(1)).alias("partitions"),
            F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("rows"),
            F.coalesce(F.max("rows"), F.lit(0)).alias("largest"),
            F.avg("rows").alias("mean"),
        )
        .withColumn("skew", F.col("largest") / F.col("mean"))
    )
