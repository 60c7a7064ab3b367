"""Report jobs: a large group-by or window, then readable text on its few rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollcall.functions.clock import epoch_micros
from rollcall.functions.text import (
    duration_text,
    duration_text_verbose,
    magnitude_text,
    progress_label,
    stamp_text,
)
from rollcall.plans.skew import CELL, CELLS, previous_value, split_hot

COMPLETED, STARTED, FAILED, SKIPPED = "completed", "started", "failed", "skipped"


def _div(value: Column, by: int | Column) -> Column:
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def _middle_ranks(gaps: Column) -> tuple[Column, Column]:
    """The two ranks whose mean is the median; equal for an odd count."""
    return _div(gaps + 1, 2), _div(gaps, 2) + 1


def _with_gap(rows: DataFrame, ts: str) -> DataFrame:
    silence = epoch_micros(rows, ts) - epoch_micros(rows, "_previous")
    return rows.withColumn("_gap", _div(silence, 1000))


def _ordinary_gaps(rows: DataFrame, key: str) -> DataFrame:
    """Statistics by ranking each key's gaps; reuses the shuffle of the gap window."""
    whole = Window.partitionBy(key)
    ranked = rows.withColumn("_gaps", F.count("_gap").over(whole)).withColumn(
        "_rank", F.row_number().over(whole.orderBy(F.col("_gap").asc_nulls_last()))
    )
    low, high = _middle_ranks(F.col("_gaps"))
    return ranked.groupBy(key).agg(
        F.count("_gap").alias("gaps"),
        F.min("_gap").alias("min_ms"),
        F.max("_gap").alias("max_ms"),
        F.max(F.when(F.col("_rank") == low, F.col("_gap"))).alias("_low"),
        F.max(F.when(F.col("_rank") == high, F.col("_gap"))).alias("_high"),
    )


def _hot_gaps(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The same for hot keys, without ever ordering one key's gaps in one task.

    ``rows`` has one row per key and instant, ``_rows`` of them at that instant, with
    the gap to the instant before. Gaps are counted by value, values are counted by
    range, the ranges holding the two middle ranks are found from the counts, and only
    those are ordered. There is one total and at most two ranges per hot key, so both
    broadcasts are bounded by the length of the hot list.
    """
    # Each instant brings one gap to the one before, if any, and rows - 1 gaps of 0. Rows
    # without a time have no gap.
    times = F.array(
        F.struct(F.col("_gap"), F.col("_gap").isNotNull().cast("bigint").alias("_times")),
        F.struct(
            F.lit(0).cast("bigint").alias("_gap"),
            F.when(F.col(ts).isNotNull(), F.col("_rows") - 1).otherwise(0).alias("_times"),
        ),
    )
    counted = rows.select(key, F.inline(times))
    real_gap = F.when(F.col("_times") > 0, F.col("_gap"))
    totals = counted.groupBy(key).agg(
        F.sum("_times").alias("gaps"),
        F.min(real_gap).alias("min_ms"),
        F.max(real_gap).alias("max_ms"),
    )
    total_of = totals.select(F.col(key).alias("_total_key"), "gaps", "min_ms", "max_ms")
    width = _div(F.col("max_ms") - F.col("min_ms"), CELLS) + 1
    values = (
        counted.filter(F.col("_times") > 0)
        .groupBy(key, "_gap")
        .agg(F.sum("_times").alias("_times"))
        .join(F.broadcast(total_of), F.col(key).eqNullSafe(F.col("_total_key")))
        .select(
            key,
            "_gap",
            "_times",
            "gaps",
            _div(F.col("_gap") - F.col("min_ms"), width).alias("_range"),
        )
    )
    low, high = _middle_ranks(F.col("gaps"))

    def holds(rank: Column) -> Column:
        return (F.col("_upto") - F.col("_times") < rank) & (rank <= F.col("_upto"))

    running = Window.partitionBy(key).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    middle = (
        values.groupBy(key, "_range")
        .agg(F.sum("_times").alias("_times"), F.first("gaps").alias("gaps"))
        .withColumn("_upto", F.sum("_times").over(running))
        .filter(holds(low) | holds(high))
        .select(
            F.col(key).alias("_middle_key"),
            F.col("_range").alias("_middle_range"),
            (F.col("_upto") - F.col("_times")).alias("_before"),
        )
    )
    in_range = Window.partitionBy(key, "_range").orderBy("_gap").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    medians = (
        values.join(
            F.broadcast(middle),
            F.col(key).eqNullSafe(F.col("_middle_key"))
            & (F.col("_range") == F.col("_middle_range")),
        )
        .withColumn("_upto", F.col("_before") + F.sum("_times").over(in_range))
        .groupBy(F.col(key).alias("_median_key"))
        .agg(
            F.max(F.when(holds(low), F.col("_gap"))).alias("_low"),
            F.max(F.when(holds(high), F.col("_gap"))).alias("_high"),
        )
    )
    return totals.join(
        F.broadcast(medians), F.col(key).eqNullSafe(F.col("_median_key")), "left"
    ).drop("_median_key")


def gap_statistics(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Count, smallest, median and largest time between a key's consecutive rows, in ms.

    The median is exact, rounded down to a ms. A key with one row has no gap: count 0
    and nulls.
    """
    rows = df.select(key, ts)
    ordinary, heavy = split_hot(rows, key, epoch_micros(rows, ts))
    instants = heavy.groupBy(key, CELL, ts).agg(F.count(F.lit(1)).alias("_rows"))
    ordinary, heavy = previous_value(ordinary, instants, key, [ts], ts, "_previous")
    columns = [key, "gaps", "min_ms", "max_ms", "_low", "_high"]
    both = (
        _ordinary_gaps(_with_gap(ordinary, ts), key)
        .select(*columns)
        .unionByName(_hot_gaps(_with_gap(heavy, ts), key, ts).select(*columns))
    )
    median = _div(F.col("_low") + F.col("_high"), 2)
    return both.select(key, "gaps", "min_ms", median.alias("median_ms"), "max_ms")


def _with_text(stats: DataFrame, text: Callable[[str], Column]) -> DataFrame:
    return stats.withColumns(
        {f"{name}_text": text(f"{name}_ms") for name in ("min", "median", "max")}
    )


def duration_report(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Gap statistics per key, each with short text."""
    return _with_text(gap_statistics(df, key, ts), duration_text)


def duration_report_verbose(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Gap statistics per key, each with its two or three largest units."""
    return _with_text(gap_statistics(df, key, ts), duration_text_verbose)


def magnitude_report(df: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Row count and sum of ``measure`` (to two places) per group, each with text.

    The text's unit follows from the sum itself, not from what it is rounded to.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(measure).alias("total"))
        .withColumn("rows_text", magnitude_text("rows"))
        .withColumn("total_text", magnitude_text("total"))
        .withColumn("total", F.round("total", 2))
    )


def stamp_report(df: DataFrame, key: str, ts: str) -> DataFrame:
    """First and last time per key as text in the session time zone."""
    return (
        df.groupBy(key)
        .agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
        .select(
            key,
            stamp_text("first").alias("first_text"),
            stamp_text("last").alias("last_text"),
        )
    )


def progress_report(
    df: DataFrame, keys: list[str], status: str, mapping: dict[str, str]
) -> DataFrame:
    """Task counts, the two bar widths and the bar label per group.

    ``mapping`` sends each status value to completed, started, failed or skipped; a
    status outside it counts only towards the total.
    """

    def count(stage: str) -> Column:
        values = [value for value, of_stage in mapping.items() if of_stage == stage]
        return F.count_if(F.col(status).isin(values) if values else F.lit(False)).alias(stage)

    def width(stage: str) -> Column:
        return F.col(stage).cast("double") / F.col("total") * 100

    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("total"),
            *[count(stage) for stage in (COMPLETED, STARTED, FAILED, SKIPPED)],
        )
        .withColumn("completed_percent", width(COMPLETED))
        .withColumn("started_percent", width(STARTED))
        .withColumn("label", progress_label(COMPLETED, "total", FAILED, SKIPPED))
    )
