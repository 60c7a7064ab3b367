"""Ordered per-key work on tables where one key may hold a third of all rows.

A window or fold over one key runs in one task. That is right for ordinary keys
and ruinous for a very large one, so ordered operators treat the two apart:

* ordinary keys use a plain window on the key (one shuffle);
* *hot* keys are cut along the ordering into cells of about equally many rows, more
  of them the more rows the key has. Each
  ``(key, cell)`` is worked on separately, and what a cell needs from the cells
  before it (a previous value, a running count, a state) is computed from one
  summary row per cell and put in front of the cell as a *carry row*.

Which keys are hot only decides the route; both routes give the same rows.

The hot list is safe to broadcast at any data size: it has the keys with at least
``spark.rollcall.hotKeyRows`` rows, so no more than the rows of the table divided by
that number (100,000 keys in 10**12 rows at the default). Where no key is hot, Catalyst sees an empty list and drops the hot route.

Cells start at quantiles of the key's own places ``(time, tie)``, taken from places that
a hash picks, so a burst, or all rows at one instant, spreads over cells as evenly
as a steady key does. The hash only decides where to cut: every row goes to a cell.
The picked places of one key, at most ``CELLS * PLACES_PER_CELL`` or so, are ordered in one task.
The bounds of all hot keys together are no more than the rows of the table divided by
the rows of a cell. Rows of one key with the same time and tie stay together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

# A key gets a cell for every 1/CELLS_PER_HOT_KEY of the rows that make it hot, so that
# cells are well filled, but no more than CELLS.
CELLS_PER_HOT_KEY = 64
CELLS = 65_536
# Places picked for each cell; with 32 a cell's size varies by about a fifth.
PLACES_PER_CELL = 32
HOT_KEY_ROWS = "spark.rollcall.hotKeyRows"
DEFAULT_HOT_KEY_ROWS = 10_000_000

CELL = "_cell"
IS_CARRY = "_is_carry"
_KEY = "_hot_key"
_BOUNDS = "_hot_bounds"
_BOUNDS_TYPE = "array<struct<at:bigint,tie:bigint>>"
# A cell is looked up by part of the key, then within the part; bounds and cells of each are at most so many.
_PART = 256


def hot_key_rows(spark: SparkSession) -> int:
    """Rows from which on a key counts as hot."""
    return int(spark.conf.get(HOT_KEY_ROWS, str(DEFAULT_HOT_KEY_ROWS)))


def largest_keys(counted: DataFrame, rows: str) -> DataFrame:
    """The hot ones of one row per ``key`` with its number of ``rows``."""
    return counted.filter(F.col(rows) >= hot_key_rows(counted.sparkSession))


def _place(position: Column, tie: str | None) -> Column:
    """Where a row stands within its key."""
    second = F.lit(0) if tie is None else F.col(tie)
    return F.struct(position.cast("bigint").alias("at"), second.cast("bigint").alias("tie"))


def hot_keys(df: DataFrame, key: str, position: Column, tie: str | None = None) -> DataFrame:
    """One row per hot key: the key, and the places at which its second and later cells start.

    One count by key, combined before the shuffle, and one pass over the rows of the
    hot keys, of which a hash picks the places that are ordered. Bounds are one array so
    that every user of the list needs the same columns and Spark computes it once.
    """
    rows = df.select(F.col(key).alias("_row_key"), _place(position, tie).alias("_place"))
    counted = rows.groupBy(F.col("_row_key").alias(_KEY)).agg(F.count(F.lit(1)).alias("_rows"))
    kind = rows.schema["_row_key"].dataType.simpleString()
    if largest_keys(counted, "_rows").isEmpty():
        return df.sparkSession.createDataFrame([], f"{_KEY} {kind}, {_BOUNDS} {_BOUNDS_TYPE}")
    per_cell = max(hot_key_rows(df.sparkSession) // CELLS_PER_HOT_KEY, 1)
    cells = F.greatest(F.least(F.call_function("div", F.col("_rows"), F.lit(per_cell)), F.lit(CELLS)), F.lit(1))
    largest = largest_keys(counted, "_rows").withColumn("_cells", cells)
    every = F.greatest(F.call_function("div", F.col("_rows"), F.col("_cells") * PLACES_PER_CELL), F.lit(1))
    whole = Window.partitionBy(_KEY)
    number = F.row_number().over(whole.orderBy("_place")) - 1
    starts = (
        rows.join(F.broadcast(largest), F.col("_row_key").eqNullSafe(F.col(_KEY)))
        .filter(F.pmod(F.xxhash64("_place"), every) == 0)
        .select(_KEY, "_cells", "_place")
        .distinct()
        .select(_KEY, "_place", F.call_function("div", number * F.col("_cells"), F.count(F.lit(1)).over(whole)).alias(CELL))
        .filter(F.col(CELL) > 0)
        .groupBy(_KEY, CELL)
        .agg(F.min("_place").alias("_place"))
        .groupBy(F.col(_KEY).alias("_cut_key"))
        .agg(F.array_sort(F.collect_list("_place")).alias(_BOUNDS))
    )
    uncut = F.array().cast(_BOUNDS_TYPE)
    return largest.join(starts, F.col(_KEY).eqNullSafe(F.col("_cut_key")), "left").select(
        _KEY, F.coalesce(_BOUNDS, uncut).alias(_BOUNDS)
    )


def _passed(bounds: str) -> Column:
    """How many of at most ``_PART - 1`` ordered bounds are at or before the row's place."""
    steps = F.array(*[F.lit(_PART >> nth) for nth in range(1, _PART.bit_length())])
    return F.aggregate(
        steps, F.lit(0), lambda found, step: F.when(F.get(bounds, found + step - 1) <= F.col("_place"), found + step).otherwise(found)
    )


def split_hot(
    df: DataFrame, key: str, position: Column, hot: DataFrame | None = None, tie: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Split rows into ``(ordinary, hot)``; the hot part has a ``_cell`` column.

    ``position`` is a bigint that grows with the wanted order, and ``tie`` a column of whole numbers
    that orders rows of one position. ``hot`` reuses a list
    from :func:`hot_keys`. Rows whose key is null count as one key like any other.
    """
    hot = hot_keys(df, key, position, tie) if hot is None else hot
    parts = hot.select(_KEY, F.filter(_BOUNDS, lambda _, at: (at + 1) % _PART == 0).alias("_parts"))
    tagged = df.withColumn("_place", _place(position, tie)).join(
        F.broadcast(parts), F.col(key).eqNullSafe(F.col(_KEY)), "left"
    )
    columns = df.columns
    ordinary = tagged.filter(F.col("_parts").isNull()).select(*columns)
    part = F.explode(F.sequence(F.lit(0), F.call_function("div", F.array_size(_BOUNDS), F.lit(_PART)).cast("int")))
    within = hot.select(F.col(_KEY).alias("_part_key"), _BOUNDS, part.alias("_in_part")).select(
        "_part_key", "_in_part", F.slice(_BOUNDS, F.col("_in_part") * _PART + 1, F.lit(_PART - 1)).alias("_within")
    )
    heavy = (
        tagged.filter(F.col("_parts").isNotNull())
        .select(*columns, "_place", _passed("_parts").alias("_part"))
        .join(F.broadcast(within), F.col(key).eqNullSafe(F.col("_part_key")) & (F.col("_part") == F.col("_in_part")))
        .select(*columns, (F.col("_part") * _PART + _passed("_within")).cast("bigint").alias(CELL))
    )
    return ordinary, heavy


def cut(df: DataFrame, position: Column, tie: str, bounds: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``_cell``: how many of the ordered ``bounds`` (at most 65,535 places) are at or before the row's place."""
    hot = df.sparkSession.createDataFrame([(0, bounds)], f"{_KEY} int, {_BOUNDS} {_BOUNDS_TYPE}")
    return split_hot(df.withColumn("_one", F.lit(0)), "_one", position, hot, tie)[1].drop("_one")


def with_carry(rows: DataFrame, carry: DataFrame) -> DataFrame:
    """Rows plus carry rows, told apart by ``_is_carry``; missing columns are null."""
    return rows.withColumn(IS_CARRY, F.lit(False)).unionByName(
        carry.withColumn(IS_CARRY, F.lit(True)), allowMissingColumns=True
    )


def cell_order(order: list[str]) -> list[Column]:
    """Order inside a ``(key, cell)``: its carry row first."""
    return [F.col(IS_CARRY).desc(), *[F.col(name) for name in order]]


def previous_value(
    ordinary: DataFrame, heavy: DataFrame, key: str, order: list[str], value: str, name: str
) -> tuple[DataFrame, DataFrame]:
    """Add ``name``: the key's previous ``value`` in ``order``, which must not be null."""
    by_key = Window.partitionBy(key).orderBy(*order)
    ordinary = ordinary.withColumn(name, F.lag(value).over(by_key))

    last = heavy.groupBy(key, CELL).agg(
        F.max_by(value, F.struct(*order)).alias("_last")
    )
    over_cells = Window.partitionBy(key).orderBy(CELL)
    carry = (
        last.select(key, CELL, F.lag("_last").over(over_cells).alias(value))
        .filter(F.col(value).isNotNull())
    )
    in_cell = Window.partitionBy(key, CELL).orderBy(*cell_order(order))
    heavy = (
        with_carry(heavy, carry)
        .withColumn(name, F.lag(value).over(in_cell))
        .filter(~F.col(IS_CARRY))
        .drop(IS_CARRY)
    )
    return ordinary, heavy


def running_number(
    ordinary: DataFrame, heavy: DataFrame, key: str, order: list[str], name: str
) -> tuple[DataFrame, DataFrame]:
    """Add ``name``: the row's number within its key in ``order``, from 0."""
    by_key = Window.partitionBy(key).orderBy(*order)
    ordinary = ordinary.withColumn(name, (F.row_number().over(by_key) - 1).cast("bigint"))

    before = Window.partitionBy(key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        heavy.groupBy(key, CELL)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(key, CELL, F.sum("_rows").over(before).alias("_before"))
        .filter(F.col("_before").isNotNull())
    )
    in_cell = (
        Window.partitionBy(key, CELL)
        .orderBy(*cell_order(order))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    step = F.when(F.col(IS_CARRY), F.col("_before")).otherwise(F.lit(1).cast(T.LongType()))
    heavy = (
        with_carry(heavy, carry)
        .withColumn(name, F.sum(step).over(in_cell) - 1)
        .filter(~F.col(IS_CARRY))
        .drop(IS_CARRY, "_before")
    )
    return ordinary, heavy


def running(
    ordinary: DataFrame,
    heavy: DataFrame,
    key: str,
    order: list[str],
    results: dict[str, tuple[Callable[[Column], Column], str]],
) -> tuple[DataFrame, DataFrame]:
    """Add, by name, an associative aggregate (sum, max, ...) of a column over the key's rows up to and with this one.

    A cell's aggregate is one row, and those before a cell are its carry row. Rows must have one order.
    """

    def over(window: Window) -> dict[str, Column]:
        return {name: function(F.col(value)).over(window) for name, (function, value) in results.items()}

    so_far = (Window.unboundedPreceding, Window.currentRow)
    ordinary = ordinary.withColumns(over(Window.partitionBy(key).orderBy(*order).rowsBetween(*so_far)))
    values = {value: function for function, value in results.values()}
    before = Window.partitionBy(key).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        heavy.groupBy(key, CELL)
        .agg(*[function(F.col(value)).alias(value) for value, function in values.items()])
        .select(key, CELL, *[function(F.col(value)).over(before).alias(value) for value, function in values.items()])
    )
    in_cell = Window.partitionBy(key, CELL).orderBy(*cell_order(order)).rowsBetween(*so_far)
    heavy = with_carry(heavy, carry).withColumns(over(in_cell)).filter(~F.col(IS_CARRY)).drop(IS_CARRY, CELL)
    return ordinary, heavy
