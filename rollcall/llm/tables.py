"""Intermediate tables in the shared folder, and column names that cannot clash."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.workspace import new_folder

#: A list of at most so many narrow rows is sent to all tasks; a longer one is joined by a shuffle.
SHORT_ROWS = 250_000

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame, written once as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts lineage without depending on any one executor, and lets a join of two stored
    tables exchange both sides, so adaptive execution can split a hot key.
    """
    path = new_folder(frame.sparkSession, purpose)
    if _scopes.get():
        _scopes.get()[-1].append(path)
    frame.write.mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables :func:`stored` within are removed at the end, but for those stored by :func:`kept`.

    For work that is done when the block ends: nothing that is still to be computed may read them.
    """
    made: list[str] = []
    token = _scopes.set((*_scopes.get(), made))
    try:
        yield
    finally:
        _scopes.reset(token)
        removed(spark, made)


def kept(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame as :func:`stored`, belonging to what is around the block of :func:`scratch`."""
    token = _scopes.set(_scopes.get()[:-1])
    try:
        return stored(frame, purpose)
    finally:
        _scopes.reset(token)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that no plan still to be run reads."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def short(listed: DataFrame, weight: Column | None = None) -> DataFrame:
    """A stored list as the small side of a join: sent to all tasks if it has few rows, so the other side need not move.

    ``weight`` counts a row for more than one.
    """
    rows = listed.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return F.broadcast(listed) if rows <= SHORT_ROWS else listed


def spare(frame: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    while name.lower() in {x.lower() for x in frame.columns}:
        name = f"{name}_"
    return name


def row_print(*columns: Column) -> list[Column]:
    """Two 64-bit hashes of a row's values (never null): equal rows have equal prints."""
    return [F.xxhash64(F.lit(seed), *[x for c in columns for x in (c.isNull(), c)]).alias(f"print_{seed}") for seed in (0, 1)]
