"""Run a stream over what is available now, into files, and read them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.workspace import new_folder


Fold = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """The Parquet table at a path, if there is one."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def run_folded(
    stream: DataFrame, name: str, fold: Fold, folder: str | None = None, last_only: bool = False
) -> DataFrame:
    """Run a stream over what is available now, fold its rows into a state, and return the rows that come out.

    Micro-batches write their rows to ``pending``, each to its own folder, so a repeated one changes nothing. Then
    ``fold(new rows, state)`` gives the rows of this run and the next state, both written under the
    run's version; a line in ``versions``, written last, makes them count. A run that broke off is done again
    from the same pending rows. The result is the rows of all versions, or of the last one only.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/pending/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    versions = _table(spark, f"{folder}/versions")
    version, upto = (0, -1) if versions is None else versions.agg(F.max("version") + 1, F.max("upto")).first()
    pending = _table(spark, f"{folder}/pending")
    state = _table(spark, f"{folder}/state/version={version - 1}") if version else None
    if pending is not None:
        new = pending.where(F.col("epoch") > upto)
        last = new.agg(F.max("epoch")).first()[0]
        if last is not None:
            rows, after = fold(new.select(*stream.columns), state)
            rows.write.mode("overwrite").parquet(f"{folder}/rows/version={version}")
            after.write.mode("overwrite").parquet(f"{folder}/state/version={version}")
            line = spark.range(1).select(F.lit(version).alias("version"), F.lit(int(last)).alias("upto"))
            line.write.mode("append").parquet(f"{folder}/versions")
            version += 1
    if not version:
        return fold(spark.createDataFrame([], stream.schema), None)[0]
    first = version - 1 if last_only else 0
    return spark.read.parquet(*[f"{folder}/rows/version={at}" for at in range(first, version)])


def _upserted(changes: DataFrame, key: str, newest: str) -> DataFrame:
    """The latest row per ``key`` by ``newest``; combined before the shuffle."""
    rest = [name for name in changes.columns if name not in (key, newest)]
    latest = changes.groupBy(key).agg(F.max(F.struct(newest, *rest)).alias("latest"))
    return latest.select(key, "latest.*").select(*changes.columns)


def _current(spark: SparkSession, folder: str, columns: list[str]) -> tuple[int, DataFrame | None, DataFrame | None]:
    """The version that counts, its snapshot, and the changes since, the latter with their ``epoch``."""
    versions = _table(spark, f"{folder}/versions")
    version = 0 if versions is None else versions.agg(F.max("version")).first()[0]
    snapshot = spark.read.parquet(f"{folder}/snapshots/version={version}") if version else None
    changes = _table(spark, f"{folder}/changes/after={version}")
    return version, snapshot if snapshot is None else snapshot.select(*columns), changes


def _compacted(spark: SparkSession, folder: str, key: str, newest: str, columns: list[str], share: float, epochs: int) -> None:
    """Merge the changes into a new snapshot if they have ``share`` of its rows or ``epochs`` folders.

    The snapshot is written first and counts from the line in ``versions`` on, so one that breaks off changes no answer
    and is written again. The version before stays for those who read it; older ones are removed.
    """
    version, snapshot, changes = _current(spark, folder, columns)
    if changes is None:
        return
    rows, folders = changes.agg(F.count(F.lit(1)), F.count_distinct("epoch")).first()
    if not rows or (snapshot is not None and rows < share * snapshot.count() and folders < epochs):
        return
    every = changes.select(*columns) if snapshot is None else snapshot.unionByName(changes.select(*columns))
    _upserted(every, key, newest).write.mode("overwrite").parquet(f"{folder}/snapshots/version={version + 1}")
    spark.range(1).select(F.lit(version + 1).alias("version")).write.mode("append").parquet(f"{folder}/versions")
    if version:
        from pyarrow import fs

        for old in (f"{folder}/snapshots/version={version - 1}", f"{folder}/changes/after={version - 1}"):
            system, path = fs.FileSystem.from_uri(old)
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_dir(path)


def run_updates(
    stream: DataFrame, key: str, newest: str, name: str, folder: str | None = None, share: float = 0.25, epochs: int = 64
) -> DataFrame:
    """Run an update-mode stream and return the latest row per ``key`` by ``newest``.

    Each micro-batch overwrites its own folder of changes, so a repeated one changes nothing. When all are done, changes
    that have at least ``share`` of the snapshot's rows, or ``epochs`` folders, are merged into the next snapshot. A read
    takes the snapshot and the changes since, so its cost follows the keys and not the history.
    """
    spark = stream.sparkSession
    folder = folder or new_folder(spark, name)
    version = _current(spark, folder, stream.columns)[0]

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/after={version}/epoch={epoch}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    _compacted(spark, folder, key, newest, stream.columns, share, epochs)
    _, snapshot, changes = _current(spark, folder, stream.columns)
    if changes is None:
        return spark.createDataFrame([], stream.schema) if snapshot is None else snapshot
    changes = changes.select(*stream.columns)
    return _upserted(changes if snapshot is None else snapshot.unionByName(changes), key, newest)
