"""A session with the settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Only settings that matter to these jobs; everything else stays with the cluster.
SETTINGS = {
    # Logs carry zone-less stamps written in UTC.
    "spark.sql.session.timeZone": "UTC",
    # AQE merges small shuffle partitions; build_session starts with more of them for
    # larger inputs.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # The equi-joins on address and id have a small unique side and a long, possibly
    # skewed side; AQE splits the long side's hot partition.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Merge streamed sessions of a busy id before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


# What a shuffle partition holds before AQE merges, and bounds of their number.
PARTITION_BYTES, FEWEST, MOST = 256 << 20, 200, 400_000


def initial_partitions(input_bytes: int) -> int:
    """Shuffle partitions to start with for an input of this size, were all of it shuffled."""
    return min(max(-(-input_bytes // PARTITION_BYTES), FEWEST), MOST)


def build_session(
    app_name: str = "rollcall",
    master: str | None = None,
    extra: dict[str, str] | None = None,
    input_bytes: int | None = None,
) -> SparkSession:
    """Create or get a session; ``extra`` overrides :data:`SETTINGS`.

    ``input_bytes``, the size of the largest input, sets how many shuffle partitions AQE starts with.
    """
    if input_bytes is not None:
        sized = {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial_partitions(input_bytes))}
        extra = {**sized, **(extra or {})}
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()
