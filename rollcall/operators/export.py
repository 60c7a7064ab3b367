"""JSON export of the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros
from rollcall.operators.registry import ALIVE, fleet_snapshot
from rollcall.sources.document import write_document


def _document(registry: DataFrame) -> Column:
    """One container as JSON; key names and order are fixed by the format."""
    heartbeat_ms = F.call_function("div", epoch_micros(registry, "last_heartbeat"), F.lit(1000))
    return F.to_json(
        F.struct(
            "id",
            "host",
            "port",
            F.col("web_ui_address").alias("webuiaddress"),
            "memory",
            F.col("memory_used").alias("memoryused"),
            F.col("memory_free").alias("memoryfree"),
            "state",
            heartbeat_ms.alias("lastheartbeat"),
        )
    )


def container_json(registry: DataFrame) -> DataFrame:
    """One JSON document per container: ``id, json``."""
    return registry.select("id", _document(registry).alias("json"))


def container_state_json(state: DataFrame) -> DataFrame:
    """The JSON document of each container's own state: ``id, json``."""
    document = F.to_json(
        F.struct(
            F.col("container_id").alias("id"),
            F.col("master_url").alias("masterurl"),
            F.col("master_web_ui_url").alias("masterwebuiurl"),
            "memory",
            F.col("memory_used").alias("memoryused"),
        )
    )
    return state.select(F.col("container_id").alias("id"), document.alias("json"))


def fleet_json(registry: DataFrame, url: str, status: str = ALIVE) -> DataFrame:
    """The fleet document as ordered lines: ``part, id, line``.

    The lines in order ``(part, id)`` joined by newlines are one JSON document with
    keys url, workers (all containers, by id), memory and memoryused (ALIVE ones)
    and status. As lines, the document has no size limit: no task holds more than
    its share, and writing the sorted frame as text gives the file. Part 0 opens the
    document, part 1 has one line per container, part 2 closes it with the totals.
    """
    # Every container but the first is led by a comma. The smallest id is one value,
    # read as a scalar subquery.
    first = registry.agg(F.min("id").alias("first_id")).scalar()
    comma = F.when(F.col("id") == first, "").otherwise(",")
    workers = container_json(registry).select(
        F.lit(1).alias("part"), "id", F.concat(comma, F.col("json")).alias("line")
    )
    opening = F.regexp_replace(F.to_json(F.struct(F.lit(url).alias("url"))), r"\}$", "")
    closing = F.regexp_replace(
        F.to_json(F.struct("memory", F.col("memory_used").alias("memoryused"), "status")),
        r"^\{",
        "",
    )
    frame = F.array(
        F.struct(F.lit(0).alias("part"), F.concat(opening, F.lit(',"workers":[')).alias("line")),
        F.struct(F.lit(2).alias("part"), F.concat(F.lit("],"), closing).alias("line")),
    )
    ends = (
        fleet_snapshot(registry, status=status)
        .select(F.explode(frame).alias("end"))
        .select("end.part", F.lit("").alias("id"), "end.line")
    )
    return ends.unionByName(workers).orderBy("part", "id")


def write_fleet_document(registry: DataFrame, folder: str, url: str, status: str = ALIVE) -> None:
    """Write the fleet document under ``folder``: its parts in order are one JSON document.

    See :mod:`rollcall.sources.document` for what is written and how failed tasks are survived.
    """
    write_document(fleet_json(registry, url, status), folder)
