"""Hand-made logs, and a replay of a whole log one message at a time.

The replay keeps the collections a membership service would (listed containers, by
id, by address) and handles one message after the other over all addresses.
"""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

START = datetime(2024, 1, 1)
LOG_TYPE = "seq bigint, ts timestamp_ntz, kind string, id string, address string"


def at(seconds: float) -> datetime:
    return START + timedelta(seconds=seconds)


def log(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows ``(seconds, kind, id, address)``; seq is the place in the list."""
    return spark.createDataFrame(
        [(seq, at(when), kind, name, where) for seq, (when, kind, name, where) in enumerate(rows)],
        LOG_TYPE,
    )


def split(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registrations and heartbeats of a log."""
    return (
        messages.filter("kind = 'register'").drop("kind"),
        messages.filter("kind = 'heartbeat'").drop("kind"),
    )


def random_rows(seed: int, size: int, addresses: int, ids: int, kinds: tuple[str, ...]):
    """A random log; the first address gets a third of all rows, some stamps repeat."""
    chance = random.Random(seed)
    rows, now = [], 0.0
    for _ in range(size):
        now += chance.choice([0, 1, 1, 2, 7, 40, 200])
        where = 0 if chance.random() < 1 / 3 else chance.randrange(addresses)
        name = f"c{where}-{chance.randrange(ids)}"
        rows.append((now, chance.choice(kinds), name, f"h{where}:7078"))
    return rows


class WholeLog:
    """Outcomes of all messages, in order."""

    def __init__(self, rows: list[tuple]) -> None:
        self.listed: list[dict] = []
        self.by_id: dict[str, dict] = {}
        self.by_address: dict[str, dict] = {}
        self.outcomes = [self._take(*row[1:]) for row in rows]

    def _take(self, kind: str, name: str, where: str) -> str:
        known = self.by_id.get(name)
        if kind == "lost":
            if known is None:
                return "NO_EFFECT"
            known["state"] = "UNKNOWN"
            return "MARKED_UNKNOWN"
        if kind == "heartbeat":
            if known is not None:
                return "UPDATED"
            is_listed = any(one["id"] == name for one in self.listed)
            return "RECONNECT" if is_listed else "IGNORED"
        if known is not None:
            return "DUPLICATE_ID"
        self.listed = [
            one for one in self.listed if not (one["at"] == where and one["state"] == "DEAD")
        ]
        old = self.by_address.get(where)
        if old is not None:
            if old["state"] != "UNKNOWN":
                return "DUPLICATE_ADDRESS"
            old["state"] = "DEAD"
            del self.by_id[old["id"]]
        new = {"id": name, "at": where, "state": "ALIVE"}
        self.listed.append(new)
        self.by_id[name] = self.by_address[where] = new
        return "REGISTERED"
