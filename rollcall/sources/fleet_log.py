"""Registration, heartbeat and loss logs derived from the ``events`` table.

Each event of a user becomes one message of one container. Two users share an
address, so every id belongs to one address and all outcome classes occur. The
derivation works on a batch or a streaming ``events`` DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REGISTER = "register"
HEARTBEAT = "heartbeat"
LOST = "lost"

PORT = 7078
WEB_UI_PORT = 8082

_KIND_OF_EVENT = {
    "signup": REGISTER,
    "view": HEARTBEAT,
    "click": HEARTBEAT,
    "purchase": HEARTBEAT,
    "error": LOST,
}


def _id() -> Column:
    return F.concat(F.lit("container-"), F.col("user_id"))


def _host() -> Column:
    return F.concat(F.lit("host-"), F.expr("user_id div 2"))


def _address() -> Column:
    return F.concat(_host(), F.lit(f":{PORT}"))


def _events_of(events: DataFrame, kind: str) -> DataFrame:
    names = [event for event, of_kind in _KIND_OF_EVENT.items() if of_kind == kind]
    return events.filter(F.col("event_type").isin(names))


def _memory() -> Column:
    return (512 * (1 + F.get_json_object("props", "$.k").cast("int") % 4)).cast("int")


def _request() -> list[Column]:
    """What a registration request says besides who sent it when."""
    return [
        _host().alias("host"),
        F.lit(PORT).alias("port"),
        _memory().alias("memory"),
        F.floor(F.least(F.col("value"), _memory())).cast("int").alias("memory_used"),
        F.lit(WEB_UI_PORT).alias("web_ui_port"),
        _host().alias("public_address"),
    ]


def registrations(events: DataFrame) -> DataFrame:
    """One row per registration request, in the registration-message schema."""
    return _events_of(events, REGISTER).select(
        F.col("event_id").alias("seq"),
        "ts",
        _id().alias("id"),
        _address().alias("address"),
        *_request(),
    )


def _messages(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("seq"), "ts", _id().alias("id"), _address().alias("address")
    )


def heartbeats(events: DataFrame) -> DataFrame:
    """One row per heartbeat: ``seq, ts, id, address``."""
    return _messages(_events_of(events, HEARTBEAT))


def losses(events: DataFrame) -> DataFrame:
    """One row per reported loss: ``seq, ts, id, address``."""
    return _messages(_events_of(events, LOST))


def message_log(events: DataFrame, with_request: bool = False) -> DataFrame:
    """All three kinds in one scan: ``seq, ts, kind, id, address``.

    ``with_request`` adds the columns of the registration request.
    """
    kinds = F.create_map(*[F.lit(part) for pair in _KIND_OF_EVENT.items() for part in pair])
    return events.filter(F.col("event_type").isin(list(_KIND_OF_EVENT))).select(
        F.col("event_id").alias("seq"),
        "ts",
        kinds[F.col("event_type")].alias("kind"),
        _id().alias("id"),
        _address().alias("address"),
        *(_request() if with_request else []),
    )
