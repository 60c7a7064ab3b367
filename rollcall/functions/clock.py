"""Instants as integer microseconds."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UTC_NAMES = {"UTC", "Etc/UTC", "GMT", "Z", "+00:00"}


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a ``timestamp`` or ``timestamp_ntz`` column.

    A zone-less stamp is read as UTC. In a UTC session that is a free cast; in any
    other zone the cast would bend at daylight-saving changes, so the exact but
    slower interval route is taken.
    """
    column = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(column)
    if df.sparkSession.conf.get("spark.sql.session.timeZone") in _UTC_NAMES:
        return F.unix_micros(column.cast("timestamp"))
    return F.expr(
        f"cast(cast(cast(`{name}` - timestamp_ntz'1970-01-01 00:00:00' as interval second)"
        " as decimal(18, 6)) * 1000000 as bigint)"
    )


def micros(length: timedelta) -> int:
    """A length of time in whole microseconds."""
    return length // timedelta(microseconds=1)
