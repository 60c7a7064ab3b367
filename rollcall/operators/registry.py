"""Registration outcomes, the accepted registry and its listings.

Inputs are logs ordered by ``(ts, seq)``, the order of arrival; ``seq`` is unique, and
``id``, ``ts`` and ``seq`` are never null. Registrations without an address share one, the null
address.

Precondition of every operator here: an id belongs to one address (ids are built
from host and port). :func:`ids_with_many_addresses` lists the ids that break it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.clock import epoch_micros
from rollcall.functions.ownership import (
    DUPLICATE_ADDRESS,
    DUPLICATE_ID,
    IGNORED,
    REGISTERED,
    UPDATED,
)
from rollcall.functions.text import memory_text
from rollcall.plans.skew import largest_keys, running_number, split_hot

ALIVE = "ALIVE"

# Replies to a refused registration.
DUPLICATE_ID_MESSAGE = "Duplicate container ID"
DUPLICATE_ADDRESS_MESSAGE = "Attempted to re-register worker at same address: "

# Registration retries before the longer interval, and in total.
INITIAL_RETRIES = 6
TOTAL_RETRIES = 16


def reply_message(outcome: Column, address: Column) -> Column:
    """Text sent back with a refusal, null for an accepted registration."""
    return F.when(outcome == DUPLICATE_ID, DUPLICATE_ID_MESSAGE).when(
        outcome == DUPLICATE_ADDRESS, F.concat(F.lit(DUPLICATE_ADDRESS_MESSAGE), F.coalesce(address.cast("string"), F.lit("")))
    )


def registration_outcomes(reg: DataFrame) -> DataFrame:
    """Label each registration REGISTERED, DUPLICATE_ID or DUPLICATE_ADDRESS.

    With no losses the first registration at an address owns it for good, so the
    owner is one aggregation, combined before its shuffle, and labelling is an
    equi-join whose owner side has one row per address.

    AQE does not split that join, as the owner side comes from an aggregation on its
    key. So the registrations of hot addresses are set apart: their owners, a bounded
    number, come from the same aggregation and are broadcast.
    """
    # The test on rows always holds; with it all uses of the aggregation have the same
    # plan, and Spark runs it once.
    owners = (
        reg.groupBy(F.col("address").alias("owner_address"))
        .agg(F.min(F.struct("ts", "seq", "id")).alias("owner"), F.count(F.lit(1)).alias("rows"))
    )
    hot_owners = largest_keys(owners, "rows").drop("rows")
    all_owners = owners.filter(F.col("rows") > 0).drop("rows")
    at_address = F.col("address").eqNullSafe(F.col("owner_address"))

    rows = reg.select("seq", "ts", "id", "address")
    tagged = rows.join(F.broadcast(hot_owners), at_address, "left")
    hot = tagged.filter(F.col("owner").isNotNull())
    ordinary = (
        tagged.filter(F.col("owner").isNull()).select(*rows.columns).join(all_owners, at_address)
    )
    outcome = (
        F.when(F.col("seq") == F.col("owner.seq"), REGISTERED)
        .when(F.col("id") == F.col("owner.id"), DUPLICATE_ID)
        .otherwise(DUPLICATE_ADDRESS)
    )
    return (
        ordinary.unionByName(hot)
        .withColumn("outcome", outcome)
        .withColumn("message", reply_message(F.col("outcome"), F.col("address")))
        .select("seq", "ts", "id", "address", "outcome", "message")
    )


def _accepted(reg: DataFrame) -> DataFrame:
    """The accepted registration of each address, all columns of the request."""
    rest = [name for name in reg.columns if name not in ("address", "ts", "seq")]
    return (
        reg.groupBy("address")
        .agg(F.min_by(F.struct("ts", "seq", *rest), F.struct("ts", "seq")).alias("first"))
        .select("address", "first.*")
    )


def registry(reg: DataFrame) -> DataFrame:
    """One row per accepted registration, with the values set on acceptance.

    State is ALIVE, the last heartbeat is the time of acceptance, and used memory is
    0 unless the log brings a ``memory_used`` column.
    """
    used = F.col("memory_used") if "memory_used" in reg.columns else F.lit(0)
    return _accepted(reg).select(
        "id",
        "address",
        "host",
        "port",
        "memory",
        used.alias("memory_used"),
        (F.col("memory") - used).alias("memory_free"),
        F.lit(ALIVE).alias("state"),
        F.col("ts").alias("last_heartbeat"),
        F.concat(F.lit("http://"), "public_address", F.lit(":"), "web_ui_port").alias(
            "web_ui_address"
        ),
        F.col("ts").alias("accepted_at"),
        F.col("seq").alias("accepted_seq"),
    )


def accepted_ids(reg: DataFrame) -> DataFrame:
    """``id, accepted_at, accepted_seq`` of each accepted container; ids are unique."""
    return (
        reg.groupBy("address")
        .agg(F.min(F.struct("ts", "seq", "id")).alias("first"))
        .select(
            F.col("first.id").alias("id"),
            F.col("first.ts").alias("accepted_at"),
            F.col("first.seq").alias("accepted_seq"),
        )
    )


def heartbeat_outcomes(reg: DataFrame, hb: DataFrame) -> DataFrame:
    """UPDATED if the id was accepted strictly earlier in ``(ts, seq)``, else IGNORED.

    The accepted side has one row per address and unique ids, so the join cannot
    multiply rows; Spark broadcasts it only if its measured size allows, and else AQE
    splits a hot id on the heartbeat side.
    """
    accepted = accepted_ids(reg).withColumnRenamed("id", "accepted_id")
    # Without the null test a missing owner would sort before every heartbeat.
    earlier = F.col("accepted_id").isNotNull() & (
        F.struct("accepted_at", "accepted_seq")
        < F.struct(F.col("ts").alias("accepted_at"), F.col("seq").alias("accepted_seq"))
    )
    return (
        hb.select("seq", "ts", "id")
        .join(accepted, F.col("id") == F.col("accepted_id"), "left")
        .select(
            "seq", "ts", "id", F.when(earlier, UPDATED).otherwise(IGNORED).alias("outcome")
        )
    )


def last_seen(reg: DataFrame, hb: DataFrame) -> DataFrame:
    """Accept time or latest updating heartbeat, whichever is later, per accepted id.

    A heartbeat later than the accept time always updates and one at or before it
    never changes the result, so heartbeats shrink to one row per id before the join.
    """
    beats = hb.groupBy("id").agg(F.max("ts").alias("last_beat"))
    return (
        accepted_ids(reg)
        .join(beats, "id", "left")
        .select("id", F.greatest("accepted_at", "last_beat").alias("last_seen"))
    )


def fleet_snapshot(
    registry: DataFrame, by: str | None = None, status: str = ALIVE
) -> DataFrame:
    """Counts and memory of the ALIVE containers, and how many are listed in all.

    One row for the whole fleet (zeros if it is empty), or one per value of ``by``.
    """
    alive = F.col("state") == ALIVE

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(alive, F.col(name))), F.lit(0)).cast("bigint")

    return registry.groupBy(*([by] if by else [])).agg(
        F.count_if(alive).alias("alive"),
        total("memory").alias("memory"),
        total("memory_used").alias("memory_used"),
        F.count(F.lit(1)).alias("listed"),
        F.lit(status).alias("status"),
    )


def readable_totals(snapshot: DataFrame) -> DataFrame:
    """A snapshot with its memory as text."""
    text = F.concat(memory_text("memory"), F.lit(" Total, "), memory_text("memory_used"), F.lit(" Used"))
    return snapshot.withColumn("memory_text", text)


def _listing(registry: DataFrame) -> DataFrame:
    return registry.select(
        "id",
        "web_ui_address",
        "address",
        "state",
        "memory",
        "memory_used",
        "memory_free",
        F.concat(
            memory_text("memory"),
            F.lit(" ("),
            memory_text("memory_used"),
            F.lit(" Used)"),
        ).alias("memory_text"),
    )


def fleet_listing(registry: DataFrame) -> DataFrame:
    """All containers in any state, ordered by id (a range-partitioned sort)."""
    return _listing(registry).orderBy("id")


def listing_by_memory(registry: DataFrame, n: int | None = None) -> DataFrame:
    """The listing by memory, then used memory, largest first; optionally the top ``n``.

    A two-key numeric order; ties are broken by id so that ``n`` is well defined.
    """
    ordered = _listing(registry).orderBy(F.desc("memory"), F.desc("memory_used"), "id")
    return ordered if n is None else ordered.limit(n)


def container_state(
    registry: DataFrame, ids: DataFrame, master_url: str = "", master_web_ui_url: str = ""
) -> DataFrame:
    """The container's own view of its state, for the ids in ``ids.id``.

    Repeated ids are combined before the shuffle: AQE cannot split that side of a
    semi-join.
    """
    return registry.join(ids.select("id").distinct(), "id", "left_semi").select(
        "host",
        "port",
        F.col("id").alias("container_id"),
        F.lit(master_url).alias("master_url"),
        "memory",
        "memory_used",
        F.lit(master_web_ui_url).alias("master_web_ui_url"),
    )


def attempt_tiers(reg: DataFrame) -> DataFrame:
    """Number each id's registrations from 0 and name the retry tier.

    0 is FIRST, then INITIAL and PROLONGED retries, then GAVE_UP. The limits are the
    container's retry limits; numbering over the whole log, with no reset after a
    disconnect, is this library's rule.
    """
    position = epoch_micros(reg, "ts")
    ordinary, heavy = split_hot(reg.select("seq", "ts", "id"), "id", position, tie="seq")
    ordinary, heavy = running_number(ordinary, heavy, "id", ["ts", "seq"], "attempt")
    columns = ["seq", "ts", "id", "attempt"]
    tier = (
        F.when(F.col("attempt") == 0, "FIRST")
        .when(F.col("attempt") <= INITIAL_RETRIES, "INITIAL")
        .when(F.col("attempt") <= TOTAL_RETRIES, "PROLONGED")
        .otherwise("GAVE_UP")
    )
    return ordinary.select(*columns).unionByName(heavy.select(*columns)).withColumn("tier", tier)


def ids_with_many_addresses(reg: DataFrame) -> DataFrame:
    """Ids seen at more than one address, which the other operators rule out.

    Comparing the smallest with the largest address needs no set of addresses.
    """
    return (
        reg.groupBy("id")
        .agg(F.min("address").alias("first_address"), F.max("address").alias("last_address"))
        .filter(F.col("first_address") != F.col("last_address"))
    )
