from __future__ import annotations

import json

import pytest
from logs import WholeLog, at, log, random_rows, split
from pyspark.sql import functions as F

from rollcall.operators import export, registry

HEARTBEAT, REGISTER = "heartbeat", "register"


@pytest.fixture
def fleet(spark):
    rows = [
        # id, host, memory, memory_used, state
        ("c-b", "h2", 512, 9, "ALIVE"),
        ("c-a", "h1", 512, 10, "ALIVE"),
        ("c-d", "h4", 1024, 0, "DEAD"),
        ("c-c", "h3", 2048, 512, "UNKNOWN"),
    ]
    frame = spark.createDataFrame(
        rows, "id string, host string, memory int, memory_used int, state string"
    )
    return frame.withColumns(
        {
            "port": F.lit(7078),
            "address": F.concat("host", F.lit(":7078")),
            "memory_free": F.col("memory") - F.col("memory_used"),
            "last_heartbeat": F.lit(at(1.5)).cast("timestamp_ntz"),
            "web_ui_address": F.concat(F.lit("http://"), "host", F.lit(":8082")),
        }
    )


def requests(spark, rows):
    """Registration requests from ``(seconds, id, host)``."""
    made = log(spark, [(when, REGISTER, name, f"{host}:7078") for when, name, host in rows])
    return made.drop("kind").withColumns(
        {
            "host": F.split("address", ":")[0],
            "port": F.lit(7078),
            "memory": F.lit(512),
            "web_ui_port": F.lit(8082),
            "public_address": F.split("address", ":")[0],
        }
    )


def outcomes(frame):
    return {row.seq: row.outcome for row in frame.collect()}


def test_outcome_of_each_kind_of_registration(spark):
    reg = requests(
        spark, [(5, "a", "h"), (1, "b", "h"), (6, "b", "h"), (1, "c", "k"), (1, "d", "k")]
    )
    found = registry.registration_outcomes(reg)
    assert outcomes(found) == {
        0: "DUPLICATE_ADDRESS",
        1: "REGISTERED",
        2: "DUPLICATE_ID",
        3: "REGISTERED",  # same time as 4: the earlier seq wins
        4: "DUPLICATE_ADDRESS",
    }
    messages = {row.seq: row.message for row in found.collect()}
    assert messages[1] is None
    assert messages[2] == "Duplicate container ID"
    assert messages[0] == "Attempted to re-register worker at same address: h:7078"


def test_no_rows_in_no_rows_out(spark):
    reg = requests(spark, [])
    hb = log(spark, []).drop("kind")
    assert registry.registration_outcomes(reg).count() == 0
    assert registry.registry(reg).count() == 0
    assert registry.heartbeat_outcomes(reg, hb).count() == 0
    assert registry.last_seen(reg, hb).count() == 0
    assert registry.attempt_tiers(reg).count() == 0
    empty = registry.fleet_snapshot(registry.registry(reg)).first()
    assert empty.asDict() == {
        "alive": 0, "memory": 0, "memory_used": 0, "listed": 0, "status": "ALIVE"
    }


def test_accepted_row_has_defaults_and_derived_columns(spark):
    row = registry.registry(requests(spark, [(2, "a", "h"), (3, "b", "h")])).first()
    assert (row.id, row.address, row.memory, row.memory_used, row.memory_free) == (
        "a", "h:7078", 512, 0, 512,
    )
    assert (row.state, row.last_heartbeat, row.web_ui_address) == ("ALIVE", at(2), "http://h:8082")


def test_heartbeat_must_follow_acceptance(spark):
    messages = log(
        spark,
        [
            (5, HEARTBEAT, "a", "h"),  # same time, earlier seq
            (5, REGISTER, "a", "h"),
            (5, HEARTBEAT, "a", "h"),  # same time, later seq
            (6, HEARTBEAT, "b", "h"),  # registered, but refused
            (4, REGISTER, "x", "k"),
            (5.5, REGISTER, "b", "h"),
            (9, HEARTBEAT, "never", "z"),
        ],
    )
    found = outcomes(registry.heartbeat_outcomes(*split(messages)))
    assert found == {0: "IGNORED", 2: "UPDATED", 3: "IGNORED", 6: "IGNORED"}
    seen = {row.id: row.last_seen for row in registry.last_seen(*split(messages)).collect()}
    assert seen == {"a": at(5), "x": at(4)}


@pytest.mark.parametrize("seed", range(3))
def test_outcomes_agree_with_whole_log(spark, seed):
    rows = random_rows(seed, 400, 12, 3, (REGISTER, HEARTBEAT))
    expected = dict(enumerate(WholeLog(rows).outcomes))
    reg, hb = split(log(spark, rows))
    found = outcomes(registry.registration_outcomes(reg))
    found |= outcomes(registry.heartbeat_outcomes(reg, hb))
    assert found == expected


def test_snapshot_counts_living_and_lists_all(fleet):
    row = registry.fleet_snapshot(fleet).first()
    assert (row.alive, row.memory, row.memory_used, row.listed) == (2, 1024, 19, 4)
    by_state = {row.state: row.alive for row in registry.fleet_snapshot(fleet, "state").collect()}
    assert by_state == {"ALIVE": 2, "DEAD": 0, "UNKNOWN": 0}


def test_listing_is_ordered_by_id(fleet):
    rows = registry.fleet_listing(fleet).collect()
    assert [row.id for row in rows] == ["c-a", "c-b", "c-c", "c-d"]
    assert rows[2].memory_text == "2.0 GB (512.0 MB Used)"


def test_memory_order_is_numeric(fleet):
    ids = [row.id for row in registry.listing_by_memory(fleet).collect()]
    assert ids == ["c-c", "c-d", "c-a", "c-b"]  # 512/10 before 512/9
    assert [row.id for row in registry.listing_by_memory(fleet, 2).collect()] == ids[:2]


def test_container_state_of_given_ids(spark, fleet):
    ids = spark.createDataFrame([("c-a",), ("c-a",), ("none",)], "id string")
    rows = registry.container_state(fleet, ids, "fleet://m:1", "http://m:2").collect()
    assert [row.asDict() for row in rows] == [
        {
            "host": "h1", "port": 7078, "container_id": "c-a", "master_url": "fleet://m:1",
            "memory": 512, "memory_used": 10, "master_web_ui_url": "http://m:2",
        }
    ]


def test_container_document(fleet):
    text = export.container_json(fleet).filter("id = 'c-a'").first().json
    assert text == (
        '{"id":"c-a","host":"h1","port":7078,"webuiaddress":"http://h1:8082","memory":512,'
        '"memoryused":10,"memoryfree":502,"state":"ALIVE","lastheartbeat":1704067201500}'
    )


@pytest.mark.parametrize("condition", ["true", "id = 'c-d'", "false"])
def test_fleet_lines_are_one_document(fleet, condition, tmp_path):
    lines = export.fleet_json(fleet.filter(condition), 'fleet://"m":1')
    document = json.loads("\n".join(row.line for row in lines.collect()))
    assert list(document) == ["url", "workers", "memory", "memoryused", "status"]
    assert document["url"] == 'fleet://"m":1'
    ids = sorted(row.id for row in fleet.filter(condition).collect())
    assert [worker["id"] for worker in document["workers"]] == ids
    living = [worker for worker in document["workers"] if worker["state"] == "ALIVE"]
    assert document["memory"] == sum(worker["memory"] for worker in living)
    assert document["memoryused"] == sum(worker["memoryused"] for worker in living)

    lines.select("line").write.text(str(tmp_path / "fleet"))
    parts = sorted((tmp_path / "fleet").glob("part-*"))
    assert json.loads("".join(part.read_text() for part in parts)) == document


def test_attempts_name_their_tier(spark):
    reg = requests(spark, [(n, "a", "h") for n in range(19)] + [(3, "b", "h")])
    rows = registry.attempt_tiers(reg).orderBy("id", "attempt").collect()
    assert [row.attempt for row in rows] == [*range(19), 0]
    assert [row.tier for row in rows] == (
        ["FIRST"] + ["INITIAL"] * 6 + ["PROLONGED"] * 10 + ["GAVE_UP"] * 2 + ["FIRST"]
    )


def test_precondition_is_reported(spark):
    reg = requests(spark, [(1, "a", "h"), (2, "a", "k"), (3, "b", "h"), (4, "b", "h")])
    assert [row.id for row in registry.ids_with_many_addresses(reg).collect()] == ["a"]


def test_registrations_without_an_address_are_kept(spark):
    rows = [(1, 10, "a", None), (2, 11, "b", None), (3, 12, "a", None), (4, 13, "c", "x")]
    reg = spark.createDataFrame(rows, "seq long, s long, id string, address string").selectExpr(
        "seq", "timestamp_seconds(s) AS ts", "id", "address"
    )
    found = {r.seq: (r.outcome, r.message) for r in registry.registration_outcomes(reg).collect()}
    assert {k: v[0] for k, v in found.items()} == {
        1: "REGISTERED", 2: "DUPLICATE_ADDRESS", 3: "DUPLICATE_ID", 4: "REGISTERED"
    }
    assert found[2][1] == registry.DUPLICATE_ADDRESS_MESSAGE
