from __future__ import annotations

from conftest import SMALL
from pyspark import StorageLevel

from rollcall.operators import cache
from rollcall.sources import table


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def grouped(frame):
    return frame.filter("l_quantity > 30").groupBy("l_returnflag").count()


def test_pinned_table_is_scanned_in_memory_and_released(spark):
    lineitem = table(spark, SMALL, "lineitem")
    uncached = sorted(grouped(lineitem).collect())
    pinned = cache.cached(lineitem, ["l_returnflag", "l_quantity", "l_tax"])
    try:
        assert pinned.storageLevel == StorageLevel.MEMORY_AND_DISK
        query = grouped(pinned)
        assert sorted(query.collect()) == uncached
        text = plan(query)
        scan = text.split("InMemoryTableScan")[1].split("\n")[0]
        assert "l_tax" not in scan and "l_quantity" in scan and "> 30.0" in scan
    finally:
        released = cache.release(pinned)
    after = grouped(released)
    assert sorted(after.collect()) == uncached
    assert "InMemoryTableScan" not in plan(after)


def test_footprint(spark):
    pinned = cache.cached(spark.range(0, 100, 1, 4).filter("id < 25 or id >= 90"))
    row = cache.partition_footprint(pinned).first()
    assert (row.partitions, row.rows, row.largest, row.mean) == (2, 35, 25, 17.5)
    assert row.skew == 25 / 17.5
    assert {tuple(part) for part in cache.partition_rows(pinned).collect()} == {(0, 25), (3, 10)}
    cache.release(pinned)
    assert cache.partition_footprint(spark.range(0)).first().rows == 0


def test_releasing_one_pin_leaves_another(spark):
    lineitem = table(spark, SMALL, "lineitem")
    one, other = (cache.cached(lineitem, ["l_returnflag", "l_quantity"]) for _ in range(2))
    try:
        assert one.count() == other.count() == lineitem.count()
        assert not cache.release(one).storageLevel.useMemory
        assert other.storageLevel.useMemory and "InMemoryTableScan" in plan(grouped(other))
    finally:
        cache.release(other)


def test_several_queries_on_one_pin(spark):
    seen = []

    def query(frame):
        seen.append(frame.storageLevel.useMemory)
        return grouped(frame)

    rows = cache.on_pinned(table(spark, SMALL, "lineitem"), None, [query, query]).collect()
    assert seen == [True, True] and len(rows) == 2 * len(set(rows))
    assert not spark.sparkContext._jsc.getPersistentRDDs().size()
