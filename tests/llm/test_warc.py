"""Archives: exact round trip, equal bytes on each run, and what is refused."""

from __future__ import annotations

import gzip
import hashlib
from pathlib import Path

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from rollcall.llm import warc
from rollcall.llm.queries import op9_warc
from rollcall.sources import table

SCHEMA = "page_id long, url string, html string, digest string, shard string"


def expected(rows):
    newest = {}
    for page, html in rows:
        payload = (html or "").encode()
        if len(payload) >= 1000 and page is not None:
            newest[payload] = max(page, newest.get(payload, page))
    out = []
    for page, html in rows:
        payload = (html or "").encode()
        to = newest.get(payload)
        to = None if to == page else to
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def seen(rows):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str)


def test_whole_table(spark):
    assert seen(op9_warc(spark, MEDIUM).collect()) == expected([(r.page_id, r.html) for r in table(spark, MEDIUM, "pages").collect()])


def edge_rows():
    long = "é" * 600
    return [(1, "http://a/ b\r\nX: y", long, "d", "s"), (3, None, long, "d", "s"), (2, "", long, None, None), (2, "", long, None, None), (4, "u", "x" * 999, "", ""),
            (5, "u", "x" * 999, "", ""), (6, "u", None, "", ""), (7, "u", "", "", ""), (None, "u", long, "", ""), (-10, "u", "WARC/1.1\r\n\r\n" * 200, "", ""), (10**12, "u", "z" * 3_000_000, "", "")]


def test_edges_and_equal_bytes(spark, tmp_path):
    frame, sums = spark.createDataFrame(edge_rows(), SCHEMA), []
    for turn, parts in enumerate((1, 5)):
        folder = f"file://{tmp_path}/{turn}"
        Path(f"{tmp_path}/{turn}").mkdir()
        manifest = warc.write(frame.repartition(parts), folder, shard_bytes=3000, roll_bytes=500)
        back = warc.read(manifest, folder).collect()
        assert seen(back) == expected([(r[0], r[2]) for r in edge_rows()])
        payloads = {r.page_id: r.payload for r in back if r.record_type == "response"}
        assert payloads[3].decode() == "é" * 600 and len(payloads[10**12]) == 3_000_000
        sums.append(sorted(map(tuple, manifest.collect())))
    assert sums[0] == sums[1] and len(sums[0]) > 3
    text = gzip.decompress(b"".join(p.read_bytes() for p in sorted(Path(f"{tmp_path}/0").glob("*.warc.gz"))))
    assert text.count(b"WARC-Type: revisit") == 4 and b"\r\nX: y" not in text


def test_damage_and_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    assert warc.write(spark.createDataFrame([], SCHEMA), folder).count() == 0
    manifest = warc.write(spark.createDataFrame(edge_rows()[:4], SCHEMA), folder)
    Path(f"{tmp_path}/99999999-00000.warc.gz").write_bytes(b"left by an attempt that was never listed")
    assert warc.read(manifest, folder).count() == 4
    file = Path(f"{tmp_path}/{manifest.first().file}")
    data = bytearray(file.read_bytes())
    data[-5] ^= 1
    file.write_bytes(bytes(data))
    with pytest.raises(Exception, match="incorrect data check|manifest"):
        warc.read(manifest, folder).collect()


@pytest.mark.parametrize("outlier", [2**62, None])
def test_outlying_and_null_ids_do_not_fill_one_shard(spark, tmp_path, outlier):
    rows = [(None if outlier is None else n, "u", f"page {n} " * 20, "", "") for n in range(2000)] + [(outlier, "u", "far", "", "")]
    manifest = warc.write(spark.createDataFrame(rows, SCHEMA).repartition(4), f"file://{tmp_path}", shard_bytes=64_000)
    records = {r.shard: r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()}
    assert sum(records.values()) == len(rows) and len(records) > 20 and max(records.values()) < 150
    assert seen(warc.read(manifest, f"file://{tmp_path}").collect()) == expected([(r[0], r[2]) for r in rows])
