"""Round trips of files of planes, random access, damage, and ids against the tokenizer on whole texts."""

from __future__ import annotations

import io
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import MEDIUM

from rollcall.llm import token_planes as P
from rollcall.llm.packing import END_ID, tokenizer_path
from rollcall.llm.queries import op12_token_planes
from rollcall.sources import table

SCHEMA = "doc_id long, text string, key string, ids int, start string"


def whole_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [[*x.ids, END_ID] for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_whole_table(spark):
    documents = sorted((r.doc_id, r.text or "") for r in table(spark, MEDIUM, "documents").collect())
    rows = {r.doc_id: r for r in op12_token_planes(spark, MEDIUM).collect()}
    assert len(rows) == len(documents)
    start = 0
    for (key, _), ids in zip(documents, whole_ids([text for _, text in documents]), strict=True):
        r = rows[key]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


class Opened:
    def __init__(self, data):
        self.data = data

    def size(self):
        return len(self.data)

    def read_at(self, count, place):
        return self.data[place : place + count]


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("block", [1, 7, 64])
def test_planes_and_random_access(bits, block):
    rng = np.random.default_rng(bits * block)
    lengths = rng.integers(0, 30, 40)
    ids = rng.integers(0, 1 << 32, lengths.sum(), np.uint64).astype(np.uint32)
    ids[: len(ids) // 3] %= 50_000
    keys = pa.array([None if k == 3 else k - 5 for k in range(40)], pa.int64())
    out = io.BytesIO()
    writer = P.PlaneWriter(out, bits, block)
    ends = np.cumsum(lengths)
    for a, b in ((0, 1), (1, 25), (25, 40)):
        writer.add(keys.slice(a, b - a), lengths[a:b], ids[ends[a] - lengths[a] : ends[b - 1]])
    writer.finish()
    file = P.PlaneFile(Opened(out.getvalue()))
    assert file.keys.equals(keys) and file.lengths.tolist() == lengths.tolist()
    for a, b in [(0, len(ids)), (0, 0), (5, 6), (len(ids) - 1, len(ids)), *rng.integers(0, len(ids), (20, 2)).tolist()]:
        assert np.array_equal(file.ids(a, b), ids[a:b] if a < b else [])
    assert np.array_equal(P.from_planes(P.to_planes(ids, bits), len(ids), bits), ids)


def test_a_file_without_documents_and_damage():
    out = io.BytesIO()
    P.PlaneWriter(out).finish()
    assert len(P.PlaneFile(Opened(out.getvalue())).keys) == 0
    writer = P.PlaneWriter(out := io.BytesIO())
    writer.add(pa.array([1]), np.array([1000]), np.arange(1000, dtype=np.uint32))
    writer.finish()
    for place in (30, len(out.getvalue()) - 40, len(out.getvalue()) - 3):
        data = bytearray(out.getvalue())
        data[place] ^= 1
        with pytest.raises(Exception):  # noqa: B017  a frame, a block, the index or the trailer
            P.PlaneFile(Opened(bytes(data))).ids(0, 1000)
    with pytest.raises(ValueError, match="whole"):
        P.PlaneFile(Opened(b"short"))
    with pytest.raises(ValueError, match="bits"):
        P.PlaneWriter(io.BytesIO(), 4)


@pytest.mark.parametrize("bits", [1, 8])
def test_edges(spark, tmp_path, bits):
    texts = [(5, "five"), (None, "no key"), (2, None), (2, ""), (7, "hot " * 50), (7, "hot " * 50), *[(3, f"hot key {k}") for k in range(60)], (-1, "long " * 200_000), (9, "<|endoftext|> é"), (1 << 62, "far")]
    rows = [(k, t, "k", 1, None) for k, t in texts]
    folder = f"file://{tmp_path}"
    manifest = P.write(spark.createDataFrame(rows, SCHEMA).repartition(5), folder, shards=6, bits=bits, block=64)
    assert manifest.count() > 3  # the hot key does not make one shard of all
    found = P.read(manifest, folder).orderBy("start").collect()
    keys = [r.doc_id for r in found]
    assert keys == sorted((k for k, _ in texts), key=lambda k: (k is not None, k or 0))
    start = 0
    for r in found:
        assert (r.start, 4 * r.n_tokens) == (start, len(r.ids))
        start += r.n_tokens
    ids = dict(zip(texts, whole_ids([t or "" for _, t in texts]), strict=True))
    got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in found)
    assert got == sorted((str(k), ids[k, t]) for k, t in texts)
    empty = P.write(spark.createDataFrame([], SCHEMA), f"{folder}/none")
    assert empty.count() == 0 and P.read(empty, f"{folder}/none").count() == 0


def test_equal_files_on_each_run_and_unlisted_files(spark, tmp_path):
    documents = table(spark, MEDIUM, "documents").where("doc_id < 300")
    manifests = [P.write(documents, f"file://{tmp_path}/{turn}", shards=3) for turn in range(2)]
    assert sorted(map(tuple, manifests[0].collect())) == sorted(map(tuple, manifests[1].collect()))
    Path(f"{tmp_path}/0/99999999.planes").write_bytes(b"left by an attempt that was never listed")
    assert P.read(manifests[0], f"file://{tmp_path}/0").count() == documents.count()
    file = Path(f"{tmp_path}/1/{manifests[1].first().file}")
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="whole|trailer|planes"):
        P.read(manifests[1], f"file://{tmp_path}/1").collect()


def test_words_are_learnt_again_when_there_are_too_many():
    tokenizer = P.TableTokenizer(tokenizer_path(), known=50)
    for turn in range(6):
        texts = [" ".join(f"w{chr(97 + (k * 7 + turn) % 26)}x{k * turn}" for k in range(100)), "", "Ünï Code."]
        ids, bounds = tokenizer.encode(pa.array(texts, pa.large_string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [x[:-1] for x in whole_ids(texts)]
