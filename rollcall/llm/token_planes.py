"""Token ids as binary files: blocks of ids transposed into planes, each compressed, with an index.

Documents are dealt by ranges of their key, so a shard is a run of the ascending order; its task tokenises
the documents and writes one file as they come:

* header: ``MAGIC``, bits in a plane (1 or 8), ids in a block, as little-endian 32-bit numbers;
* blocks of ``block`` ids (the last may be shorter). An id is 32 bits; plane k of a block holds bits or bytes k of all
  its ids, least significant first, and is one zstandard frame, or nothing if all are zero;
* index: a zstandard frame of the documents' keys, of which keys are null, the documents' lengths, and for each block its place, its ids, its
  checksum and the sizes of its planes;
* trailer: place and size of the index, its checksum, ``MAGIC``.

The chunk index lets a reader take any run of ids by decoding the blocks it lies in. A file is written under the name
of its attempt and then moved, and counts only if the manifest, written when all shards are done, lists it: a
task that is run again writes the same bytes under the same name.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm import words as W
from rollcall.llm.packing import END_ID, TableTokenizer, tokenizer_path
from rollcall.llm.tables import stored

#: Fixed values of the file format.
MAGIC = b"IDPLANE1"
_HEAD, _TRAILER = "<8sII", "<QQI8s"
#: Ids in a block.
BLOCK = 1 << 16
#: Ids read at once, or one document's if it has more.
READ_IDS = 1 << 20
#: So many shards at most: a manifest has one row for each.
MOST_SHARDS = 1 << 16


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The 32 / ``bits`` planes of an array of 32-bit ids, least significant first."""
    as_bytes = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [as_bytes[:, k].tobytes() for k in range(4)]
    spread = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [row.tobytes() for row in np.packbits(spread.T, axis=1, bitorder="little")]


def from_planes(planes: list[bytes], count: int, bits: int) -> np.ndarray:
    """The ids whose planes these are; an empty plane is all zero."""
    if bits == 8:
        as_bytes = np.zeros((count, 4), np.uint8)
        for k, plane in enumerate(planes):
            if plane:
                as_bytes[:, k] = np.frombuffer(plane, np.uint8)
        return as_bytes.view("<u4").ravel()
    spread = np.zeros((32, count), np.uint8)
    for k, plane in enumerate(planes):
        if plane:
            spread[k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=count, bitorder="little")
    return np.ascontiguousarray(np.packbits(spread.T, axis=1, bitorder="little")).view("<u4").ravel()


class PlaneWriter:
    """One file, written block by block to an open stream."""

    def __init__(self, stream, bits: int = 8, block: int = BLOCK, level: int = 1):
        import zstandard

        if bits not in (1, 8):
            raise ValueError("a plane has 1 or 8 bits of each id")
        self.stream, self.bits, self.block, self.packer = stream, bits, block, zstandard.ZstdCompressor(level=level)
        self.size, self.sum, self.waiting, self.held = 0, hashlib.sha256(), [], 0
        self.keys, self.lengths, self.blocks = [], [], []
        self._put(struct.pack(_HEAD, MAGIC, bits, block))

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.sum.update(data)
        self.size += len(data)

    def add(self, keys: pa.Array, lengths: np.ndarray, ids: np.ndarray) -> None:
        """Some documents: their keys (long), their lengths and all their ids, one document after the other."""
        self.keys.append(keys)
        self.lengths.append(np.asarray(lengths, "<i8"))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            every = np.concatenate(self.waiting)
            whole = len(every) - len(every) % self.block
            for at in range(0, whole, self.block):
                self._block(every[at : at + self.block])
            self.waiting, self.held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        data = np.ascontiguousarray(ids, "<u4")
        frames = [self.packer.compress(plane) if np.frombuffer(plane, np.uint8).any() else b"" for plane in to_planes(data, self.bits)]
        self.blocks.append((self.size, len(ids), zlib.crc32(data), *map(len, frames)))
        for frame in frames:
            self._put(frame)

    def finish(self) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        keys = pa.chunked_array(self.keys, pa.int64()).combine_chunks() if self.keys else pa.array([], pa.int64())
        missing = keys.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        parts = [
            np.array([len(keys), len(self.blocks)], "<u8"),
            keys.fill_null(0).to_numpy().astype("<i8"),
            missing,
            np.concatenate(self.lengths) if self.lengths else np.zeros(0, "<i8"),
            np.array(self.blocks, "<u8"),
        ]
        index = self.packer.compress(b"".join(x.tobytes() for x in parts))
        place = self.size
        self._put(index)
        self._put(struct.pack(_TRAILER, place, len(index), zlib.crc32(index), MAGIC))


class PlaneFile:
    """An open file: its documents, and any run of its ids."""

    def __init__(self, file):
        import zstandard

        self.file, self.unpacker = file, zstandard.ZstdDecompressor()
        size = file.size()
        head, trailer = struct.calcsize(_HEAD), struct.calcsize(_TRAILER)
        if size < head + trailer:
            raise ValueError("not a whole file of planes")
        magic, self.bits, self.block = struct.unpack(_HEAD, file.read_at(head, 0))
        place, length, check, end = struct.unpack(_TRAILER, file.read_at(trailer, size - trailer))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a whole file of planes")
        index = file.read_at(length, place)
        if zlib.crc32(index) != check:
            raise ValueError("the index of a file of planes is damaged")
        data = self.unpacker.decompress(index)
        documents, blocks = np.frombuffer(data, "<u8", 2).tolist()
        keys = np.frombuffer(data, "<i8", documents, 16)
        at = 16 + 8 * documents
        missing = np.frombuffer(data, np.uint8, documents, at).astype(bool)
        self.keys = pa.array(keys, pa.int64(), mask=missing)
        self.lengths = np.frombuffer(data, "<i8", documents, at + documents)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        table = np.frombuffer(data, "<u8", -1, at + 9 * documents).reshape(blocks, 3 + 32 // self.bits)
        self.blocks = table.astype(np.int64)
        self.known: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def _block(self, number: int) -> np.ndarray:
        if self.known[0] != number:
            place, count, check, *sizes = self.blocks[number].tolist()
            data, planes, at = self.file.read_at(sum(sizes), place), [], 0
            for size in sizes:
                planes.append(self.unpacker.decompress(data[at : at + size]) if size else b"")
                at += size
            ids = from_planes(planes, count, self.bits)
            if zlib.crc32(ids) != check:
                raise ValueError(f"block {number} of a file of planes is damaged")
            self.known = number, ids
        return self.known[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks they lie in."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        parts = [self._block(at) for at in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


def write(
    documents: DataFrame, folder: str, vocabulary: str | None = None, shards: int | None = None, bits: int = 8, block: int = BLOCK,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Write the ids of all documents under ``folder`` in ascending key order; the manifest: shard, file, documents, ids, bytes, sha256.

    A document's ids are those of its text (null: empty) followed by ``END_ID``. ``folder`` is a URI all executors can write to.
    ``shards`` (default: the session's shuffle partitions) is how many ranges of keys there are at most. Null keys come first; rows with one
    key come by a hash of their text and may be in several shards, so a hot key is split; repeated rows are documents each. An
    empty table gives an empty manifest. Other columns are not read. Keys are taken as long.
    """
    spark = documents.sparkSession
    shards = min(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SHARDS)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        context, writer, stream, count, total = TaskContext.get(), None, None, 0, 0
        shard = context.partitionId()
        for batch in batches:
            for first, texts in W.slices(batch.column(1)):
                if writer is None:
                    tokenizer = TableTokenizer(vocabulary or tokenizer_path())
                    system, root = fs.FileSystem.from_uri(folder)
                    system.create_dir(root, recursive=True)
                    name = f"{shard:08d}.planes"
                    temporary, final = f"{root}/.{name}.{context.taskAttemptId()}", f"{root}/{name}"
                    stream = system.open_output_stream(temporary, compression=None)
                    writer = PlaneWriter(stream, bits, block)
                ids, bounds = tokenizer.encode(texts)
                lengths = np.diff(bounds) + 1
                writer.add(batch.column(0).slice(first, len(texts)), lengths, np.insert(ids, bounds[1:], END_ID))
                count, total = count + len(texts), total + int(lengths.sum())
        if writer is not None:
            writer.finish()
            stream.close()
            if system.get_file_info(final).type != fs.FileType.NotFound:
                system.delete_file(final)  # of an earlier attempt, with the same bytes
            system.move(temporary, final)
            row = [[shard], [name], [count], [total], [writer.size], [writer.sum.hexdigest()]]
            yield pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), *map(pa.array, row[1:])], names=["shard", "file", "documents", "ids", "bytes", "sha256"])

    rows = documents.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    # The last two keys spread rows of one key over shards, also equal ones.
    rows = rows.withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shards, "key", "tie", "place").sortWithinPartitions("key", "tie", "place").select("key", "text")
    return stored(rows.mapInArrow(archive, "shard int, file string, documents long, ids long, bytes long, sha256 string"), "planes-manifest")


def read(manifest: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) of all documents in the manifest's files; ids: little-endian unsigned 32-bit numbers.

    ``start`` is the number of ids of all documents before. Checksums of index and blocks are checked, and what the
    manifest says of a file. Only files in the manifest are read, each by one task that holds some blocks at a time.
    """
    rows = sorted(manifest.select("shard", "file", "documents", "ids", "bytes").collect())  # MOST_SHARDS at most
    before, listed = 0, []
    for row in rows:
        listed.append((row.shard, row.file, row.documents, row.ids, row.bytes, before))
        before += row.ids

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for _, name, documents, ids, size, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{root}/{name}") as opened:
                    file = PlaneFile(opened)
                    if (len(file.keys), int(file.starts[-1]), opened.size()) != (documents, ids, size):
                        raise ValueError(f"{name} is not what the manifest says")
                    first = 0
                    while first < documents:
                        last = max(first + 1, int(np.searchsorted(file.starts, file.starts[first] + READ_IDS, side="right")) - 1)
                        starts = file.starts[first : last + 1]
                        data = file.ids(int(starts[0]), int(starts[-1]))
                        offsets = ((starts - starts[0]) * 4).astype(np.int32)
                        packed = pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data, "<u4"))])
                        yield pa.RecordBatch.from_arrays(
                            [file.keys.slice(first, last - first), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), packed], names=["key", "start", "n_tokens", "ids"]
                        )
                        first = last

    spark = manifest.sparkSession
    files = spark.createDataFrame(listed, "shard int, file string, documents long, ids long, bytes long, base long")
    found = files.repartition(max(len(listed), 1)).mapInArrow(unpack, "key long, start long, n_tokens long, ids binary")
    return found.withColumnRenamed("key", key)
