"""One document of any size as a folder of ordered parts and a manifest, written and read by Spark.

``df.write.format("rollcall_document")`` writes the column ``line`` of an ordered frame: each task writes its
lines to a part of its own, under a name no other attempt has. When all tasks are done, the parts of the
attempts that count get their offsets by a running sum of sizes, and ``manifest.json``
comes into being by one rename. Without a manifest there is no document; what a failed or
repeated attempt left behind is in no manifest and is never read. The parts in order of the manifest are the document.

``spark.read.format("rollcall_document")`` gives ``offset, line``, one task for each part, and fails if
a part has not the size and digest of the manifest. :func:`chunks` streams the bytes of the whole.

The driver holds one small row for each part, and no task more than a line at a time.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "rollcall_document"
MANIFEST = "manifest.json"
_CHUNK = 1 << 20


@dataclass
class Part(WriterCommitMessage):
    """What one task wrote; without lines there is no file."""

    number: int
    file: str
    lines: int
    bytes: int
    sha256: str


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, at: int) -> None:
        self.folder, self.at = folder, at

    def write(self, iterator: Iterator) -> Part:
        system, root = _system(self.folder)
        number = TaskContext.get().partitionId()
        name = f"part-{number:08d}-{uuid.uuid4().hex}"
        stream, lines, size, digest = None, 0, 0, hashlib.sha256()
        for row in iterator:
            if stream is None:
                system.create_dir(root, recursive=True)
                stream = system.open_output_stream(f"{root}/{name}")
            if row[self.at] is None or "\n" in row[self.at]:
                raise ValueError("a line is null or holds a line break")
            data = row[self.at].encode() + b"\n"
            stream.write(data)
            digest.update(data)
            lines, size = lines + 1, size + len(data)
        if stream is not None:
            stream.close()
        return Part(number, name if lines else "", lines, size, digest.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        system, root = _system(self.folder)
        offset, first_line, parts = 0, 0, []
        for part in sorted((m for m in messages if m is not None and m.file), key=lambda m: m.number):
            parts.append({"file": part.file, "offset": offset, "first_line": first_line, "lines": part.lines, "bytes": part.bytes, "sha256": part.sha256})
            offset, first_line = offset + part.bytes, first_line + part.lines
        system.create_dir(root, recursive=True)
        temporary = f"{root}/.{MANIFEST}.{uuid.uuid4().hex}"
        with system.open_output_stream(temporary) as stream:
            stream.write(json.dumps({"bytes": offset, "lines": first_line, "parts": parts}).encode())
        system.move(temporary, f"{root}/{MANIFEST}")

    def abort(self, messages: list[Part | None]) -> None:
        system, root = _system(self.folder)
        for part in messages:
            if part is not None and part.file:
                system.delete_file(f"{root}/{part.file}")


@dataclass
class _Range(InputPartition):
    file: str
    offset: int
    bytes: int
    sha256: str


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[_Range]:
        return [_Range(p["file"], p["offset"], p["bytes"], p["sha256"]) for p in manifest(self.folder)["parts"]] or [_Range("", 0, 0, "")]

    def read(self, partition: _Range) -> Iterator[tuple[int, str]]:
        if not partition.file:
            return
        system, root = _system(self.folder)
        offset, digest = partition.offset, hashlib.sha256()
        with system.open_input_stream(f"{root}/{partition.file}") as stream:
            rest = b""
            while data := stream.read(_CHUNK):
                digest.update(data)
                *lines, rest = (rest + data).split(b"\n")
                for line in lines:
                    yield offset, line.decode()
                    offset += len(line) + 1
        if rest or digest.hexdigest() != partition.sha256 or offset - partition.offset != partition.bytes:
            raise ValueError(f"{partition.file} is not what the manifest says")


class Document(DataSource):
    """The format; its one option is ``path``, a URI every executor can reach."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "offset bigint, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        from pyarrow import fs

        system, root = _system(self.options["path"])
        if system.get_file_info(f"{root}/{MANIFEST}").type != fs.FileType.NotFound:
            raise ValueError(f"{self.options['path']} holds a document already")
        return _Writer(self.options["path"], schema.names.index("line"))


def write_document(lines: DataFrame, folder: str) -> None:
    """Write the column ``line`` of an ordered frame as one document; other columns are not written."""
    lines.sparkSession.dataSource.register(Document)
    lines.select("line").write.format(FORMAT).mode("append").option("path", folder).save()


def read_document(spark: SparkSession, folder: str) -> DataFrame:
    """``offset, line``: each line of a written document and the byte it starts at."""
    spark.dataSource.register(Document)
    return spark.read.format(FORMAT).option("path", folder).load()


def manifest(folder: str) -> dict:
    """Size and parts of a written document."""
    system, root = _system(folder)
    with system.open_input_stream(f"{root}/{MANIFEST}") as stream:
        return json.loads(stream.read())


def chunks(folder: str) -> Iterator[bytes]:
    """The bytes of a written document in order, a bounded piece at a time."""
    system, root = _system(folder)
    for part in manifest(folder)["parts"]:
        with system.open_input_stream(f"{root}/{part['file']}") as stream:
            while data := stream.read(_CHUNK):
                yield data
