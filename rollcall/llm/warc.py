"""WARC archives of pages: a deterministic sharded writer, and a reader that checks digests.

Pages are sorted by id into shards whose bounds follow from the sizes of the payloads alone.
A shard is one task: it writes its records in order, each a gzip member, and starts a new file when
a file has ``roll_bytes`` of compressed records. A file gets its name when it is complete: it
is written under a temporary name, then moved. Files count only if the manifest, a table written
when all shards are done, lists them. A task that is run again writes the same bytes under the same
names, so lost executors leave nothing but temporary files.

Of records with equal payloads of at least ``revisit_bytes`` bytes, the one with the largest page id is the
response and the others are revisits, which refer to it and hold no payload.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.llm.tables import stored
from rollcall.plans.skew import CELL, cut
from rollcall.sources.workspace import new_folder

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records get this date unless told otherwise, so equal input gives equal bytes.
DATE = "2024-01-01T00:00:00Z"
#: Shard bounds are placed between this many ranges of page ids at most.
GRANULES = 32_768


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: headers, block, and the two line ends that close it."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url else f"urn:page:{page}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
    ]
    if page is not None:
        headers.append(("X-Page-Id", str(page)))
    if refers_to is not None:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-Id", str(refers_to))]
    headers.append(("Content-Length", str(len(block))))
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """The data as one gzip member without a time stamp."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Files:
    """The files of one shard."""

    def __init__(self, folder: str, shard: int, attempt: str, roll_bytes: int):
        from pyarrow import fs

        self.system, self.root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.root, recursive=True)
        self.shard, self.attempt, self.roll_bytes = shard, attempt, roll_bytes
        self.number, self.stream, self.done = 0, None, []

    def _names(self) -> tuple[str, str]:
        name = f"{self.shard:08d}-{self.number:05d}.warc.gz"
        return f"{self.root}/.{name}.{self.attempt}", f"{self.root}/{name}"

    def add(self, member: bytes) -> None:
        if self.stream is None:
            self.stream, self.size, self.count, self.sum = self.system.open_output_stream(self._names()[0], compression=None), 0, 0, hashlib.sha256()
        self.stream.write(member)
        self.sum.update(member)
        self.size, self.count = self.size + len(member), self.count + 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        self.stream.close()
        temporary, final = self._names()
        from pyarrow import fs

        if self.system.get_file_info(final).type != fs.FileType.NotFound:
            self.system.delete_file(final)  # of an earlier attempt, with the same bytes
        self.system.move(temporary, final)
        self.done.append((self.shard, final.rsplit("/", 1)[1], self.count, self.size, self.sum.hexdigest()))
        self.stream, self.number = None, self.number + 1


def _shards(narrow: DataFrame, shard_bytes: int) -> list[tuple[int, int]]:
    """Where the second and later shards start, as places ``(page_id, tie)``.

    A hash picks about GRANULES of the places, whatever their values, and shards of about ``shard_bytes`` are made of what lies
    between them, so neither an outlying id nor a great many equal or null ones put more into one shard. The driver holds
    one place and one sum for each granule.
    """
    every = max(1, -(-narrow.count() // GRANULES))
    picks = narrow.select(F.struct("page_id", "tie").alias("place")).where(F.pmod(F.xxhash64("place"), F.lit(every)) == 0).distinct()
    starts = [tuple(row) for row in picks.select("place.*").orderBy("page_id", "tie").collect()]
    cells = cut(narrow, F.col("page_id"), "tie", starts).groupBy(CELL).agg(F.sum(F.col("payload_bytes") + 600).alias("bytes"))
    bounds, total, shard = [], 0, 0
    for cell, size in sorted(map(tuple, cells.collect())):
        if total // shard_bytes > shard:
            bounds.append(starts[cell - 1])
            shard = total // shard_bytes
        total += size
    return bounds


def write(
    pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 4 << 20, revisit_bytes: int = 1000, date: str = DATE,
    key: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """Write all pages under ``folder`` and return the manifest: shard, file, records, bytes, sha256.

    ``folder`` is a URI that all executors can write to. A null html is an empty payload; a null
    url gets a urn of the page; a null id has no id header, and never is what others refer to. Rows that
    repeat an id and a payload are records each, of one type, and in one shard. An empty table gives an empty manifest.
    Other columns are not read.
    """
    payload = F.coalesce(F.col(html).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    # The digest's first 60 bits: in one order with it, as a number.
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("tie", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long"))
    narrow = stored(rows.select("page_id", "digest", "tie", F.length("payload").cast("long").alias("payload_bytes")), "payloads")
    equal = narrow.where(F.col("payload_bytes") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    equal = stored(equal.where("n > 1").select("digest", "newest"), "equal-payloads")
    bounds = _shards(narrow, shard_bytes)
    revisit = (F.col("page_id") != F.col("newest")) | (F.col("page_id").isNull() & F.col("newest").isNotNull())
    rows = cut(rows.join(equal, "digest", "left").withColumn("refers_to", F.when(revisit, F.col("newest"))), F.col("page_id"), "tie", bounds)
    rows = rows.select(F.col(CELL).cast("int").alias("shard"), "page_id", "digest", "url", "refers_to", "payload")
    rows = rows.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("page_id", "digest", "url")

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for batch in batches:
            for shard, page, digest, target, refers_to, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if files is None:
                    files = _Files(folder, shard, f"{TaskContext.get().taskAttemptId()}", roll_bytes)
                files.add(gzip_member(record(page, target, body, digest, refers_to, date)))
        if files is not None:
            files.close()
            columns = [pa.array(x) for x in zip(*files.done, strict=True)]
            yield pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], names=["shard", "file", "records", "bytes", "sha256"])

    return stored(rows.mapInArrow(archive, "shard int, file string, records long, bytes long, sha256 string"), "manifest")


def _members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Unpacked gzip members, one at a time."""
    rest, unpacker, parts = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(chunk)
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    if headers["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
    return headers, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records in the manifest's files.

    Block, payload and file digests are checked; a file is read as a stream, one record in memory
    at a time. The payload of a revisit is null. Only files in the manifest are read.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for file, size, expected in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                checked = _Checked(system.open_input_stream(f"{root}/{file}", compression=None))
                for member in _members(checked):
                    headers, block = parsed(member)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
                    length = int(http.rsplit(b"Content-Length: ", 1)[1])
                    page, other = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                    rows.append((page and int(page), headers["WARC-Target-URI"], length, digest, kind, other and int(other), payload if kind == "response" else None))
                    held += len(payload)
                    if held > 1 << 22 or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if (checked.size, checked.sum.hexdigest()) != (size, expected):
                    raise ValueError(f"{file} is not what the manifest says")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("file", "bytes", "sha256").mapInArrow(unpack, schema)


class _Checked:
    """A stream that sums what is read."""

    def __init__(self, stream):
        self.stream, self.size, self.sum = stream, 0, hashlib.sha256()

    def read(self, count: int) -> bytes:
        data = self.stream.read(count)
        self.size += len(data)
        self.sum.update(data)
        return data


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives, as a URI of the file system that Spark takes the path for."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, "warc"))
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return uri if "://" in uri else uri.replace("file:/", "file:///", 1)
