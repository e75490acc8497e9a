"""WARC archives in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about a mebibyte; a
bundle ends with the public seek-table footer (a skippable frame of the
compressed and decompressed size of every frame), so any reader of plain
``.warc.zst`` reads it through and a seeking reader goes straight to one
frame. The index row of a record names its bundle, frame and the offset inside
the frame. Bundles are written through the file system that the shared
folder's path names; a repeated task writes a bundle of its own and only the
index rows of the task that won are kept, so lost executors leave no gap.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm._store import materialise, scratch_path
from tessera.llm._worker import task

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Packed bytes that one task reads back, about; so many tasks at most.
READ_BYTES, READ_TASKS = 4 << 20, 20_000
LEVEL = 3
#: Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
MIN_DEDUP_BYTES = 0
_DATE = "1970-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class SeekableWriter:
    """Appends records to frames and closes with the seek table."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        self.stream, self.limit = stream, frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.pending: list[bytes] = []
        self.held = self.written = 0
        self.frames: list[tuple[int, int]] = []

    def add(self, record: bytes) -> tuple[int, int]:
        """Frame number and offset in the decompressed frame."""
        if self.pending and self.held + len(record) > self.limit:
            self.flush()
        place = (len(self.frames), self.held)
        self.pending.append(record)
        self.held += len(record)
        return place

    def flush(self) -> None:
        if self.pending:
            packed = self.compressor.compress(b"".join(self.pending))
            self.stream.write(packed)
            self.frames.append((len(packed), self.held))
            self.written += len(packed)
            self.pending, self.held = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


class SeekableReader:
    """Reads the seek table from the end, then single frames."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", stream.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 0x80 else 8
        stream.seek(size - 9 - count * width)
        table = stream.read(count * width)
        self.frames, at = [], 0
        for k in range(count):
            packed, plain = struct.unpack_from("<II", table, k * width)
            self.frames.append((at, packed, plain))
            at += packed
        self.last: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.last[0] != k:
            at, packed, plain = self.frames[k]
            self.stream.seek(at)
            self.last = (k, zstandard.ZstdDecompressor().decompress(self.stream.read(packed), max_output_size=plain))
        return self.last[1]


def warc_record(kind: str, page_id: int | None, uri: str, digest: str, payload: bytes, refers_to: int | None = None, refers_uri: str | None = None) -> bytes:
    """One WARC/1.1 record under an id of its own.

    A response holds the HTTP message of the page; a revisit has an empty
    block and names the payload it repeats. The page ids stand in headers of
    their own, so repeated or missing ones make no record ids collide.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = b"" if kind == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {' '.join(uri.split())}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To-Target-URI: {' '.join((refers_uri or '').split())}", f"WARC-Refers-To-Date: {_DATE}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(frame: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record at an offset."""
    end = frame.index(b"\r\n\r\n", at)
    lines = frame[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no record at this offset")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = frame[end + 4 : end + 4 + int(head["content-length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :] if block else block


_INDEX = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("bundle", T.StringType()), T.StructField("bundle_bytes", T.LongType()), T.StructField("frame", T.IntegerType()), T.StructField("offset", T.LongType())]
)
_RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def write_archives(spark: SparkSession, pages: DataFrame, folder: str, unit: str = "page_id", url: str = "url", page: str = "html", min_dedup_bytes: int = MIN_DEDUP_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` to bundles in ``folder``; returns the index.

    Of rows with equal payloads of at least ``min_dedup_bytes`` the one of the
    smallest id is the response and the others revisit it; rows of that same
    id are all responses. A null page is an empty payload, a null url an empty
    one. Rows of null id are responses, except where an id has their payload.
    An empty table writes no bundle; a very long page is a record, and a frame,
    of its own. Other columns, whatever their names, are ignored.
    """
    base = pages.select(F.col(unit).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(page).cast("string"), F.lit("")).alias("html"))
    digest = F.sha1(F.encode("html", "utf-8"))
    large = F.octet_length("html") >= min_dedup_bytes
    groups = base.where(large).select(digest.alias("digest"), "page_id", F.substring("url", 1, 2048).alias("url")).groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and least is not null").select("digest", F.col("least").alias("first"), F.col("first.url").alias("first_url"))
    typed = base.withColumn("digest", digest).join(groups, "digest", "left")
    again = F.col("first").isNotNull() & F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)) & large
    typed = typed.select("page_id", "url", "html", "digest", F.when(again, F.col("first")).alias("refers_to"), F.when(again, F.col("first_url")).alias("refers_url"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        writer = stream = None
        name, rows = "", []

        def finish() -> pa.RecordBatch:
            writer.close()
            stream.close()
            size = system.get_file_info(f"{root}/{name}").size
            ids, frames, offsets = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([name] * len(ids)), pa.array([size] * len(ids), pa.int64()), pa.array(frames, pa.int32()), pa.array(offsets, pa.int64())], names=[f.name for f in _INDEX]
            )

        for batch in batches:
            for k in range(batch.num_rows):
                if writer is None:
                    name, rows = f"{uuid.uuid4().hex}.warc.zst", []
                    stream = system.open_output_stream(f"{root}/{name}", compression=None)
                    writer = SeekableWriter(stream)
                key, refers = batch.column("page_id")[k].as_py(), batch.column("refers_to")[k].as_py()
                payload = batch.column("html")[k].as_buffer().to_pybytes()
                coded = base64.b32encode(bytes.fromhex(batch.column("digest")[k].as_py())).decode()
                record = warc_record("response" if refers is None else "revisit", key, batch.column("url")[k].as_py(), coded, payload, refers, batch.column("refers_url")[k].as_py())
                rows.append((key, *writer.add(record)))
                if writer.written >= BUNDLE_BYTES:
                    yield finish()
                    writer = None
        if writer is not None:
            yield finish()

    return materialise(spark, typed.mapInArrow(task("warc", run), _INDEX), "index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` names, each read through its bundle's seek table.

    Columns: page_id, payload_bytes and payload_digest (of the full payload,
    for revisits from the header), record_type, refers_to, url, payload (empty
    for revisits). A response whose payload doesn't have the digest of its
    header is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pafs.FileSystem.from_uri(folder)
        name, stream, reader = "", None, None
        for batch in batches:
            out: list[list] = [[] for _ in _RECORD]
            held = 0
            for k in range(batch.num_rows):
                if batch.column("bundle")[k].as_py() != name:
                    if stream is not None:
                        stream.close()
                    name = batch.column("bundle")[k].as_py()
                    stream = system.open_input_file(f"{root}/{name}")
                    reader = SeekableReader(stream, batch.column("bundle_bytes")[k].as_py())
                head, block = parse_record(reader.frame(batch.column("frame")[k].as_py()), batch.column("offset")[k].as_py())
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base32_sha1(block) != digest:
                    raise ValueError(f"payload of {head['warc-record-id']} has another digest")
                key, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                size = len(block) if kind == "response" else int(head["x-payload-length"])
                for column, value in zip(out, (None if key is None else int(key), size, digest, kind, None if refers is None else int(refers), head["warc-target-uri"], block), strict=True):
                    column.append(value)
                held += len(block)
                if held >= 4 << 20:
                    yield _batch(out)
                    out, held = [[] for _ in _RECORD], 0
            if out[0]:
                yield _batch(out)
        if stream is not None:
            stream.close()

    packed = index.select("bundle", "bundle_bytes").distinct().agg(F.sum("bundle_bytes")).first()[0] or 0
    tasks = max(1, min(READ_TASKS, -(-packed // READ_BYTES)))
    near = index.withColumn("_stretch", F.floor(F.col("frame") / 4)).repartition(tasks, "bundle", "_stretch").drop("_stretch")
    return near.sortWithinPartitions("bundle", "frame", "offset").mapInArrow(task("warc", run), _RECORD)


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.name for f in _RECORD])


def round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back."""
    folder = folder or scratch_path(spark, "warc")
    return read_archives(write_archives(spark, pages, folder), folder)
