"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding some whole records, and at the end a seek table in a
skippable frame. The index maps a record to its file, frame and the byte offset and length inside the unpacked frame,
so one record costs one read of the table and one frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import durable, new_path

# Fixed values of the seekable format: magic numbers of a skippable frame and of the table's footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
#: Most tasks that read bundles.
READERS = 100_000
INDEX = "page_id long, record_type string, refers_to long, file string, frame int, frame_offset long, record_length long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Date of records that are made without one.
EPOCH = "1970-01-01T00:00:00Z"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def make_record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = EPOCH, copy: str = "", refers_uri: str | None = None
) -> bytes:
    """One WARC/1.1 record whose block is an http response; that of a revisit ends with its headers, which name the length of
    the payload that it stands for. copy tells records of one page apart; blanks and controls of a url are escaped."""
    page = "" if page_id is None else page_id
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}{copy}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        to = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", refers_uri or "") or f"urn:page:{refers_to}"
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To-Target-URI: {to}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record of an unpacked frame; the http header's length of the payload is
    among the headers as Payload-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        head = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start = end + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} is cut short")
        body = data.index(b"\r\n\r\n", start, stop) + 4
        for line in data[start:body].decode().split("\r\n"):
            if line.startswith("Content-Length: "):
                head["Payload-Length"] = line.removeprefix("Content-Length: ")
        yield at, stop + 4 - at, head, data[body:stop]
        at = stop + 4


class BundleWriter:
    """Writes records into frames of about frame_bytes; append() gives (frame, offset in the frame, length)."""

    def __init__(self, sink: BinaryIO, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.size = self.total = 0

    def append(self, record: bytes) -> tuple[int, int, int]:
        place = (len(self.frames), self.size, len(record))
        self.waiting.append(record)
        self.size += len(record)
        self.total += len(record)
        if self.size >= self.frame_bytes:
            self._end_frame()
        return place

    def _end_frame(self) -> None:
        if self.waiting:
            packed = self.packer.compress(b"".join(self.waiting))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.waiting, self.size = [], 0

    def close(self) -> None:
        self._end_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)


class BundleReader:
    """Reads frames by the seek table at the end of a seekable source."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        end = source.tell()
        source.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * n)
        sizes = list(struct.iter_unpack("<II", source.read(8 * n)))
        self.places, at = [], 0
        for packed, size in sizes:
            self.places.append((at, packed, size))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, size = self.places[i]
        self.source.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        return next((h, b) for _, _, h, b in parse_records(self.frame(frame)[offset : offset + length]))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _writer(folder: str, frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        names = [f.split()[0] for f in INDEX.split(", ")]
        task = TaskContext.get()
        # a repeated task writes files of its own; only those that the committed index names are read
        stem = f"part-{task.partitionId() if task else 0:05d}-{uuid.uuid4().hex}"
        sink = bundle = None
        n_files = n = 0
        for batch in batches:
            index = []
            columns = ("page_id", "url", "payload", "digest", "refers_to", "refers_uri")
            for page_id, url, payload, digest, refers_to, uri in zip(*(batch[c].to_pylist() for c in columns)):
                if bundle is None:
                    name = f"{stem}-{n_files:04d}.warc.zst"
                    n_files += 1
                    fs.create_dir(path, recursive=True)
                    sink = fs.open_output_stream(f"{path}/{name}", compression=None)
                    bundle = BundleWriter(sink, frame_bytes)
                n += 1
                sha1 = base64.b32encode(bytes.fromhex(digest)).decode()
                place = bundle.append(make_record(page_id, url, payload, sha1, refers_to, date, f":{stem}-{n}", uri))
                index.append((page_id, "response" if refers_to is None else "revisit", refers_to, name, *place))
                if bundle.total >= bundle_bytes:
                    bundle.close()
                    sink.close()
                    bundle = None
            if index:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*index), kinds)], names)
        if bundle is not None:
            bundle.close()
            sink.close()

    return run


def write_archives(
    pages: DataFrame, folder: str, min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str | None = None
) -> DataFrame:
    """pages (page_id, url, html) -> bundles in folder and their index, one row per record.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least min_revisit_bytes bytes the one with
    the smallest page_id is a response, the others revisit it; rows that repeat that page_id are further responses. A
    null page_id is never referred to; such a row revisits if any row with an id has its payload. Payloads never move:
    only digests that occur more than once are shuffled and joined back, by broadcast where Spark finds them small
    enough and by a skew-split sort-merge join beyond that. folder must be reachable from every executor. Records are dated
    `date` (as 2024-05-01T12:00:00Z), without it the time of the call; each has an id of its own, repeated pages too."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select("page_id", "url", payload.alias("payload"))
    d = d.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    again = durable(
        d.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("k"), F.min_by("url", "page_id").alias("first_url"))
        .where("k > 1 AND first_id IS NOT NULL").drop("k"),
        "warc-again",
    )
    d = d.join(again, "digest", "left")
    refers = F.when((F.col("bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    d = d.select("page_id", "url", "payload", "digest", refers.alias("refers_to"), F.col("first_url").alias("refers_uri"))
    return durable(d.mapInArrow(_writer(folder, frame_bytes, bundle_bytes, date), INDEX), "warc-index")


def _reader(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

        def number(urn: str) -> int | None:
            return int(x) if (x := urn.removeprefix("<urn:page:").split(":")[0].removesuffix(">")) else None

        for batch in batches:
            for file in batch["file"].to_pylist():
                with fs.open_input_file(f"{path}/{file}") as source:
                    bundle = BundleReader(source)
                    for i in range(len(bundle.places)):
                        rows = []
                        for _, _, head, body in parse_records(bundle.frame(i)):
                            response = head["WARC-Type"] == "response"
                            digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                            if response and base32_sha1(body) != digest:
                                raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                            rows.append((
                                number(head["WARC-Record-ID"]), head["WARC-Type"],
                                None if response else int(head["X-Refers-To-Page"]), int(head["Payload-Length"]), digest,
                            ))
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def read_archives(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """All records of the bundles that the index names, one row each; payload digests of responses are checked. Every bundle
    is a task, up to READERS of them; with a number of its own the deal of file names is not coalesced."""
    files = durable(index.select("file").distinct(), "warc-files")
    return files.repartition(min(max(files.count(), 1), READERS)).mapInArrow(_reader(folder), RECORD)


def read_record(folder: str, file: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: reads the seek table and one frame."""
    fs, path = _open(folder)
    with fs.open_input_file(f"{path}/{file}") as source:
        return BundleReader(source).record(frame, offset, length)


def new_folder(spark: SparkSession) -> str:
    return new_path(spark, "warc")
