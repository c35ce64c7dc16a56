"""WARC archives in seekable Zstandard bundles.

A bundle is a WARC file whose records are grouped into independent Zstandard frames, followed by a seek table in a
skippable frame (the public seekable format), so any Zstandard reader reads it whole and a reader with the table
reads one frame. The index maps each record to its bundle, frame, and offset within the frame.

Bundles are written by tasks straight to a folder that all executors share, under a temporary name and then renamed;
a task that runs again writes files of its own.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, written

#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 1000
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
LEVEL = 3
#: Tasks that read archives; more bundles than that share them.
MOST_TASKS = 20_000
# Fixed values of the seekable format: magic of the skippable frame, its footer's magic.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads that agree in these are equal.
SAME = ("digest", "second", "bytes")
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id bigint, bundle string, frame int, at bigint, length bigint"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def _urn(page_id: int | None, digest: str, copy: int = 0) -> str:
    """A record's id: a page_id may come with several payloads, and with one more than once (copy)."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:20]}{f':{copy}' if copy else ''}>"


def _page(urn: str) -> int | None:
    found = urn.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0) -> bytes:
    """A response with its payload, or a revisit with the HTTP head only, which refers to the first response of that id and payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id, digest, copy)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, digest)}"]
    block = http if refers_to is not None else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record at an offset, as a RECORD row, and the offset after it. A response's digest is taken anew from its payload."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record here")
    head = dict(x.split(": ", 1) for x in lines)
    start = end + 4
    stop = start + int(head["Content-Length"])
    block = data[start:stop]
    split = block.index(b"\r\n\r\n") + 4
    size = int(re.search(rb"Content-Length: (\d+)", block[:split])[1])
    payload, digest = block[split:], head["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = head["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {head['WARC-Record-ID']} differs from its digest")
    url = head.get("WARC-Target-URI")
    url = url and re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), url)
    refers = _page(head["WARC-Refers-To"]) if kind == "revisit" else None
    return (_page(head["WARC-Record-ID"]), url, size, digest, kind, refers, payload if kind == "response" else None), stop + 4


class BundleWriter:
    """Records into frames, frames into a file, the seek table last."""

    def __init__(self, path: str, frame_bytes: int = FRAME_BYTES):
        self.files, self.final = pafs.FileSystem.from_uri(path)
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.path, self.frame_bytes = path, frame_bytes
        self.out = self.files.open_output_stream(self.temporary)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.frames: list[tuple[int, int]] = []
        self.held, self.size = [], 0

    def add(self, page_id: int | None, data: bytes) -> tuple:
        """An INDEX row."""
        if self.held and self.size + len(data) > self.frame_bytes:
            self.flush()
        row = (page_id, self.path, len(self.frames), self.size, len(data))
        self.held.append(data)
        self.size += len(data)
        return row

    def flush(self) -> None:
        if self.held:
            packed = self.squeeze(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + 9) + table + struct.pack("<IBI", len(self.frames), 0, SEEKABLE))
        self.out.close()
        self.files.move(self.temporary, self.final)


class BundleReader:
    """Frames of a bundle by its seek table."""

    def __init__(self, path: str):
        files, name = pafs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, plain = self.frames[k]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=plain)

    def records(self) -> Iterator[tuple]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                row, at = parse(data, at)
                yield row
        self.file.close()


def _html(pages: DataFrame) -> DataFrame:
    """page_id, who (the same as text, so that null ids meet too), url, payload."""
    page_id = F.col("page_id").cast("long")
    return pages.select(page_id.alias("page_id"), F.coalesce(page_id.cast("string"), F.lit("null")).alias("who"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))


def _digests() -> list[Column]:
    return [F.sha1("payload").alias("digest"), F.md5("payload").alias("second"), F.octet_length("payload").alias("bytes")]


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, who, SAME, refers_to) of the pages that revisit another; a page_id may repeat with other payloads.

    Equal: the same SHA-1, MD5 and length. A null page_id is smaller than all others; of payloads with null ids only
    none revisits. Only digests are shuffled and hot payloads are pre-aggregated."""
    keys = written(_html(pages).select("page_id", "who", *_digests()))
    same = list(SAME)
    long = keys.filter(F.col("bytes") >= least)
    kept = long.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return long.join(kept, same).filter("page_id IS DISTINCT FROM refers_to").select("page_id", "who", *same, "refers_to").distinct()


def archive(pages: DataFrame, folder: str | None = None, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) and return the index (written, so it is not run twice).

    Each task writes its own rows into bundles of about bundle_bytes, so payloads move at most once, to meet what they
    refer to. A bundle's name holds the task attempt: the index that is kept names the files of the attempt that wrote
    it. Null html is an empty payload, null url leaves the header out, a null page_id is named null and, among equal
    payloads, is smaller than any other. Rows that repeat a page_id and payload are alike: all response or all revisit,
    each with a record id of its own. An empty table writes no bundle."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = (folder or f"{shared_dir(spark)}/tallyloom/warc-{uuid.uuid4().hex}").rstrip("/")
    kinds = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("at", pa.int64()), ("length", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out, size, n = None, 0, 0
        copies: Counter = Counter()  # rows of one page_id and payload are dealt to one task
        for batch in batches:
            index = []
            for page_id, url, payload, refers_to in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if out is None or size > bundle_bytes:
                    if out:
                        out.close()
                    out, size, n = BundleWriter(f"{folder}/bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{n:04d}.warc.zst", frame_bytes), 0, n + 1
                digest = hashlib.sha1(payload)
                data = record(page_id, url, payload, digest.hexdigest(), refers_to, copies[page_id, digest.digest()])
                copies[page_id, digest.digest()] += 1
                size += len(data)
                index.append(out.add(page_id, data))
            if index:
                yield pa.record_batch([pa.array(x, k.type) for x, k in zip(zip(*index, strict=True), kinds, strict=True)], schema=kinds)
        if out:
            out.close()

    files, name = pafs.FileSystem.from_uri(folder)
    files.create_dir(name, recursive=True)
    # dealt by page_id and digests once, whole: an even key, so that a task has a bundle's worth of rows and not a splinter of them
    key = ["who", *SAME]
    rows = _html(pages).select("*", *_digests()).repartition(*key).join(revisits(pages).drop("page_id"), key, "left").select("page_id", "url", "payload", "refers_to")
    return written(rows.mapInArrow(write, INDEX))


def _rows(found: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    columns = list(zip(*found, strict=True))
    if not payloads:
        columns[-1] = (None,) * len(found)
    return pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)


def read_back(index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles that an index names, read from the archives, frame by frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found, size = [], 0
                for row in BundleReader(path).records():
                    found.append(row)
                    size += len(row[-1] or b"") * payloads + 200
                    if size > 4 << 20:
                        yield _rows(found, payloads)
                        found, size = [], 0
                if found:
                    yield _rows(found, payloads)

    paths = written(index.select("bundle").distinct())
    return paths.repartition(max(1, min(paths.count(), MOST_TASKS)), "bundle").mapInArrow(run, RECORD)


def fetch(index: DataFrame) -> DataFrame:
    """The records of some index rows: of each frame only what is asked for is parsed, other frames aren't read."""
    small_batches(index.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, data = None, (None, None), b""
        for batch in batches:
            found = []
            for path, frame, at in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if path != now[0]:
                    reader = BundleReader(path)
                if (path, frame) != now:
                    data, now = reader.frame(frame), (path, frame)
                found.append(parse(data, at)[0])
            if found:
                yield _rows(found, True)

    return index.select("bundle", "frame", "at").repartition("bundle").sortWithinPartitions("bundle", "frame", "at").mapInArrow(run, RECORD)
