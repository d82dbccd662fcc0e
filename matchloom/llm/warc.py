"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a group of whole
records, and a seek table as a skippable frame at the end (the public seekable
format), so one record is read by fetching one frame.  The index maps a record
to its bundle, frame and offset in the unpacked frame.

Bundles are written by tasks to shared storage under names that no other task
attempt uses; only the index rows of the attempt that Spark commits name them, so
a lost executor or a repeated task leaves at worst a file that nothing refers to.
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
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import checkpoint_dir, materialised

#: Unpacked bytes after which a frame, or a bundle, is closed.
FRAME = 1 << 18
BUNDLE = 1 << 26
#: Written to every record, so that the same pages give the same records.
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the seekable format and of the WARC revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"

INDEX = "page_id long, bundle string, frame int, offset int, length int"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    """One WARC record; with ``refers_to`` a revisit, which has the HTTP header but no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <{URN}{'null' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _number(urn: str | None) -> int | None:
    value = (urn or "").strip("<>").removeprefix(URN)
    return int(value) if value not in ("", "null") else None


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """Headers and block of the record at ``at``, and where the next one begins."""
    if data[at:at + 5] != b"WARC/":
        raise ValueError(f"no WARC record at byte {at}")
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")[1:]
    headers = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(headers["Content-Length"])
    return headers, data[begin:end], end + 4


def described(headers: dict, block: bytes) -> dict:
    """The record as a row; length and digest are of the full payload, also for a revisit.

    A response's are taken from its payload and held against its header; a
    revisit has the length in its HTTP header and the digest in its WARC header.
    """
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    if headers["WARC-Type"] == "response":
        if digest(payload) != stated or len(payload) != size:
            raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    url = headers.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
    return {"page_id": _number(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": stated,
            "record_type": headers["WARC-Type"], "refers_to": _number(headers.get("WARC-Refers-To")), "url": url}


class BundleWriter:
    """Appends records to one bundle; ``close`` writes the seek table and returns the index rows."""

    def __init__(self, uri: str):
        self.uri = uri
        system, path = pafs.FileSystem.from_uri(uri)
        self.out = system.open_output_stream(path, compression=None)
        self.pack = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0
        self.rows: list[tuple] = []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.rows.append((page_id, self.uri, len(self.frames), self.size, len(data)))
        self.held.append(data)
        self.size += len(data)
        self.total += len(data)
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.pack.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> list[tuple]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.out.close()
        return self.rows


class BundleReader:
    """Frames of a bundle, each found through the seek table."""

    def __init__(self, uri: str):
        system, path = pafs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE or flags:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, size - 9 - 8 * count)
        self.frames, at = [], 0
        for packed, unpacked in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, unpacked))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, unpacked = self.frames[number]
        return zstandard.ZstdDecompressor().decompress(self.file.read_at(packed, at), max_output_size=max(1, unpacked))

    def record(self, number: int, offset: int) -> tuple[dict, bytes]:
        return parse(self.frame(number), offset)[:2]

    def records(self) -> Iterator[tuple[dict, bytes]]:
        for number in range(len(self.frames)):
            data, at = self.frame(number), 0
            while at < len(data):
                headers, block, at = parse(data, at)
                yield headers, block


def with_roles(pages: DataFrame, least: int = 0) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``: which record each page becomes.

    Of the pages with equal payloads of at least ``least`` bytes, the largest
    page_id is the response and others refer to it.  A page without an id is a
    revisit where another one has an id.  Rows that repeat the largest id, or
    that all lack one, are responses each.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    same = rows.where(F.col("bytes") >= least).groupBy("sha1", "bytes").agg(
        F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.join(same, ["sha1", "bytes"], "left").select(
        "page_id", "url", "payload", "sha1", refers.alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, least: int = 0) -> DataFrame:
    """Writes one record per page and returns the index: ``page_id, bundle, frame, offset, length``."""
    spark = pages.sparkSession
    base = folder or f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    system, path = pafs.FileSystem.from_uri(base)
    system.create_dir(path, recursive=True)

    def run(batches):
        task = TaskContext.get()
        writer, number = None, 0
        for batch in batches:
            done: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                page_id, url, payload, sha1, refers_to = row
                if writer is None:
                    writer = BundleWriter(f"{base}/{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.warc.zst")
                    number += 1
                name = base64.b32encode(bytes.fromhex(sha1)).decode()
                writer.add(page_id, record(page_id, url, payload, name, refers_to))
                if writer.total >= BUNDLE:
                    done += writer.close()
                    writer = None
            if done:
                yield _index(done)
        if writer is not None:
            yield _index(writer.close())

    return materialised(with_roles(pages, least).mapInArrow(run, INDEX), "warc-index")


def _index(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "bundle", "frame", "offset", "length"])


_RECORD_TYPES = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                 ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in _RECORD_TYPES],
                                      [n for n, _ in _RECORD_TYPES])


def read_all(spark: SparkSession, index: DataFrame) -> DataFrame:
    """Every record of the bundles that an index names, a frame at a time."""
    bundles = index.select("bundle").distinct()
    # A name is a few bytes but stands for a file of up to 64 MB: each gets a task of its own.
    bundles = bundles.repartition(max(1, bundles.count()), "bundle")

    def run(batches):
        for batch in batches:
            for uri in batch.column("bundle").to_pylist():
                rows = []
                for headers, block in BundleReader(uri).records():
                    rows.append(described(headers, block))
                    if len(rows) >= 4096:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return bundles.mapInArrow(run, RECORDS)


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the wanted ``page_id``s with their payloads, read frame by frame through the index.

    A revisit comes back with an empty payload; its ``refers_to`` names the record that has it.
    """
    rows = index.join(wanted.select("page_id").distinct(), "page_id")

    def run(batches):
        for batch in batches:
            found, payloads = [], []
            for uri, frame, offset in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame", "offset"))):
                headers, block = BundleReader(uri).record(frame, offset)
                found.append(described(headers, block))
                payloads.append(block.partition(b"\r\n\r\n")[2])
            out = _rows(found)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(payloads, pa.binary())], [*out.schema.names, "payload"])

    return rows.select("bundle", "frame", "offset").mapInArrow(run, RECORDS + ", payload binary")


ORACLE = """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html,
                  max(page_id) OVER (PARTITION BY COALESCE(html, '')) AS keeper FROM pages),
hexed AS (SELECT *, sha1(html) AS h FROM p),
bits AS (SELECT page_id, html, keeper, i,
                ('0x' || substr(h, 1 + 5 * i::INT, 5))::BIGINT AS five
         FROM hexed, range(8) t(i)),
digits AS (SELECT page_id, html, keeper, i, string_agg(
             substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((five >> (15 - 5 * j)) & 31)::INT, 1), '' ORDER BY j) AS part
           FROM bits, range(4) t(j) GROUP BY page_id, html, keeper, i)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, string_agg(part, '' ORDER BY i) AS payload_digest,
       CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM digits GROUP BY page_id, html, keeper
"""
