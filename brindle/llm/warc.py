"""WARC archives: one gzip member per record, written from a table and read back sequentially.

Each task of the writer makes archives of at most ``ARCHIVE_BYTES`` in a folder that executors share, every one under a
name of its own attempt; the list of archives is a table that Spark commits, so that what a lost or repeated attempt
left behind is never read. The reader goes through an archive once, inflating a fixed-size piece at a time; it frames a
record by its Content-Length and checks block and payload digests against what it has read.

Of records with equal payloads of at least ``LEAST_SHARED`` bytes, that with the largest id is a response, others are
revisit records that refer to it and carry no payload.

Defined cases: a null payload is an empty one; a null URL is written as an empty target; repeated ids give a record
each; an empty table gives an empty archive list and no records; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.storage import cut, fresh_path

LEAST_SHARED = 1000
ARCHIVE_BYTES = 64 << 20
PIECE = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_shared(path: str, mode: str):
    """A file of the shared folder: a plain one where the folder is mounted, else through Arrow's file systems."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    from pyarrow.fs import FileSystem

    system, name = FileSystem.from_uri(path)
    if "w" in mode:
        system.create_dir(name.rsplit("/", 1)[0])
        return system.open_output_stream(name, compression=None)
    return system.open_input_stream(name, compression=None)


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed record. The payload's size and digest are those of the full payload for revisits too."""
    block = b"" if kind == "revisit" else payload
    # Percent-encoded, so that no URL can break a header line.
    target = "".join(chr(c) if 32 < c < 127 else f"%{c:02X}" for c in (url or "").encode())
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)] if kind == "revisit" else []),
        ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(content: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(content) + packer.flush()


class Broken(ValueError):
    """An archive that isn't framed as it says, or whose content doesn't have its digest."""


def members(source) -> Iterator[bytes]:
    """Contents of the gzip members of a file, inflated a piece at a time."""
    raw = source.read(PIECE)
    while raw:
        inflater, parts = zlib.decompressobj(31), []
        while not inflater.eof:
            if not raw:
                raise Broken("the archive ends within a member")
            parts.append(inflater.decompress(raw))
            raw = inflater.unused_data if inflater.eof else source.read(PIECE)
        yield b"".join(parts)
        raw = raw or source.read(PIECE)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the frame and the block's digest are checked."""
    head, split, rest = content.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not split or not lines[0].startswith("WARC/1."):
        raise Broken("no WARC record where one should begin")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    block = rest[:length]
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise Broken(f"{headers['warc-record-id']}: the block is not of {length} bytes")
    if f"sha1:{hashlib.sha1(block).hexdigest()}" != headers["warc-block-digest"]:
        raise Broken(f"{headers['warc-record-id']}: the block's digest differs")
    if headers["warc-type"] == "response" and headers["warc-payload-digest"] != headers["warc-block-digest"]:
        raise Broken(f"{headers['warc-record-id']}: the payload's digest differs")
    return headers, block


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record per row; returns the committed list of archives: (path, records, bytes)."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = shared.where("n > 1 and head is not null").select("digest", "head")
    refers = F.when((F.octet_length("payload") >= LEAST_SHARED) & (F.col("head") != F.col("id")), F.col("head")).alias("refers_to")
    typed = rows.join(heads, "digest", "left").select("id", "url", "payload", "digest", refers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for page, url, body, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = open_shared(path, "wb")
                packed = member(record("response" if refers_to is None else "revisit", page, url, body, digest, refers_to))
                out.write(packed)
                records += 1
                size += len(packed)
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return cut(typed.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of listed archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        number = lambda urn: int(urn[len("<urn:page:") : -1]) if urn and urn != "<urn:page:>" else None
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                size = seen = 0
                with open_shared(path, "rb") as source:
                    for content in members(source):
                        headers, block = parse(content)
                        if headers["warc-type"] == "response":
                            length, digest = len(block), hashlib.sha1(block).hexdigest()
                        else:
                            length, digest = int(headers["x-payload-length"]), headers["warc-payload-digest"].removeprefix("sha1:")
                        held.append((number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-type"], number(headers.get("warc-refers-to")), length, digest, block))
                        size += len(block)
                        seen += 1
                        if size > 4 << 20 or len(held) >= 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                            held, size = [], 0
                if seen != records:
                    raise Broken(f"{path}: {seen} records where {records} were written")
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

    spread = archives.repartition(max(1, archives.count()), "path")
    return spread.mapInArrow(run, "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Records of ``pages``, written to a folder of their own and read back."""
    return read(write(pages, fresh_path(pages.sparkSession, "warc"), **columns))
