"""WARC archives: writing, normalising monolithic gzip files, reading back.

``write_archives`` packs records into archives that are one gzip stream as a whole, as many
crawlers leave them: no record can be reached without inflating all before it.
``normalise`` inflates such a stream once, from its first byte to its last, and rewrites
every record as a gzip member of its own; beside the new archive it leaves an index with
offset and length of each member. ``read_records`` takes members by that index.

Archives are rows with a binary column, written as tables into the shared folder, since
executors share no local disk. An archive closes at ARCHIVE_BYTES of inflated records (one
larger record is an archive of its own). Inflating goes chunk by chunk; what is held is one
record and the compressed archive.

Among records with equal payloads the one with the largest page_id is a response and the
others are revisits that point to it; they carry the payload's digest and length but not the
payload. Groups are resolved on digests alone: a partial maximum for each digest.

Defined results: null html is an empty payload; null and empty urls are written as they
are; rows that repeat both page_id and payload of the response are responses too; null ids
never win over numbers, and a group with null ids only is all responses; an empty table
gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common as C

ARCHIVE_BYTES = 8 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT_BYTES = 0
READ_CHUNK = 1 << 16
GZIP = 31  # zlib's window bits for a gzip wrapper


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; ``refers_to`` is the response's page_id for a revisit."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    name = (lambda i: f"<urn:page:{'' if i is None else i}>")
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        *([f"WARC-Refers-To: {name(refers_to)}"] if revisit else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {"version": lines[0]} | dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def verdicts(pages: DataFrame) -> DataFrame:
    """(digest, winner): the page that holds each payload that occurs more than once."""
    narrow = pages.select("page_id", F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b""))).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    many = narrow.where(F.col("n") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("rows"))
    return many.where("rows > 1 AND winner IS NOT NULL").select("digest", "winner")


def records(pages: DataFrame) -> DataFrame:
    """Pages with refers_to: the response's page_id where the page is a revisit."""
    digest = F.sha1(F.coalesce(F.col("html").cast("binary"), F.lit(b"")))
    rows = pages.select("page_id", "url", "html", digest.alias("digest"))
    return rows.join(verdicts(pages), "digest", "left").select(
        "page_id", "url", "html",
        F.when(F.col("winner").isNotNull() & ~F.col("winner").eqNullSafe(F.col("page_id")), F.col("winner")).alias("refers_to"),
    )


def write_archives(rows: DataFrame) -> DataFrame:
    """(archive, data): monolithic gzip archives of (page_id, url, html, refers_to) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        stream, data, size = zlib.compressobj(6, zlib.DEFLATED, GZIP), bytearray(), 0
        for batch in batches:
            for row in C.steps(batch, "html"):
                for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in row.columns), strict=True):
                    payload = (html or "").encode()
                    record = _record(page_id, url, payload, payload_digest(payload), refers_to)
                    data += stream.compress(record)
                    size += len(record)
                    if size >= ARCHIVE_BYTES:
                        yield _archive(part, number, data + stream.flush())
                        stream, data, size, number = zlib.compressobj(6, zlib.DEFLATED, GZIP), bytearray(), 0, number + 1
        if size:
            yield _archive(part, number, data + stream.flush())

    return rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, "archive string, data binary")


def _archive(part: int, number: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([f"part-{part:05d}-{number:05d}.warc.gz"]), pa.array([bytes(data)], pa.binary())], ["archive", "data"]
    )


def split_stream(data: bytes) -> Iterator[bytes]:
    """Records of a gzip stream (of one member or several), inflated once in small chunks."""
    buffer, need = bytearray(), None
    view = memoryview(data)
    inflate = zlib.decompressobj(GZIP)
    at = 0
    while at < len(view) or inflate.unconsumed_tail:
        chunk = inflate.unconsumed_tail or bytes(view[at : (at := at + READ_CHUNK)])
        buffer += inflate.decompress(chunk, 4 * READ_CHUNK)
        if inflate.eof:  # a further member
            at -= len(inflate.unused_data)
            inflate = zlib.decompressobj(GZIP)
        while True:
            if need is None:
                head = buffer.find(b"\r\n\r\n")
                if head < 0:
                    break
                need = head + 8 + int(_headers(bytes(buffer[:head]))["Content-Length"])
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = None
    if buffer:
        raise ValueError("archive ends inside a record")


_INDEX = pa.struct([("offset", pa.int64()), ("length", pa.int64())])


def normalise(archives: DataFrame) -> DataFrame:
    """(archive, data, index): every record a member of its own, and where each one lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, index = bytearray(), []
                for record in split_stream(batch.column(1)[i].as_py()):
                    pack = zlib.compressobj(6, zlib.DEFLATED, GZIP)
                    member = pack.compress(record) + pack.flush()
                    index.append({"offset": len(out), "length": len(member)})
                    out += member
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([bytes(out)], pa.binary()), pa.array([index], pa.list_(_INDEX))],
                    ["archive", "data", "index"],
                )

    schema = "archive string, data binary, index array<struct<offset: long, length: long>>"
    return archives.select("archive", "data").mapInArrow(run, schema)


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read_records(archives: DataFrame) -> DataFrame:
    """Records of normalised archives, each inflated alone from its place in the index.

    A response's payload is checked against its digest and length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda name: int(text) if (text := name.removeprefix("<urn:page:").removesuffix(">")) else None
        for batch in batches:
            for i in range(batch.num_rows):
                data, rows = memoryview(batch.column(1)[i].as_buffer()), []
                for place in batch.column(2)[i].as_py():
                    member = data[place["offset"] : place["offset"] + place["length"]]
                    head, body = zlib.decompress(member, GZIP).split(b"\r\n\r\n", 1)
                    found, body = _headers(head), body[:-4]
                    digest = found["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, size = found["WARC-Type"], int(found["X-Payload-Length"])
                    if kind == "response" and (size != len(body) or digest != payload_digest(body)):
                        raise ValueError("payload differs from its digest")
                    refers_to = found.get("WARC-Refers-To")
                    rows.append((number(found["WARC-Record-ID"]), found["WARC-Target-URI"], size, digest, kind, refers_to and number(refers_to)))
                columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("archive", "data", "index").mapInArrow(run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    monolithic = C.store(write_archives(records(C.table(spark, sf_dir, "pages"))))
    return read_records(C.store(normalise(monolithic))).drop("url")
