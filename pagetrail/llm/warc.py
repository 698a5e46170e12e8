"""WARC archives: one gzip member per record, written by Spark tasks and read back sequentially.

Writing: pages are hashed by SHA-256; of pages with equal payloads of at least
``SMALLEST`` bytes the one with the smallest ``page_id`` becomes a response
record, the others become revisit records that name it and carry no payload.
Every task writes its pages to archives of about ``ARCHIVE_BYTES`` in a shared
folder (any file system that pyarrow opens by URI), each under a name of its
own that is moved into place when complete, so a task that runs again after a
lost executor replaces its archives.

Reading: an archive is read in small chunks through an incremental gzip
decoder; each member is one record, framed by its Content-Length, and its block
and payload digests are verified. Memory is bounded by one record.

Rows: null html is an empty payload; a null url gives no target header; a null
``page_id`` is never the smallest unless there is no other, and reads back as
null; repeated rows give a record each (all of the smallest id are responses);
other columns are ignored; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_arrow, scratch, stored

SMALLEST = 100  # bytes of a payload that is worth a revisit record
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_BREAKS = {c: f"%{c:02X}" for c in [*range(32), 127]}


class BadRecord(ValueError):
    """A record that is cut off, wrongly framed or fails its digest."""


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    payload_sha256: str = ""


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def member(headers: Iterable[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v.translate(_BREAKS)}\r\n" for k, v in headers)
    head += f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nContent-Length: {len(block)}\r\n\r\n"
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(head.encode()) + gz.compress(block) + gz.compress(b"\r\n\r\n") + gz.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool) -> bytes:
    """The response or revisit record of one page."""
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return member(headers, http if revisit else http + payload)


def members(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """For every gzip member of a byte stream the pieces of its content; each must be used up before the next."""
    source = iter(chunks)
    rest = b""

    def pieces(gz) -> Iterator[bytes]:
        nonlocal rest
        while not gz.eof:
            if gz.unconsumed_tail:
                data = gz.unconsumed_tail
            else:
                data = rest or next(source, b"")
                rest = b""
                if not data:
                    raise BadRecord("the archive ends inside a member")
            yield gz.decompress(data, CHUNK)
        rest = gz.unused_data

    while True:
        while not rest:
            rest = next(source, None)
            if rest is None:
                return
        yield pieces(zlib.decompressobj(31))


def read_record(content: Iterator[bytes]) -> Record:
    """Parse and verify the one record of a member."""
    head = b""
    while b"\r\n\r\n" not in head:
        piece = next(content, None)
        if piece is None:
            raise BadRecord("no end of header")
        head += piece
    head, _, data = head.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise BadRecord(f"unknown version {lines[0][:20]!r}")
    out = Record({k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])})
    length = int(out.headers["content-length"])
    parts, have = [data], len(data)
    for piece in content:
        parts.append(piece)
        have += len(piece)
        if have > length + 4:
            break
    body = b"".join(parts)
    if len(body) != length + 4 or body[length:] != b"\r\n\r\n":
        raise BadRecord(f"framing: {len(body)} bytes follow the header, {length + 4} expected")
    block = body[:length]
    if out.headers.get("warc-block-digest") != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise BadRecord("block digest")
    http, _, out.payload = block.partition(b"\r\n\r\n")
    digest = out.headers.get("warc-payload-digest", "").removeprefix("sha256:")
    out.payload_sha256 = digest
    if out.headers.get("warc-type") == "response":
        out.payload_sha256 = hashlib.sha256(out.payload).hexdigest()
        if digest != out.payload_sha256:
            raise BadRecord("payload digest")
    return out


def read_records(chunks: Iterable[bytes]) -> Iterator[Record]:
    """All records of an archive, in order."""
    for content in members(chunks):
        yield read_record(content)


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (binary), digest, first (smallest page_id of equal payloads) and revisit."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = (
        rows.filter(F.octet_length("payload") >= SMALLEST)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    rows = rows.join(shared, "digest", "left")
    return rows.withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; returns their manifest (path, records, bytes)."""

    def run(batches):
        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        out, number, records, size = None, 0, 0, 0

        def finish():
            out.close()
            final = f"pages-{part:06d}-{number:04d}-{attempt}.warc.gz"  # another attempt may pack its rows otherwise
            files.move(temporary, f"{base}/{final}")
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{final}", "records": records, "bytes": size}])

        for b in batches:
            for page_id, url, payload, digest, first, revisit in zip(*(b.column(c) for c in ("page_id", "url", "payload", "digest", "first", "revisit"))):
                data = page_member(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), first.as_py(), revisit.as_py())
                if out is not None and size + len(data) > archive_bytes:
                    yield finish()
                    out, number, records, size = None, number + 1, 0, 0
                if out is None:
                    temporary = f"{base}/.{part:06d}-{number:04d}.{attempt}.{os.getpid()}"
                    out = files.open_output_stream(temporary)
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            yield finish()

    return stored(in_arrow(with_first(pages), run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row per record of the archives in ``manifest`` (path, records), read sequentially, an archive per task.

    page_id, payload_bytes, payload_digest, record_type, refers_to, url, and the payload if asked for.
    """

    def run(batches):
        for b in batches:
            for path, expected in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                files, name = _open(path)
                number = 0
                with files.open_input_stream(name, compression=None) as f:
                    rows = []
                    for r in read_records(iter(lambda: f.read(CHUNK), b"")):
                        h = r.headers
                        number += 1
                        if h["warc-type"] == "response" and int(h["x-payload-length"]) != len(r.payload):
                            raise BadRecord("payload length")
                        row = {
                            "page_id": page_of(h["warc-record-id"]),
                            "payload_bytes": int(h["x-payload-length"]),
                            "payload_digest": r.payload_sha256,
                            "record_type": h["warc-type"],
                            "refers_to": page_of(h.get("warc-refers-to")),
                            "url": h.get("warc-target-uri"),
                        }
                        rows.append(row | ({"payload": r.payload} if payloads else {}))
                        if len(rows) == 256:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                    if number != expected:
                        raise BadRecord(f"{path} holds {number} records, its manifest says {expected}")
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema)

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())]
    fields += [("refers_to", pa.int64()), ("url", pa.string())] + ([("payload", pa.binary())] if payloads else [])
    schema = pa.schema(fields)
    kinds = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    archives = manifest.count()  # one task each
    return in_arrow(manifest.select("path", "records").repartition(max(1, archives)), run, kinds)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read the archives back."""
    manifest = write_archives(pages, scratch(pages.sparkSession, "warc"))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
