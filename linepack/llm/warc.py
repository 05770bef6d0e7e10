"""WARC archives: one gzip member per record, written through Spark and read back in sequence.

Archives are files of gzip members and nothing else, of bounded size: a task gathers members until they reach
``ARCHIVE`` bytes and hands them on as one row, which Spark's text writer makes a file of, in any file system it knows and
with its usual commit: a member's last byte (the top byte of its length) is zero, so rows carry archives without it and the
line separator is that byte. A record of 16 MB or more, whose last byte may differ, is followed by an empty member.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Bytes from which on an archive is closed: what one row, and a task that reads it, holds besides one record.
ARCHIVE = 32 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _value(text: str) -> str:
    """A header value: what would end the line is percent-encoded."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """A response record, or a revisit record whose block is the response's HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_value(url)}")
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'null' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _archives(archive: int):
    """Rows (page_id, url, html, top, revisit) in, archives without their last byte out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, html, top, revisit = (c[row].as_py() for c in batch.columns)
                html = html or b""
                data = _member(record(page_id, url, html, top, revisit, base32_sha1(html)))
                held.append(data if data[-1] == 0 else data + _member(b""))
                size += len(held[-1])
                if size >= archive:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])

    return run


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, archive: int = ARCHIVE) -> None:
    """Write each row of ``pages`` (page_id, url, html) as a record into archives at ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the largest page_id is a response and the
    others are revisits of it; rows that repeat that page_id are responses too, and so are all rows of a payload whose
    page_ids are all null. Smaller payloads are always responses. Null html is an empty payload. An archive is closed when
    it has ``archive`` bytes or its task ends. An empty table gives a folder without archives.
    """
    body = F.coalesce("html", F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html")).withColumn("digest", F.sha1("html"))
    tops = own.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("top"))
    met = own.join(tops, "digest", "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    rows = met.select("page_id", "url", "html", "top", revisit.alias("revisit")).mapInArrow(_archives(archive), "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


class WarcError(ValueError):
    """An archive breaks the format or a digest does not match."""


def _inflated(chunks: Iterable[bytes]) -> Iterator[Iterator[bytes]]:
    """The decompressed pieces of each gzip member in turn; a member must be read up before the next."""
    chunks, held = iter(chunks), b""
    while True:
        while not held:
            if (held := next(chunks, None)) is None:
                return

        def pieces() -> Iterator[bytes]:
            nonlocal held
            z = zlib.decompressobj(31)
            while not z.eof:
                if not held and (held := next(chunks, None)) is None:
                    raise WarcError("an archive ends inside a member")
                piece = z.decompress(held, CHUNK)
                held = z.unused_data if z.eof else z.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()


def read_records(chunks: Iterable[bytes], keep_payload: bool = False) -> Iterator[dict]:
    """The records of an archive, read in sequence from its bytes in chunks.

    Each record is framed by its Content-Length; its block digest is verified, and for responses the payload digest and
    the payload's length against the HTTP header. Gives the headers (lower-cased names), payload_bytes, payload_digest
    and, if asked for, the payload. Members without content are passed over.
    """
    for member in _inflated(chunks):
        buffer = b""
        for piece in member:
            buffer += piece
            if b"\r\n\r\n" in buffer:
                break
        if not buffer:
            continue
        head, mark, rest = buffer.partition(b"\r\n\r\n")
        first, *lines = head.decode("utf-8").split("\r\n")
        if not mark or not first.startswith("WARC/"):
            raise WarcError("a member does not start with a record's header")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(headers["content-length"])
        block_sha, payload_sha, http, in_payload, size, kept, tail = hashlib.sha1(), hashlib.sha1(), b"", False, 0, [], b""

        def pieces(rest: bytes = rest, member: Iterator[bytes] = member) -> Iterator[bytes]:
            yield rest
            yield from member

        for piece in pieces():
            part, after = piece[:left], piece[left:]
            left -= len(part)
            tail += after
            block_sha.update(part)
            if not in_payload:
                http += part
                if b"\r\n\r\n" not in http:
                    continue
                in_payload = True
                http, _, part = http.partition(b"\r\n\r\n")
            payload_sha.update(part)
            size += len(part)
            if keep_payload:
                kept.append(part)
        if left or tail != b"\r\n\r\n":
            raise WarcError(f"{headers.get('warc-record-id')}: the content does not have its stated length")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
        stated = int(fields["content-length"])
        for name, sha in (("block", block_sha), *([("payload", payload_sha)] if headers["warc-type"] == "response" else [])):
            if headers[f"warc-{name}-digest"] != "sha1:" + base64.b32encode(sha.digest()).decode():
                raise WarcError(f"{headers.get('warc-record-id')}: the {name} digest does not match")
        if headers["warc-type"] == "response" and size != stated:
            raise WarcError(f"{headers.get('warc-record-id')}: the payload does not have its stated length")
        out = {"headers": headers, "payload_bytes": stated, "payload_digest": headers["warc-payload-digest"].partition(":")[2]}
        yield out | ({"payload": b"".join(kept)} if keep_payload else {})


def _page(urn: str | None) -> int | None:
    found = urn.strip("<>").rpartition(":")[2] if urn else "null"
    return None if found == "null" else int(found)


def _read(with_payload: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            for content in got.column(0):
                view, rows, size = memoryview(content.as_buffer()), [], 0
                for r in read_records((bytes(view[k : k + CHUNK]) for k in range(0, len(view), CHUNK)), with_payload):
                    h = r["headers"]
                    rows.append((_page(h["warc-record-id"]), r["payload_bytes"], r["payload_digest"], h["warc-type"], _page(h.get("warc-refers-to")), r.get("payload")))
                    size += len(r.get("payload") or b"")
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record of the archives at ``path``.

    A revisit's length and digest are those of the full payload; its own payload is empty. A folder without archives gives
    no row. A task holds one archive at a time, and its records one by one.
    """
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", payload binary" if with_payload else "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)
    return files.select("content").mapInArrow(_read(with_payload), schema)
