"""Web archives: a writer that stores equal payloads once, and a salvage reader.

The writer makes one gzip member per record, as archives do, and Spark's text writer puts
them into files.  That writer adds a separator after every row, so a row holds some members
without the last byte, which is 0, and the separator is that byte.  Files are bounded by rows,
and rows by bytes: a record that is larger follows on as many empty members as it is worth rows.

The reader checks every member and record (gzip CRC, version line, headers, length, end
mark, block digest).  After a failed check it searches for the next valid member or
version line, goes on from there, and reports the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.llm.frames import column

# A file holds so many rows at most, so 128 MB, or one longer record beside 120 MB.
ROWS_PER_FILE = 16
_ROW_BYTES = 8 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_CHUNK = 64 << 10
_BATCH_BYTES = 8 << 20
_DATE = "2025-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page}/{digest}')}>"


def _header_value(text: str) -> str:
    """Control characters would end a header line: they are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_bytes(page, url: str | None, payload: bytes, revisit: bool, refers_to) -> bytes:
    """One uncompressed record; a revisit has the HTTP headers only."""
    digest = digest_of(payload)
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page, digest)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if page is not None:
        lines.append(f"X-Page-ID: {page}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
        if refers_to is not None:
            lines.append(f"WARC-Refers-To: {_record_id(refers_to, digest)}")
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member whose last byte is 0; huge records get an empty member behind."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = pack.compress(record) + pack.flush()
    if packed[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        packed += pack.flush()
    return packed


# Ends with the checksum and size of nothing, so with a 0.
_EMPTY_MEMBER = member(b"")


def write_archives(
    pages: DataFrame,
    path: str,
    min_bytes: int = 0,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write one record per page; a null html is an empty payload.

    Of the pages with equal payloads of at least `min_bytes` bytes, the one with the
    smallest id is a response and the others revisit it.  Rows that repeat both id and
    payload are written alike.  A null id comes after all others.
    """
    payload = F.coalesce(column(html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        column(id_col).alias("page"), column(url_col).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("sha", F.unhex(F.sha1("payload")))
    large = base.filter(F.octet_length("payload") >= min_bytes)
    own = large.select("sha", "page").distinct()
    first = own.groupBy("sha").agg(F.min("page").alias("first"))
    # Only what is not the first of its payload needs to be known.
    later = own.join(first, "sha").filter(~F.col("page").eqNullSafe(F.col("first")))
    later = later.select(F.col("sha").alias("__sha"), F.col("page").alias("__page"), "first")
    same = (F.col("sha") == F.col("__sha")) & F.col("page").eqNullSafe(F.col("__page"))
    marked = base.join(later, same, "left").select(
        "page", "url", "payload", F.col("__sha").isNotNull().alias("revisit"), "first"
    )

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                packed = member(record_bytes(*(c[i].as_py() for c in batch.columns)))
                if held and size + len(packed) > _ROW_BYTES:
                    yield b"".join(held)[:-1]
                    held, size = [], 0
                # Rows that are worth the rest of a long record come before it, so that a new
                # file is begun for it.
                for _ in range(len(packed) // _ROW_BYTES):
                    yield _EMPTY_MEMBER[:-1]
                held.append(packed)
                size += len(packed)
        if held:
            yield b"".join(held)[:-1]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], names=["value"])

    members = marked.mapInArrow(pack, "value binary")
    members.select(F.col("value").cast("string")).write.option("lineSep", "\x00").option(
        "maxRecordsPerFile", ROWS_PER_FILE
    ).text(path)


@dataclass(frozen=True)
class Found:
    """A record, or a gap (then `reason` says what failed), and its bytes in the file.

    Records of one gzip member share the member's bytes.
    """

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] | None = None
    block: bytes = b""


class _Bad(Exception):
    """A failed check."""


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a version line; raises `_Bad`."""
    line = _VERSION.match(data, at)
    if not line:
        raise _Bad("no version line")
    headers: dict[str, str] = {}
    start = line.end()
    # Lines are read one by one: what is no header ends the search, however long the file is.
    while (stop := data.find(b"\r\n", start)) != start:
        if stop < 0:
            raise _Bad("headers do not end")
        name, colon, value = data[start:stop].partition(b":")
        if not colon:
            raise _Bad("bad header line")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        start = stop + 2
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or "warc-type" not in headers:
        raise _Bad("no usable length or type")
    first = stop + 2
    end = first + int(length)
    if end > len(data):
        raise _Bad("block is cut off")
    if data[end : end + 4] != b"\r\n\r\n":
        raise _Bad("no end mark after the block")
    block = data[first:end]
    stated = headers.get("warc-block-digest", "")
    if stated.startswith("sha1:") and stated[5:] != digest_of(block):
        raise _Bad("block digest differs")
    return headers, block, end + 4


def _records(data: bytes) -> Iterator[Found]:
    """Records and gaps of uncompressed bytes."""
    at, size = 0, len(data)
    while at < size:
        try:
            headers, block, end = _parse(data, at)
            yield Found(at, end, None, headers, block)
            at = end
        except _Bad as bad:
            after = _next_record(data, at + 1)
            yield Found(at, after, str(bad))
            at = after


def _next_record(data: bytes, at: int) -> int:
    """Where the next record that passes all checks begins, or the end."""
    for line in _VERSION.finditer(data, at):
        if line.start() and data[line.start() - 1] != 0x0A:
            continue
        try:
            _parse(data, line.start())
            return line.start()
        except _Bad:
            continue
    return len(data)


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """(bytes, end, what failed) of the gzip member at a place; bytes up to the failure."""
    unpack = zlib.decompressobj(31)
    parts = []
    while at < len(data):
        chunk, before = data[at : at + _CHUNK], unpack.copy()
        try:
            parts.append(unpack.decompress(chunk))
        except zlib.error as error:
            # A failed call returns nothing: what comes before the failure is read by bytes.
            for i in range(len(chunk)):
                try:
                    parts.append(before.decompress(chunk[i : i + 1]))
                except zlib.error:
                    break
            return b"".join(parts), at, str(error)
        at += len(chunk)
        if unpack.eof:
            return b"".join(parts), at - len(unpack.unused_data), None
    return b"".join(parts), at, "member is cut off"


def _next_member(data: bytes, view: memoryview, at: int) -> int:
    """Where the next whole member that begins with a record begins, or the end."""
    while (at := data.find(_MAGIC, at)) >= 0:
        head, _, failed = _inflate(view[: at + 4 * _CHUNK], at)
        # A longer member is not whole in the part looked at: only its start can be judged.
        if _VERSION.match(head) and (failed is None or failed == "member is cut off"):
            return at
        at += 1
    return len(data)


def _plain_record(data: bytes, view: memoryview, at: int) -> int:
    """Where the next plain record after the start of a failed member begins, or the end.

    A record that the member only stores comes out of it unchanged: it is part of the member.
    """
    unpack, fed = zlib.decompressobj(31), at
    found = _next_record(data, at + 1)
    while found < len(data):
        end = _parse(data, found)[2]
        try:
            unpack.decompress(view[fed:found])
            if unpack.decompress(view[found:end]) != data[found:end]:
                return found
        except zlib.error:
            return found
        fed, found = end, _next_record(data, end)
    return found


def salvage(data: bytes) -> Iterator[Found]:
    """Records and gaps of a file, compressed by member or not at all, in file order.

    A record at a version line is taken as it stands, whatever its block holds.  Only after a
    failed check is the next good member or record searched for.  Bytes of a member that fails
    are one gap, up to there; whole records that come out of it before the failure are kept.
    Empty members are skipped.
    """
    view = memoryview(data)
    at, size = 0, len(data)
    known = -1  # the next good member, once it was searched for

    def next_member(start: int) -> int:
        nonlocal known
        if known < start:
            known = _next_member(data, view, start)
        return known

    while at < size:
        if data[at : at + 3] == _MAGIC:
            inner, end, failed = _inflate(view, at)
            if failed is not None:
                end = min(_plain_record(data, view, at), next_member(at + 1))
            for found in _records(inner):
                if found.reason is None:
                    yield Found(at, end, None, found.headers, found.block)
                elif failed is None:
                    yield Found(at, end, f"{found.reason} (bytes {found.start} to {found.end} of the member)")
            if failed is not None:
                yield Found(at, end, failed)
        else:
            try:
                headers, block, end = _parse(data, at)
                yield Found(at, end, None, headers, block)
            except _Bad as bad:
                end = min(_next_record(data, at + 1), next_member(at + 1))
                reason = str(bad) if _VERSION.match(data, at) else "neither member nor version line"
                yield Found(at, end, reason)
        at = end


def _payload(block: bytes) -> bytes:
    """The body of an HTTP message; all of a block that is not one."""
    if not block.startswith(b"HTTP/"):
        return block
    return block.partition(b"\r\n\r\n")[2]


_SCHEMA = (
    "path string, start bigint, end bigint, gap string, warc_type string, "
    "headers map<string,string>, payload_bytes bigint, payload_digest string"
)


def salvage_archives(spark: SparkSession, paths: str | list[str], with_payload: bool = False) -> DataFrame:
    """Records and gaps of archive files, one row each.

    `start` and `end` are byte places in the file.  A gap has its reason in `gap` and null
    in the columns after it; a record has a null `gap`.  Header names are in lower case.
    `payload_bytes` and `payload_digest` are those of the payload read; a revisit, which
    has none, states them in its headers.  `with_payload` adds the payload itself.

    Files are read by Spark, so any store it reads will do.  A file is one row of at most
    2 GiB, and the unit of parallelism; the task that reads it holds it in memory.  The writer
    of this module keeps its files far below that.
    """
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    schema = _SCHEMA + (", payload binary" if with_payload else "")

    def row(path: str, found: Found) -> tuple:
        if found.reason is not None:
            return (path, found.start, found.end, found.reason, *[None] * 5)
        headers, payload = found.headers, _payload(found.block)
        kind = headers.get("warc-type", "")
        if kind == "revisit":
            length = headers.get("x-payload-length", "")
            stated = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            sizes = (int(length) if length.isascii() and length.isdigit() else None, stated)
        else:
            sizes = (len(payload), digest_of(payload))
        return (path, found.start, found.end, None, kind, list(headers.items()), *sizes, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "end", "gap", "warc_type", "headers", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string())]
        kinds += [pa.int64(), pa.string(), pa.binary()]
        width = len(names) - (not with_payload)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))[:width]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names[:width]
            )

        rows, held = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                for found in salvage(content.as_py() or b""):
                    rows.append(row(path.as_py(), found))
                    held += 500 + (len(found.block) if with_payload else 0)
                    if held > _BATCH_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return files.mapInArrow(run, schema)


def quarantined(salvaged: DataFrame) -> DataFrame:
    """The log of gaps: (path, start, end, reason)."""
    return salvaged.filter("gap is not null").select("path", "start", "end", F.col("gap").alias("reason"))
