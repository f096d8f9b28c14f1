"""Web-archive (WARC) scan.

Spark lists the files and packs them into tasks by size.  Each task streams its
files record by record; no file is ever held whole.  Large uncompressed files are cut into
runs of records first: one pass over the headers, which steps over the bodies, tells where
records begin, so the runs are read in many tasks and records keep their numbers.  Records
that cannot be read come out as well, without content and with the kind of their damage.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanmill.functions.text import decode_utf8, strip_http_headers
from scanmill.runtime import written

VERSIONS = ("1.0", "0.18")

RECORD_SCHEMA = (
    "path string, record_no bigint, headers map<string,string>, warc_type string, "
    "warc_date string, record_id string, content_type string, content_length bigint, "
    "content binary, damage string"
)
_ARROW_SCHEMA = pa.schema(
    [
        ("path", pa.string()),
        ("record_no", pa.int64()),
        ("headers", pa.map_(pa.string(), pa.string())),
        ("warc_type", pa.string()),
        ("warc_date", pa.string()),
        ("record_id", pa.string()),
        ("content_type", pa.string()),
        ("content_length", pa.int64()),
        ("content", pa.binary()),
        ("damage", pa.string()),
    ]
)
_BATCH_BYTES = 16 << 20
_BATCH_RECORDS = 1000
_READ_BYTES = 8 << 20
_LINE_BYTES = 1 << 20
# Uncompressed files are cut into runs of about this size.
RUN_BYTES = 64 << 20
MAX_TASKS = 100_000
_COMPRESSED = r"\.(gz|bz2|zst|lz4)$"
_MAX_BODY = (1 << 31) - 1  # what one binary value can hold

NO_LENGTH, OVERSIZED, CUT_OFF = "no usable length", "oversized", "cut off"


def _header_block(stream) -> dict[str, str]:
    """`key: value` lines up to the blank line; a line without colon has no value."""
    headers: dict[str, str] = {}
    for line in iter(stream.readline, b""):
        text = line.decode("utf-8", "replace").strip()
        if not text:
            break
        key, _, value = text.partition(":")
        headers[key.strip()] = value.strip()
    return headers


def _body_length(headers: dict[str, str]) -> int | None:
    """A usable length: a number that is not negative."""
    for key, value in headers.items():
        if key.lower() == "content-length":
            return int(value) if value.isascii() and value.isdigit() else None
    return None


class _Source:
    """A stream that ends where its compressed data break off, and remembers that."""

    def __init__(self, stream) -> None:
        self._stream = stream
        self.cut = False

    def _until_cut(self, read: Callable[[int], bytes], size: int) -> bytes:
        try:
            return read(size)
        except EOFError:
            self.cut = True
            return b""

    def read(self, size: int) -> bytes:
        return self._until_cut(self._stream.read, size)

    def readline(self) -> bytes:
        return self._until_cut(self._stream.readline, _LINE_BYTES)


def records_of(stream, version: str, with_content: bool = True, size: int | None = None) -> Iterator[tuple]:
    """(headers, length, body, damage) of each record in an open, decompressed stream.

    With the `size` of a stream that can be sought in, bodies that are not wanted are stepped over.

    `damage` is null for a whole record; others have no body.  After a record without a
    usable length, or with one beyond what a value can hold, the scan goes on to the next
    version line.  A record that the end of the file cuts off is the last one.  A
    compressed file that breaks off between records ends with a record without headers.
    """
    mark = f"WARC/{version}".encode()
    source = _Source(stream)
    for line in iter(source.readline, b""):
        if not line.startswith(mark):
            continue
        headers = _header_block(source)
        length = _body_length(headers)
        if length is None or length > _MAX_BODY:
            yield headers, length, None, NO_LENGTH if length is None else OVERSIZED
            continue
        if with_content or size is None:
            body = _take(source, length, keep=with_content)
        else:
            body = b"" if stream.seek(stream.tell() + length) <= size else None
        if body is None:
            yield headers, length, None, CUT_OFF
            return
        yield headers, length, body if with_content else None, None
    if source.cut:
        yield {}, None, None, CUT_OFF


def runs_of(stream, version: str, size: int, run_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(place, number of the first record, records) of runs of records, of about `run_bytes` each.

    Finds the same records as `records_of`, by their headers.
    """
    mark = f"WARC/{version}".encode()
    source = _Source(stream)
    place, first, count = 0, 1, 0
    for line in iter(source.readline, b""):
        if not line.startswith(mark):
            continue
        start = stream.tell() - len(line)
        if count and start - place >= run_bytes:
            yield place, first, count
            first, count = first + count, 0
        place = place if count else start
        count += 1
        length = _body_length(_header_block(source))
        if length is not None and length <= _MAX_BODY:
            stream.seek(min(size, stream.tell() + length))
    if count:
        yield place, first, count


def _take(stream, length: int, keep: bool) -> bytes | None:
    """The next `length` bytes, read in pieces: a wrong length must not reserve memory."""
    pieces = []
    while length:
        piece = stream.read(min(length, _READ_BYTES))
        if not piece:
            return None  # the end, before the body's
        length -= len(piece)
        if keep:
            pieces.append(piece)
    return pieces[0] if len(pieces) == 1 else b"".join(pieces)


def split_path(path: str) -> tuple[str, str, str]:
    """(scheme, authority, path) of a path as Spark lists it: nothing in it is encoded."""
    scheme, authority, inner = re.fullmatch(r"(?:([A-Za-z][\w+.-]*):)?(?://([^/]*))?(.*)", path, re.DOTALL).groups()
    return (scheme or "file").lower(), authority or "", inner


def _azure(authority: str):
    container, _, host = authority.partition("@")
    return pafs.AzureFileSystem(account_name=host.split(".")[0]), container


# Arrow's file system for the schemes of Hadoop's, and where an object's path begins there.
_FILE_SYSTEMS: dict[str, Callable[[str], tuple[pafs.FileSystem, str]]] = {
    "file": lambda _: (pafs.LocalFileSystem(), ""),
    "dbfs": lambda _: (pafs.LocalFileSystem(), "/dbfs"),
    "hdfs": lambda at: (pafs.FileSystem.from_uri(f"hdfs://{at}/")[0], ""),
    "viewfs": lambda at: (pafs.FileSystem.from_uri(f"viewfs://{at}/")[0], ""),
    **dict.fromkeys(("s3", "s3a", "s3n"), lambda at: (pafs.S3FileSystem(), at)),
    "gs": lambda at: (pafs.GcsFileSystem(), at),
    **dict.fromkeys(("abfs", "abfss", "wasb", "wasbs"), _azure),
}


def _open(path: str, content: bytes | None = None):
    """Streamed read of a file, or of its given content; codec chosen by extension."""
    if content is None:
        scheme, authority, inner = split_path(path)
        fs, base = _FILE_SYSTEMS[scheme](authority)
        raw = fs.open_input_stream(base + inner, compression=None)
    else:
        raw = pa.BufferReader(content)
    # These readers hand out all they have before they report a cut file.
    for extension, codec in ((".gz", gzip.open), (".bz2", bz2.BZ2File)):
        if path.endswith(extension):
            return codec(io.BufferedReader(raw, 1 << 20))
    codec = next((c for e, c in ((".zst", "zstd"), (".lz4", "lz4")) if path.endswith(e)), None)
    return io.BufferedReader(pa.CompressedInputStream(raw, codec) if codec else raw, 1 << 20)


def _open_at(path: str, place: int = 0):
    """An uncompressed file that can be sought in, and its size."""
    scheme, authority, inner = split_path(path)
    fs, base = _FILE_SYSTEMS[scheme](authority)
    raw = fs.open_input_file(base + inner)
    size = raw.size()
    stream = io.BufferedReader(raw, 256 << 10)
    stream.seek(place)
    return stream, size


def _whole(files: Iterable[tuple[str, bytes | None]], version: str, with_content: bool) -> Iterator[tuple]:
    """(path, number, record) of all records of some files."""
    for path, content in files:
        with _open(path, content) as stream:
            for number, record in enumerate(records_of(stream, version, with_content), start=1):
                yield path, number, record


def _parts(runs: Iterable[tuple[str, int, int, int]], version: str, with_content: bool) -> Iterator[tuple]:
    """(path, number, record) of all records of some runs."""
    for path, place, first, count in runs:
        stream, size = _open_at(path, place)
        with stream:
            found = records_of(stream, version, with_content, size)
            for number, record in zip(range(first, first + count), found):
                yield path, number, record


def _scan(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of up to 16 MB; a larger record is a batch of its own."""
    rows: list[tuple] = []
    size = 0
    for path, number, (headers, length, body, damage) in records:
        bytes_ = len(body or b"")
        if rows and (size + bytes_ > _BATCH_BYTES or len(rows) >= _BATCH_RECORDS):
            yield _batch(rows)
            rows, size = [], 0
        rows.append(
            (
                path,
                number,
                list(headers.items()),
                headers.get("WARC-Type"),
                headers.get("WARC-Date"),
                headers.get("WARC-Record-ID"),
                headers.get("Content-Type"),
                length,
                body,
                damage,
            )
        )
        size += bytes_
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [
        pa.array(values, field.type) for values, field in zip(zip(*rows), _ARROW_SCHEMA)
    ]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_SCHEMA)


def read_warc(
    spark: SparkSession,
    paths: str | list[str],
    version: str = "1.0",
    with_content: bool = True,
    whole_files: bool = False,
) -> DataFrame:
    """Records of WARC files, with file path and 1-based record number.

    `paths` takes globs.  Compressed files cannot be split, so a file is the unit
    of parallelism, as Spark's size-based packing of whole files decides; uncompressed ones
    of more than `RUN_BYTES` are read in runs of records.  `damage` says why a record has no
    content; it is null for whole records.

    Files are streamed through Arrow's file systems.  A store that only Spark can open
    is refused here, before any task starts; `whole_files` lets Spark read each file
    (up to 2 GiB) as one value.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown WARC version {version!r}, expected one of {VERSIONS}")
    files = spark.read.format("binaryFile").load(paths)
    large = ~F.col("path").rlike(_COMPRESSED) & (F.col("length") > RUN_BYTES)
    cut = False
    if not whole_files:
        scheme = F.regexp_extract("path", r"^([A-Za-z][\w+.-]*):", 1)
        kinds = files.select(scheme, large).distinct().collect()
        schemes = {r[0].lower() or "file" for r in kinds}
        cut = any(r[1] for r in kinds)
        if unknown := sorted(schemes - set(_FILE_SYSTEMS)):
            raise ValueError(f"no streamed reader for {unknown}; read these files with whole_files=True")
    listed = files.select("path", "content") if whole_files else files.filter(~large).select("path")
    listed = listed if cut or whole_files else files.select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened() -> Iterator[tuple[str, bytes | None]]:
            for batch in batches:
                contents = batch.column(1) if whole_files else [None] * batch.num_rows
                for path, content in zip(batch.column(0), contents):
                    yield path.as_py(), content.as_buffer() if whole_files else None

        return _scan(_whole(opened(), version, with_content))

    records = listed.mapInArrow(scan, RECORD_SCHEMA)
    return records.unionByName(_in_runs(files.filter(large), version, with_content)) if cut else records


def _in_runs(files: DataFrame, version: str, with_content: bool) -> DataFrame:
    """Records of uncompressed files, a run of them to a task."""
    run_bytes = RUN_BYTES

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "place", "first", "count"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                stream, size = _open_at(path)
                with stream:
                    found = list(runs_of(stream, version, size, run_bytes))
                columns = list(zip(*((path, *run) for run in found))) or [(), (), (), ()]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = (tuple(r.values()) for batch in batches for r in batch.to_pylist())
        return _scan(_parts(runs, version, with_content))

    runs = written(files.select("path").mapInArrow(index, "path string, place bigint, first bigint, count bigint"), "runs")
    tasks = min(max(1, runs.count()), MAX_TASKS)
    return runs.repartition(tasks).mapInArrow(scan, RECORD_SCHEMA)


def warc_docid(headers: str = "headers"):
    return F.col(headers).getItem("WARC-TREC-ID")


def warc_documents(records: DataFrame, version: str = "1.0", keep: tuple[str, ...] = ()) -> DataFrame:
    """(docid, content, path, record_no, keep): the page of each record, headers removed.

    `keep` names more columns of the records that stay beside their page, so that no join
    (and no second scan) is needed for them.  Damaged records have a null content, and so the
    status `error`.
    """
    page = strip_http_headers("_body", version)
    return records.select(
        "path", "record_no", warc_docid().alias("docid"), *keep, decode_utf8("content").alias("_body")
    ).select("docid", page.alias("content"), "path", "record_no", *keep)
