"""WARC files as schema.RESPONSES: a Python data source with a partition for each file, wherever `stores` reaches it, or
any store through Spark.

A reader streams a file and holds one record at a time, up to the bytes of a body that are kept; `truncated` says where a
body had more. Files that can't be read to their end give a row with `error` after their records.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .. import schema
from . import stores

#: Longest body that is kept of a record, if nothing else is asked for, and bytes for its HTTP headers.
BODY_BYTES, HEAD_BYTES = 10 << 20, 1 << 20
_FIELDS = schema.RESPONSES.fieldNames()


class _Unpacked(io.RawIOBase):
    """The bytes of a file of gzip members, up to where it's cut off; then EOFError."""

    def __init__(self, packed: BinaryIO) -> None:
        self.packed, self.member, self.left, self.ready = packed, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, out: memoryview) -> int:
        while not self.ready:
            data = self.left or self.packed.read(1 << 16)
            if self.member.eof:
                if not data:
                    return 0
                self.member = zlib.decompressobj(31)
            elif not data:
                raise EOFError("cut off")
            self.ready = self.member.decompress(data)
            self.left = self.member.unused_data
        n = min(len(out), len(self.ready))
        out[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def _head(lines: BinaryIO) -> tuple[str, dict[str, str]]:
    """First line and the headers after it, keys in lower case; folded lines are joined."""
    first, out, last = lines.readline().decode("latin-1").strip(), {}, ""
    while (line := lines.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in (" ", "\t") and last:
            out[last] += " " + text.strip()
        elif ":" in text:
            name, value = text.split(":", 1)
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return first, out


def _http(block: bytes, body_bytes: int) -> tuple[int | None, dict[str, str] | None, bytes, bool]:
    """Status, headers, body and whether it was cut."""
    stream = io.BytesIO(block)
    first, headers = _head(stream)
    parts = first.split(None, 2)
    if len(parts) < 2 or not parts[0].startswith("HTTP/") or not parts[1].isdigit():
        return None, None, b"", False
    return int(parts[1]), headers, stream.read(body_bytes), bool(stream.read(1))


def _block(lines: BinaryIO, length: int, most: int) -> tuple[bytes, bool]:
    """The first bytes of a record's block, and whether there are more, which are passed over."""
    kept = lines.read(min(length, most))
    left = length - len(kept) if len(kept) == min(length, most) else 0
    while left > 0 and (data := lines.read(min(left, 1 << 20))):
        left -= len(data)
    return kept, length > most


def records(stream: BinaryIO, path: str, responses_only: bool = True, limit: int | None = None, body_bytes: int = BODY_BYTES) -> Iterator[dict]:
    """Rows of a WARC, compressed or not; `limit` counts records of any type, as they are read. The stream is only read forwards."""
    stream = io.BufferedReader(stream, 1 << 16) if not hasattr(stream, "peek") else stream  # type: ignore[arg-type]
    blank = dict.fromkeys(_FIELDS) | {"warc_path": path}
    seen = 0
    try:
        packed = stream.peek(2)[:2] == b"\x1f\x8b"
        lines: BinaryIO = io.BufferedReader(_Unpacked(stream)) if packed else stream  # type: ignore[assignment]
        while limit is None or seen < limit:
            first, headers = _head(lines)
            if not first:
                if lines.read(1):
                    raise ValueError("record without a version line")
                return
            if not first.startswith("WARC/"):
                raise ValueError("not a WARC record")
            block, cut = _block(lines, int(headers.get("content-length", 0)), body_bytes + HEAD_BYTES)
            lines.readline()
            lines.readline()
            kind = headers.get("warc-type")
            row = blank | {"record_type": kind, "url": headers.get("warc-target-uri", "").strip("<>") or None, "warc_date": headers.get("warc-date"), "payload_type": headers.get("warc-identified-payload-type"), "offset": seen}
            seen += 1
            if kind == "response":
                status, http_headers, body, more = _http(block, body_bytes)
                yield row | {"http_status": status, "http_headers": list((http_headers or {}).items()) if http_headers is not None else None, "body": body, "truncated": cut or more}
            elif not responses_only:
                yield row
    except (OSError, EOFError, ValueError, zlib.error) as broken:
        yield blank | {"error": type(broken).__name__, "offset": seen}


def batches(rows: Iterator[dict], at_once: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    arrow, own, size = to_arrow_schema(schema.RESPONSES), [], 0
    for row in rows:
        own.append(row)
        size += len(row["body"] or b"") + 1_000
        if size > at_once:
            yield pa.RecordBatch.from_pylist(own, schema=arrow)
            own, size = [], 0
    if own:
        yield pa.RecordBatch.from_pylist(own, schema=arrow)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options
        self.store = {k: options[k] for k in ("region", "endpoint") if options.get(k)} | ({"anonymous": True} if options.get("anonymous") == "true" else {})

    def partitions(self) -> list[InputPartition]:
        named = [p for p in self.options.get("path", "").split(",") if p]
        return [InputPartition(p) for part in named for p in stores.listed(part, **self.store)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        limit, most = self.options.get("limit_records"), int(self.options.get("body_bytes") or BODY_BYTES)
        path = partition.value
        try:
            stream = stores.opened(path, **self.store)
        except OSError as missing:
            yield from batches(iter([dict.fromkeys(_FIELDS) | {"warc_path": path, "error": type(missing).__name__}]))
            return
        with stream:
            yield from batches(records(stream, path, self.options.get("responses_only", "true") == "true", int(limit) if limit else None, most))


class WarcSource(DataSource):
    """spark.read.format("warc"): options path (patterns, by commas), limit_records (of each file), responses_only, body_bytes; for S3 region, endpoint, anonymous."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> StructType:
        return schema.RESPONSES

    def reader(self, schema: StructType) -> DataSourceReader:  # noqa: ARG002
        return _Reader(dict(self.options))


def read_warc(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """WARC files on disks that all executors see, or behind http, https, s3, gs and hdfs URIs; one task streams one file."""
    spark.dataSource.register(WarcSource)
    said = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("warc").options(path=path, **said).load()


def read_warcs(spark: SparkSession, paths: DataFrame, **options: object) -> DataFrame:
    """WARC files that a table of paths (path) names, of any length: the list stays distributed, a file is one row's work."""
    most, limit = int(options.pop("body_bytes", None) or BODY_BYTES), options.pop("limit_records", None)
    only = bool(options.pop("responses_only", True))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for path in batch.column(0).to_pylist():
                try:
                    stream = stores.opened(path, **options)
                except OSError as missing:
                    yield from batches(iter([dict.fromkeys(_FIELDS) | {"warc_path": path, "error": type(missing).__name__}]))
                    continue
                with stream:
                    yield from batches(records(stream, path, only, limit, most))

    tasks = paths.select("path").filter(F.coalesce("path", F.lit("")) != "")
    n = max(1, min(tasks.count(), 100_000))
    return tasks.repartitionByRange(n, "path").mapInArrow(run, schema.RESPONSES)


def read_warc_store(spark: SparkSession, path: str, limit_records: int | None = None) -> DataFrame:
    """WARC files of any store that Spark reads, whole files at a time: for files of up to some hundred megabytes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for name, content in zip(batch.column(0), batch.column(1)):
                yield from batches(records(io.BytesIO(content.as_py()), name.as_py(), limit=limit_records))

    return files.mapInArrow(run, schema.RESPONSES)
