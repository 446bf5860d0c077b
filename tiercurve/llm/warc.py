"""WARC archives as a Spark data source, and pages written to one with copies as revisits.

``spark.read.format("warc")`` and ``df.write.format("warc")`` work after ``register``.

* *Reading.* The driver plans partitions of about ``split_bytes``: files are cut where the writer noted the begin of a record,
  small pieces share a partition. A file from elsewhere (``.warc``, ``.warc.gz``) is one piece. A record's headers are
  parsed first; predicates on columns made from headers are pushed down and decided on them, and if they fail, or no column of the
  schema needs the payload, it is passed over without being decoded: in plain files by the record's length, in packed ones by
  the length in the member's ``sl`` field, where there is one. Select columns by the schema: ``read`` takes their names.
* *Writing.* Tasks write files of at most about ``file_bytes`` under names of their own, each record a gzip member. The job's commit writes a manifest of
  the files of the tasks that succeeded; a reader of a folder with manifests reads nothing else, so that files of failed
  or repeated attempts do no harm. Plain paths and ``file:`` are opened directly, others through ``pyarrow.fs``.

``records`` says which pages are written whole: of pages with equal payloads of at least ``min_bytes`` that of the
greatest id (then url) is the response, others are revisits of it; all smaller ones are responses. A response's html is shuffled once,
one copy for each payload and task; revisits carry none. The most repeated payloads (at most ``HOT``) are looked
up by broadcast, so that no task meets all copies of one, and repeated rows are counted before they are spread again.

A null html is an empty payload; a null id makes the record ``urn:page`` and reads as null again. Of repeated rows one is the response, the
others revisit it under the same record id. Urls are stored percent-encoded. An empty table gives an empty archive.
Other columns are left out.
"""

from __future__ import annotations

import codecs
import gzip
import io
import json
import struct
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from tiercurve.llm.common import scratch

#: Columns made from the record's own headers.
HEADERS = {
    "record_type": b"warc-type", "record_id": b"warc-record-id", "target_uri": b"warc-target-uri", "date": b"warc-date",
    "payload_digest": b"warc-payload-digest", "refers_to": b"warc-refers-to", "content_type": b"content-type",
}
SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in HEADERS])
SCHEMA = SCHEMA.add("payload_length", T.LongType()).add("payload", T.BinaryType()).add("text", T.StringType())
_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.BinaryType(): pa.binary()}
SPLIT_BYTES, FILE_BYTES = 32 << 20, 1 << 30
HOT, CHUNK = 1000, 4096
_MAGIC = b"\x1f\x8b"
_SKIP = struct.Struct("<4sIHH2sHII")  # a gzip header with the field "sl": packed and plain length of the member
_BATCH_BYTES, _BATCH_ROWS = 8 << 20, 4096
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URL_SAFE = "%/:=&?~#+!$,;'@()*[]"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# Reading


@dataclass
class Pieces(InputPartition):
    """Parts of files: path, first byte and end (None: of the file)."""

    parts: list[tuple[str, int, int | None]]


def _value(row: dict, test: Filter) -> bool | None:
    """Whether a row passes, None for unknown as in SQL."""
    if isinstance(test, Not):
        inner = _value(row, test.child)
        return None if inner is None else not inner
    have = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return have is None
    if isinstance(test, IsNotNull):
        return have is not None
    if isinstance(test, EqualNullSafe):
        return have == test.value
    if have is None:
        return None
    if isinstance(test, In):
        return True if have in test.value else None if None in test.value else False
    if test.value is None:
        return None
    return _COMPARED[type(test)](have, test.value)


_COMPARED = {
    EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
    LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b),
    StringContains: lambda a, b: b in a,
}
_DECIDED = (*_COMPARED, In, IsNull, IsNotNull, EqualNullSafe)


def _decidable(test: Filter) -> bool:
    if isinstance(test, Not):
        return _decidable(test.child)
    return isinstance(test, _DECIDED) and len(test.attribute) == 1 and test.attribute[0] in (*HEADERS, "payload_length")


def _lines(file: io.BufferedIOBase) -> tuple[dict[bytes, bytes], int]:
    """Header fields up to the empty line, and the bytes they take."""
    found, taken, last = {}, 0, None
    while line := file.readline():
        taken += len(line)
        if not line.strip():
            break
        if line[:1] in b" \t" and last:  # a folded line
            found[last] = (found[last] + b" " + line.strip()).strip()
            continue
        name, _, value = line.partition(b":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found, taken


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.names = schema.names
        self.tests: list[Filter] = []
        self.decoded = 0

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the interface's name)
        for test in filters:
            if _decidable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Pieces]:
        system, path = _opened(self.path)
        info = system.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            files = system.get_file_info(fs.FileSelector(path, recursive=True))
        manifests = sorted(f.path for f in files if f.base_name.startswith("_manifest-"))
        parts = []
        for manifest in manifests:
            with system.open_input_stream(manifest) as stream:
                for name, splits in json.loads(stream.read()):
                    parts += [(f"{path}/{name}", a, b, b - a) for a, b in zip(splits, splits[1:], strict=False)]
        if not manifests:
            parts = [(f.path, 0, None, f.size) for f in files if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz"))]
        planned: list[Pieces] = []
        room = 0
        for name, first, end, size in parts:
            if size > room:
                planned.append(Pieces([]))
                room = self.split_bytes
            planned[-1].parts.append((name, first, end))
            room -= size
        return planned or [Pieces([])]

    def _rows(self, file: io.BufferedIOBase, end: int | None) -> Iterator[dict]:
        """The wanted records of a file from where it stands to ``end``, or the one of a member."""
        early = [t for t in self.tests if not self._of_length(t)]
        late = [t for t in self.tests if self._of_length(t)]
        wants_body = bool({"payload", "text"} & set(self.names))
        wants_length = wants_body or late or "payload_length" in self.names
        while end is None or file.tell() < end:
            line = file.readline()
            if not line:
                break
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not the begin of a WARC record: {line[:80]!r}")
            headers, _ = _lines(file)
            left = int(headers[b"content-length"])
            row = {c: v.decode("utf-8", "replace").strip("<>") if (v := headers.get(h)) is not None else None for c, h in HEADERS.items()}
            if all(_value(row, t) for t in early):
                http = {}
                if wants_length:
                    if (headers.get(b"content-type") or b"").startswith(b"application/http"):
                        http, taken = _lines(file)
                        left -= taken
                    row["payload_length"] = left
                    if row["record_type"] == "revisit":
                        length = http.get(b"content-length")
                        row["payload_length"] = int(length) if length else None
                if all(_value(row, t) for t in late):
                    row["payload"] = row["text"] = None
                    if wants_body and row["record_type"] != "revisit":
                        row["payload"], left = file.read(left), 0
                        self.decoded += 1
                        if "text" in self.names:
                            row["text"] = row["payload"].decode(_charset(http), "replace")
                    yield row
            if isinstance(file, _Member):
                return
            file.seek(left, io.SEEK_CUR)

    @staticmethod
    def _of_length(test: Filter) -> bool:
        while isinstance(test, Not):
            test = test.child
        return test.attribute[0] == "payload_length"

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        shape = pa.schema([pa.field(n, _ARROW[SCHEMA[n].dataType]) for n in self.names])
        rows, size = [], 0
        for path, first, end in partition.parts:
            system = _opened(self.path)[0]
            with system.open_input_file(path) as source:
                raw = io.BufferedReader(source, 1 << 16)
                raw.seek(first)
                packed = raw.peek(2)[:2] == _MAGIC
                for file in _members(raw, end) if packed else [raw]:
                    for row in self._rows(file, None if packed else end):
                        rows.append(row)
                        size += len(row["payload"] or b"")
                        if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.names} for r in rows], shape)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in self.names} for r in rows], shape)


class _Inflated(io.RawIOBase):
    """What the next ``left`` packed bytes of a file hold, unpacked as far as it is read."""

    def __init__(self, raw: io.BufferedReader, left: int):
        self.raw, self.left, self.unpack = raw, left, zlib.decompressobj(-zlib.MAX_WBITS)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = b""
        while not data and not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed:
                packed = self.raw.read(min(2048, self.left))
                self.left -= len(packed)
                if not packed:
                    raise EOFError("a packed record ends too early")
            data = self.unpack.decompress(packed, len(buffer))
        buffer[: len(data)] = data
        return len(data)


class _Member(io.BufferedReader):
    """One packed record of known length."""


def _members(raw: io.BufferedReader, end: int | None) -> Iterator[io.BufferedIOBase]:
    """The packed records from where ``raw`` stands; from a member without a known length on, all in one."""
    while end is None or raw.tell() < end:
        start = raw.tell()
        head = raw.read(_SKIP.size)
        if not head:
            return
        known = len(head) == _SKIP.size and head[:4] == _MAGIC + b"\x08\x04"
        _, _, _, extra, field, size, packed, _ = _SKIP.unpack(head) if known else (None,) * 8
        if known and (extra, field, size) == (12, b"sl", 8):
            yield _Member(_Inflated(raw, packed - len(head) - 8), 2048)
            raw.seek(start + packed)
        else:
            raw.seek(start)
            yield gzip.GzipFile(fileobj=raw)
            return


def _packed(data: bytes) -> bytes:
    """A gzip member that tells its own packed and plain length, so that a reader can pass over it."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = deflate.compress(data) + deflate.flush()
    size = _SKIP.size + len(body) + 8
    head = _SKIP.pack(_MAGIC + b"\x08\x04", 0, 0xFF00, 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def _charset(http: dict[bytes, bytes]) -> str:
    name = http.get(b"content-type", b"").lower().partition(b"charset=")[2].split(b";")[0].strip(b" \"'").decode("ascii", "replace")
    try:
        return codecs.lookup(name).name if name else "utf-8"
    except LookupError:
        return "utf-8"



# Writing


@dataclass
class Files(WriterCommitMessage):
    """Names of files, each with the begins of its splits and its end."""

    files: list[tuple[str, list[int]]]


def _record(row: dict, date: str) -> tuple[bytes, bytes]:
    """Headers and block of one record."""
    payload = row["payload"] or b""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    if row["record_type"] != "revisit":
        block += payload
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_urn(row['page_id'])}>", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], _URL_SAFE)}")
    lines.append(f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(row['sha1'])).decode()}")
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: <{_urn(row['refers_to'])}>", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode(), block


def _urn(page_id: str | None) -> str:
    return "urn:page" if page_id is None else f"urn:page:{quote(page_id, '')}"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = path
        self.packed = options.get("compression", "gzip") == "gzip"
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        done, stream, at, splits = [], None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if stream is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
                    stream, at, splits = system.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20), 0, [0]
                    done.append((name, splits))
                if at - splits[-1] >= self.split_bytes:
                    splits.append(at)
                head, block = _record(row, self.date)
                data = head + block + b"\r\n\r\n"
                data = _packed(data) if self.packed else data
                stream.write(data)
                at += len(data)
                if at >= self.file_bytes:
                    stream.close()
                    splits.append(at)
                    stream = None
        if stream is not None:
            stream.close()
            splits.append(at)
        return Files(done)

    def commit(self, messages: list[Files | None]) -> None:
        system, path = _opened(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as stream:
            stream.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Files | None]) -> None:
        system, path = _opened(self.path)
        for name, _ in (f for m in messages if m for f in m.files):
            system.delete_file(f"{path}/{name}")


class WarcSource(DataSource):
    """Format ``warc``. Options of both ways: ``split_bytes``; of writing: ``file_bytes``, ``compression`` (gzip, none), ``date``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("an archive is appended to, not overwritten")
        return WarcWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets predicates reach it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, *columns: str, **options: object) -> DataFrame:
    """The records of a file or folder; without ``payload`` and ``text`` among the ``columns`` no payload is decoded."""
    register(spark)
    return spark.read.format("warc").schema(T.StructType([SCHEMA[c] for c in columns or SCHEMA.names])).options(**options).load(path)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """The records of ``pages`` (``page_id``, ``url``, ``html``) as ``record_type``, ids, ``url``, ``sha1``, ``payload_length``, ``payload``."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    keyed = keyed.select("*", F.sha1("payload").alias("sha1"), F.xxhash64("payload").alias("check"), F.octet_length("payload").cast("long").alias("payload_length"))
    small, large = keyed.where(F.col("payload_length") < min_bytes), keyed.where(F.col("payload_length") >= min_bytes)
    key = ["sha1", "check", "payload_length"]
    page = F.struct("page_id", "url")
    whole = large.groupBy(*key).agg(F.max(page).alias("page"), F.any_value("payload").alias("payload"))
    responses = whole.select(F.lit("response").alias("record_type"), "page.*", "sha1", "payload_length", F.col("page.page_id").alias("refers_to"), "payload")
    # Who repeats whom, without payloads: rows are counted first, then set against the greatest of their payload.
    counted = large.groupBy(*key, page.alias("page")).agg(F.count(F.lit(1)).alias("times"))
    heads = counted.groupBy(*key).agg(F.max("page").alias("head"), F.sum("times").alias("n")).where("n > 1")
    hot = heads.orderBy(F.desc("n"), *key).limit(HOT).drop("n")
    marked = counted.join(F.broadcast(hot), key, "left")
    cold = marked.where(F.col("head").isNull()).drop("head").join(heads.drop("n"), key)
    copies = marked.where(F.col("head").isNotNull()).unionByName(cold)
    times = F.col("times") - F.when(F.col("page").eqNullSafe(F.col("head")), 1).otherwise(0)
    chunks = copies.withColumn("times", times).where("times > 0").withColumn("part", F.explode(F.expr(f"sequence(0, (times - 1) div {CHUNK})")))
    spread = chunks.repartition("page", "part")
    again = F.explode(F.expr(f"sequence(1, least({CHUNK}, times - part * {CHUNK}))")).alias("copy")
    revisits = spread.select("*", again).select(
        F.lit("revisit").alias("record_type"), "page.*", "sha1", "payload_length", F.col("head.page_id").alias("refers_to"), F.lit(None).cast("binary").alias("payload")
    )
    out = responses.unionAll(revisits)
    if min_bytes > 0:
        out = out.unionAll(small.select(F.lit("response"), "page_id", "url", "sha1", "payload_length", "page_id", "payload"))
    return out


def write(pages: DataFrame, path: str, min_bytes: int = 0, **options: object) -> None:
    """Adds ``pages`` to the archive at ``path``."""
    register(pages.sparkSession)
    ids = {c: F.col(c).cast("string") for c in ("page_id", "refers_to")}
    records(pages, min_bytes).withColumns(ids).write.format("warc").mode("append").options(**options).save(path)


def query(pages: DataFrame) -> DataFrame:
    """Writes all pages to a new archive among the shared tables and reads their records' headers."""
    path = f"{scratch(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    kind = pages.schema["page_id"].dataType

    def page(urn: str):
        return F.when(F.col(urn).startswith("urn:page:"), F.url_decode(F.substring(urn, 10, 1 << 30))).cast(kind)

    found = read(pages.sparkSession, path, "record_type", "record_id", "payload_digest", "refers_to", "payload_length")
    return found.select(
        page("record_id").alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
