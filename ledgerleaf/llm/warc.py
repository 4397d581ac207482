"""WARC archives as a Spark data source, and an archive of web pages that stores equal payloads once.

Reading: the files are packed into partitions by size. Of each record the header is parsed first; predicates on the
record type and the other header columns are taken over from Spark and decide there. A payload is inflated only if its
record passes and the reader's schema asks for it. Archives from this writer have the lengths of each record in the
gzip header (extra field ``sl``), so an unwanted payload is stepped over without being inflated; in others it is
inflated in pieces and dropped. A file is read by one task, so the writer starts a new one at a size limit.

Writing: each attempt of a task writes files of its own, and only those named by the commit count, so lost executors,
repeated tasks and failed jobs leave nothing behind that a reader takes.

Files are opened with pyarrow's file systems, so a folder can be any URI that these know, on all machines alike.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from ledgerleaf.llm.common import BROADCAST_ROWS
from ledgerleaf.store import discard, materialize, new_path

#: Header field of each header column.
HEADERS = {
    "type": "warc-type", "record_id": "warc-record-id", "date": "warc-date", "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to",
}
SCHEMA = (
    "file string, type string, record_id string, date string, target_uri string, payload_digest string, refers_to string, "
    "headers map<string,string>, payload_length long, payload binary"
)
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PARTITION_BYTES = 128 << 20
ROLL_BYTES = 256 << 20
_CHUNK = 1 << 18
_BATCH_BYTES = 4 << 20
_BATCH_ROWS = 4096
_LONGEST_LINE = 1 << 24
_COMMITTED = "_committed-"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Stream:
    """Bytes of a plain file, in pieces."""

    def __init__(self, file):
        self.file, self.buffer, self.at = file, b"", 0

    def _more(self) -> bool:
        piece = self.file.read(_CHUNK)
        self._keep(piece)
        return bool(piece)

    def _keep(self, piece: bytes) -> None:
        self.buffer, self.at = self.buffer[self.at :] + piece, 0

    def line(self) -> bytes:
        """The next line with its end; empty at the end of the file."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if len(self.buffer) - self.at > _LONGEST_LINE:
                raise ValueError("a header line is too long for an archive")
            if not self._more():
                end = len(self.buffer) - 1
                break
        out = self.buffer[self.at : end + 1]
        self.at = end + 1
        return out

    def take(self, n: int) -> bytes:
        parts = []
        while n > 0:
            if self.at == len(self.buffer) and not self._more():
                raise ValueError("the archive ends within a record")
            part = self.buffer[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n <= held:
            self.at += n
            return
        end = self.file.tell() + n - held
        if end > self.file.size():
            raise ValueError("the archive ends within a record")
        self.buffer, self.at = b"", 0
        self.file.seek(end)


class GzipStream(Stream):
    """Inflated bytes of a file of gzip members; members with known lengths can be left without inflating them."""

    def __init__(self, file):
        super().__init__(file)
        self.raw, self.inflater = b"", None

    def _open_member(self) -> bool:
        while len(self.raw) < _CHUNK and (piece := self.file.read(_CHUNK)):
            self.raw += piece
        if not self.raw:
            return False
        self.start = self.file.tell() - len(self.raw)
        self.length = self.size = None
        if len(self.raw) >= 12 and self.raw[3] & 4:
            extra = self.raw[12 : 12 + struct.unpack_from("<H", self.raw, 10)[0]]
            while len(extra) >= 4:
                n = struct.unpack_from("<H", extra, 2)[0]
                if extra[:2] == b"sl" and n == 8:
                    self.length, self.size = struct.unpack_from("<II", extra, 4)
                extra = extra[4 + n :]
        self.given, self.inflater = 0, zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        while True:
            if self.inflater is None and not self._open_member():
                return False
            if not self.raw:
                self.raw = self.file.read(_CHUNK)
                if not self.raw:
                    raise ValueError("the archive ends within a member")
            piece = self.inflater.decompress(self.raw, _CHUNK)
            self.raw = self.inflater.unused_data if self.inflater.eof else self.inflater.unconsumed_tail
            self.given += len(piece)
            if self.inflater.eof:
                self.inflater = None
            if piece:
                self._keep(piece)
                return True

    def skip(self, n: int) -> None:
        held = len(self.buffer) - self.at
        if n > held and self.inflater and self.size is not None and held <= self.given and self.given - held + n == self.size:
            end = self.start + self.length
            if end > self.file.size():
                raise ValueError("the archive ends within a record")
            self.buffer, self.at, self.raw, self.inflater = b"", 0, b"", None
            self.file.seek(end)
            return
        while n > 0:
            if self.at == len(self.buffer) and not self._more():
                raise ValueError("the archive ends within a record")
            step = min(n, len(self.buffer) - self.at)
            self.at += step
            n -= step


def _fields(stream: Stream) -> tuple[dict[str, str], int]:
    """Named fields up to an empty line, and the bytes read. Names in lower case; of a repeated field the first counts."""
    fields, name, used = {}, None, 0
    while line := stream.line():
        used += len(line)
        text = line.rstrip(b"\r\n").decode("utf-8", "replace")
        if not text:
            break
        if text[0] in " \t" and name:
            fields[name] += " " + text.strip()
            continue
        key, _, value = text.partition(":")
        name = key.strip().lower()
        if name in fields:
            name = None
        else:
            fields[name] = value.strip()
    return fields, used


def records(stream: Stream, wanted, with_http: bool, with_payload: bool) -> Iterator[tuple[dict, int | None, bytes | None]]:
    """(header fields, payload length, payload) of the records whose header fields are wanted."""
    while True:
        line = stream.line()
        while line in (b"\r\n", b"\n"):
            line = stream.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"an archive record starts with {line[:40]!r}")
        fields, _ = _fields(stream)
        left = int(fields["content-length"])
        if not wanted(fields):
            stream.skip(left + 4)
            continue
        revisit = fields.get("warc-type") == "revisit"
        length = left
        if with_http and fields.get("content-type", "").startswith("application/http"):
            status = stream.line()
            http, used = _fields(stream)
            left -= len(status) + used
            told = http.get("content-length", "")
            length = (int(told) if told.isdigit() else None) if revisit else left
        payload = stream.take(left) if with_payload and not revisit else None
        stream.skip((0 if payload is not None else left) + 4)
        yield fields, length, payload


def accepts(test: Filter, value: str | None) -> bool:
    """Whether a header value passes a predicate; null passes only tests for null."""
    kind = type(test)
    if kind is Not:
        if type(test.child) in (IsNull, IsNotNull, EqualNullSafe):
            return not accepts(test.child, value)
        return value is not None and not accepts(test.child, value)
    if kind is IsNull:
        return value is None
    if kind is EqualNullSafe:
        return value == test.value
    if value is None:
        return False
    if kind is IsNotNull:
        return True
    return _TESTS[kind](value, test.value)


_TESTS = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x, In: lambda v, x: v in x, StringStartsWith: lambda v, x: v.startswith(x),
    StringEndsWith: lambda v, x: v.endswith(x), StringContains: lambda v, x: x in v,
}


@dataclass
class ArchiveFiles(InputPartition):
    files: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        known = {column.split(" ")[0] for column in SCHEMA.split(", ")}
        if unknown := [f.name for f in schema.fields if f.name not in known]:
            raise ValueError(f"archives have no columns {unknown}")
        self.columns = [f.name for f in schema.fields]
        self.path, self.most = options["path"], int(options.get("partitionBytes", PARTITION_BYTES))
        self.tests: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            inner = test.child if isinstance(test, Not) else test
            column = inner.attribute[0] if len(inner.attribute) == 1 else None
            if column in HEADERS and (type(inner) in _TESTS or isinstance(inner, (IsNull, IsNotNull, EqualNullSafe))):
                self.tests.append((column, test))
            else:
                yield test

    def partitions(self) -> list[ArchiveFiles]:
        """Files packed up to a size. Where jobs have committed, only their files count, else all archives of the folder."""
        from pyarrow import fs

        system, root = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        committed = [f.path for f in found if f.base_name.startswith(_COMMITTED)]
        named = {name for path in committed for name in json.loads(system.open_input_file(path).read())}
        sizes = sorted(
            (f.path, f.size) for f in found
            if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and (not committed or f.base_name in named)
        )
        if missing := named - {path.rsplit("/", 1)[-1] for path, _ in sizes}:
            raise ValueError(f"{len(missing)} archives of {self.path} are missing, the first is {min(missing)}")
        parts, room = [ArchiveFiles([])], self.most
        for path, size in sizes:
            if parts[-1].files and size > room:
                parts.append(ArchiveFiles([]))
                room = self.most
            parts[-1].files.append(path)
            room -= size
        return parts

    def _wanted(self, fields: dict[str, str]) -> bool:
        return all(accepts(test, _header(fields, column)) for column, test in self.tests)

    def read(self, partition: ArchiveFiles) -> Iterator:
        import pyarrow as pa

        kinds = {"headers": pa.map_(pa.string(), pa.string()), "payload_length": pa.int64(), "payload": pa.binary()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        with_payload = "payload" in self.columns
        system, _ = _file_system(self.path)
        rows, held = [], 0
        for path in partition.files:
            with system.open_input_file(path) as file:
                stream = GzipStream(file) if path.endswith(".gz") else Stream(file)
                for fields, length, payload in records(stream, self._wanted, with_payload or "payload_length" in self.columns, with_payload):
                    special = {"file": path, "headers": list(fields.items()), "payload_length": length, "payload": payload}
                    rows.append([special[c] if c in special else _header(fields, c) for c in self.columns])
                    held += len(payload or b"")
                    if held >= _BATCH_BYTES or len(rows) >= _BATCH_ROWS:
                        yield _batch(rows, schema)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _header(fields: dict[str, str], column: str) -> str | None:
    return fields.get(HEADERS[column])


def _batch(rows: list[list], schema):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


@dataclass
class WrittenFiles(WriterCommitMessage):
    names: list[str]


def _safe(value: str) -> str:
    """A header value on one line: control characters and blanks at the ends are percent-encoded."""
    inner = value.strip(" ")
    start = value.find(inner) if inner else len(value)
    text = "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in inner)
    return "%20" * start + text + "%20" * (len(value) - start - len(inner))


def record_bytes(row: dict) -> bytes:
    """One record: header fields, and an HTTP response with the payload (a revisit has the response's head only)."""
    payload = row.get("payload") or b""
    revisit = row["type"] == "revisit"
    length = row["payload_length"] if row.get("payload_length") is not None else len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = {
        "WARC-Type": row["type"], "WARC-Record-ID": row.get("record_id") or f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": row.get("date"),
        "WARC-Target-URI": row.get("target_uri"), "WARC-Payload-Digest": row.get("payload_digest"), "WARC-Refers-To": row.get("refers_to"),
        "WARC-Profile": _REVISIT if revisit else None, "Content-Type": "application/http; msgtype=response",
        **{k: v for k, v in row.get("headers") or []},
    }
    block = http if revisit else http + payload
    head = "".join(f"{k}: {_safe(v)}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def member(content: bytes, level: int = 6) -> bytes:
    """A gzip member that holds its own lengths, packed and unpacked, in the extra field ``sl``."""
    deflater = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflater.compress(content) + deflater.flush()
    total = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total, len(content))
    return head + body + struct.pack("<II", zlib.crc32(content), len(content) & 0xFFFFFFFF)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.roll, self.overwrite = options["path"], int(options.get("rollBytes", ROLL_BYTES)), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> WrittenFiles:
        from pyspark import TaskContext

        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        task, names, out = TaskContext.get().partitionId(), [], None
        attempt = uuid.uuid4().hex
        try:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if out is None:
                        names.append(f"part-{task:05d}-{len(names):03d}-{attempt}.warc.gz")
                        out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        out.write(member(_info(names[-1])))
                    data = member(record_bytes({c: batch.column(c)[i].as_py() for c in batch.schema.names}))
                    out.write(data)
                    size += len(data)
                    if size >= self.roll:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return WrittenFiles(names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, root = _file_system(self.path)
        system.create_dir(root, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(root)) if f.is_file] if self.overwrite else []
        names = sorted(name for m in messages if m for name in m.names)
        with system.open_output_stream(f"{root}/{_COMMITTED}{self.job}", compression=None) as out:
            out.write(json.dumps(names).encode())
        for path in sorted(old, key=lambda p: not p.rsplit("/", 1)[-1].startswith(_COMMITTED)):
            if path.rsplit("/", 1)[-1] not in names:
                system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, root = _file_system(self.path)
        for name in [name for m in messages if m for name in m.names]:
            system.delete_file(f"{root}/{name}")


def _info(name: str) -> bytes:
    body = b"software: ledgerleaf\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Filename: {name}\r\n"
    return head.encode() + f"Content-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; options path, partitionBytes, rollBytes.

    A schema with some of the columns reads only those. Written columns are those of the schema other than file; only
    type is needed.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as executors need it."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    text = system.makeQualified(location).toString()
    return "file://" + text.removeprefix("file:") if text.startswith("file:/") and not text.startswith("file://") else text


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options: str) -> DataFrame:
    """Records of the archives in a folder. Turns on Spark's pushdown of predicates to Python data sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set(PUSHDOWN, "true")
    return spark.read.format("warc").schema(columns).options(**options).load(_qualified(spark, path))


def write_warc(table: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    table.sparkSession.dataSource.register(WarcSource)
    table.write.format("warc").mode(mode).options(**options).save(_qualified(table.sparkSession, path))


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32 with the letters A to Z and 2 to 7: four digits for each five hexadecimal ones."""
    digest = F.sha1(payload)
    digits = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


_SALTS = 32


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record for each row of page_id, url and html.

    Of equal payloads of at least ``min_bytes`` bytes the record with the smallest page_id is the response, and the
    others are revisits that refer to it and hold no payload. Defined cases: null html is an empty payload; a null
    page_id comes after all others; of repeated rows with the smallest id one is the response; a null url has no
    target field; an empty table commits no archive. Other columns are not read. Equal payloads are found by SHA-256;
    what a group's rows need to know of it is one narrow row, broadcast if there are few and else joined in salted parts.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    staged = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_length"), F.concat(F.lit("sha1:"), base32_sha1(F.col("payload"))).alias("payload_digest"),
        F.sha2("payload", 256).alias("_key"), F.monotonically_increasing_id().alias("_row"),
    )
    staged = materialize(staged, "warc-pages")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "_row"))
    firsts = staged.filter(F.col("payload_length") >= min_bytes).groupBy("_key").agg(least.alias("_first"), F.count(F.lit(1)).alias("_n"))
    firsts = materialize(firsts.filter("_n > 1").select("_key", "_first"), "warc-firsts")
    if firsts.count() <= BROADCAST_ROWS:
        joined = staged.join(F.broadcast(firsts), "_key", "left")
    else:
        salted = firsts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        joined = staged.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(_SALTS))).join(salted, ["_key", "_salt"], "left")
    revisit = F.coalesce(F.col("_first._row") != F.col("_row"), F.lit(False))

    def name(page: Column, row: Column) -> Column:
        return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))

    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("type"), name(F.col("page_id"), F.col("_row")).alias("record_id"),
        F.lit(date).alias("date"), F.col("url").alias("target_uri"), "payload_digest", "payload_length",
        F.when(revisit, name(F.col("_first.page_id"), F.col("_first._row"))).alias("refers_to"), F.when(~revisit, F.col("payload")).alias("payload"),
    )
    write_warc(out, folder)
    discard(staged, firsts)


def archived_pages(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the archived pages.

    Length and digest of a response come from the payload read back, those of a revisit from its header fields.
    """
    page = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d*):", 1).try_cast("long")
    responses = read_warc(spark, folder, "type string, record_id string, payload binary").filter("type = 'response'")
    revisits = read_warc(spark, folder, "type string, record_id string, payload_digest string, refers_to string, payload_length long").filter("type = 'revisit'")
    return responses.select(
        page(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"),
    ).unionByName(
        revisits.select(
            page(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"),
            F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), F.col("type").alias("record_type"), page(F.col("refers_to")).alias("refers_to"),
        )
    )


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns, out of archives in the shared folder."""
    folder = new_path(pages.sparkSession, "warc")
    archive_pages(pages, folder)
    return archived_pages(pages.sparkSession, folder)


SQL = """
WITH p AS (SELECT row_number() OVER () AS r, page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT *, first_value(r) OVER w AS first_r, first_value(page_id) OVER w AS first_page FROM p WINDOW w AS (PARTITION BY b ORDER BY page_id NULLS LAST, r)),
h AS (SELECT *, sha1(b) AS x FROM f)
SELECT page_id, octet_length(b) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((CAST('0x' || substr(x, CAST(1 + 5 * (i // 4) AS INTEGER), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN r <> first_r THEN first_page END AS refers_to
FROM h
"""
