"""WARC archives as a PySpark data source.

Writing: one record for each row, each record a gzip member of its own (or plain), in files that
roll over at a size. The member's header carries its compressed length, as the WARC standard's
annex on gzip describes. Reading: each file is a partition; a record's WARC headers are parsed
first, predicates on them are pushed down to that point, and the payload of a record that they
rule out, or that the query doesn't ask for, is skipped without decoding.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import checkpoint, filesystem, shared_path

MIN_REVISIT_BYTES = 1_000
#: Repeated digests that are broadcast, so that no payload is shuffled; of more, Spark chooses how to join.
MAX_BROADCAST = 500_000
FILE_BYTES = 1 << 30
BATCH_BYTES = 8 << 20
DATE = "2025-01-01T00:00:00Z"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:pages")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a record gives. payload_digest is the bare lower-case hex of a SHA-1 digest.
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id", "payload_digest": "warc-payload-digest"}


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def line(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit record without its payload; both keep the payload's length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", line(url)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if revisit:
        head += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """data as a gzip member whose extra field `sl` has its compressed and uncompressed lengths; one that
    is too long for the field has none, and is read through instead of skipped."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(data) + packer.flush()
    size = 24 + len(body) + 8
    if max(size, len(data)) >= 1 << 32:
        return struct.pack("<4sIBB", b"\x1f\x8b\x08\x00", 0, 0, 255) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    head = struct.pack("<4sIBB", b"\x1f\x8b\x08\x04", 0, 0, 255) + struct.pack("<H2sHII", 12, b"sl", 8, size & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def fields(head: bytes) -> dict[str, str]:
    """The named fields of a header, by lower-case name; continued lines are joined."""
    out: dict[str, str] = {}
    name = ""
    for row in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if row[:1] in (" ", "\t") and name:
            out[name] += " " + row.strip()
        elif ":" in row:
            name, value = row.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def values(own: dict[str, str]) -> dict:
    """The header columns of SCHEMA."""
    out = {k: own.get(v) for k, v in HEADERS.items()}
    for k in ("page_id", "refers_to"):
        out[k] = int(out[k]) if out[k] is not None else None
    digest = out["payload_digest"]
    if digest and digest.lower().startswith("sha1:"):
        digest = digest[5:]
        out["payload_digest"] = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower()
    return out


def passes(own: dict, filters: list[Filter]) -> bool:
    for f in filters:
        x = own[f.attribute[0]]
        if isinstance(f, IsNotNull) and x is None or isinstance(f, EqualTo) and x != f.value or isinstance(f, In) and x not in f.value or isinstance(f, StringStartsWith) and not (x or "").startswith(f.value):
            return False
    return True


class Records:
    """Reads the records of one open file in turn: head() gives the next one's WARC header, or None;
    then either block() gives its content or skip() leaves it."""

    STEP = 1 << 16

    def __init__(self, f):
        self.f, self.start, self.size = f, 0, f.size()

    def head(self) -> bytes | None:
        if self.start >= self.size:
            return None
        self.f.seek(self.start)
        data = self.f.read(self.STEP)
        self.gzip = data[:2] == b"\x1f\x8b"
        if not self.gzip:
            while (end := data.find(b"\r\n\r\n")) < 0:
                more = self.f.read(self.STEP)
                if not more:
                    raise ValueError("a record's header doesn't end")
                data += more
            self.at, self.kept = self.start + end + 4, data[end + 4 :]
            return data[:end]
        self.next = None
        if data[3] & 4:
            extra = data[12 : 12 + struct.unpack("<H", data[10:12])[0]]
            while len(extra) >= 4:
                n = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and n == 8:
                    self.next = self.start + struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + n :]
        self.unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
        out = self.unpack.decompress(data, 4096)
        while (end := out.find(b"\r\n\r\n")) < 0:
            more = self._more(4096)
            if not more:
                raise ValueError("a record's header doesn't end")
            out += more
        self.kept = out[end + 4 :]
        return out[:end]

    def _more(self, most: int) -> bytes:
        """More of the member's content; empty at its end."""
        while not self.unpack.eof:
            data = self.unpack.unconsumed_tail or self.f.read(self.STEP)
            if not data:
                raise ValueError("a gzip member is cut off")
            if got := self.unpack.decompress(data, most):
                return got
        return b""

    def block(self, length: int) -> bytes:
        if not self.gzip:
            self.f.seek(self.at)
            self.start = self.at + length + 4
            return self.f.read(length)
        parts = [self.kept]
        while more := self._more(1 << 20):
            parts.append(more)
        self.start = self.f.tell() - len(self.unpack.unused_data)
        return b"".join(parts)[:length]

    def skip(self, length: int) -> None:
        if not self.gzip:
            self.start = self.at + length + 4
        elif self.next is not None:
            self.start = self.next
        else:
            self.block(length)


@dataclass
class File(InputPartition):
    uri: str


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.names, self.filters = options["path"], schema.names, []
        self.arrow = pa.schema([(x.name, {"long": pa.int64(), "binary": pa.binary()}.get(x.dataType.typeName(), pa.string())) for x in schema])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes what can be told from a header; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[File]:
        fs, path = filesystem(self.path)
        found = fs.get_file_info(pa.fs.FileSelector(path))
        base = self.path.rstrip("/")
        return [File(f"{base}/{x.base_name}") for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without files
            return
        fs, path = filesystem(partition.uri)
        rows, size = [], 0
        with fs.open_input_file(path) as f:
            records = Records(f)
            while (head := records.head()) is not None:
                own = fields(head)
                length, out = int(own["content-length"]), values(own)
                if not passes(out, self.filters):
                    records.skip(length)
                    continue
                http, revisit = own.get("content-type", "").startswith("application/http"), own["warc-type"] == "revisit"
                inner, whole, _ = records.kept.partition(b"\r\n\r\n") if http else (b"", b"", b"")
                told = fields(inner).get("content-length") if whole else None
                if "payload" not in self.names and ("payload_bytes" not in self.names or told):
                    records.skip(length)
                    out["payload_bytes"] = int(told or 0)
                else:
                    block = records.block(length)
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    out |= {"payload": None if revisit else payload, "payload_bytes": int(told) if revisit and told else len(payload)}
                rows.append(tuple(out.get(x) for x in self.names))
                size += 200 + len(out.get("payload") or b"")
                if size >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), self.arrow.types, strict=True)], schema=self.arrow)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Each attempt of a task writes files of its own under _attempts; commit() moves those of the
    attempts that succeeded, so what lost executors or repeated tasks leave is never read."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.level = int(options.get("level", "1")) if options.get("compression", "gzip") == "gzip" else None
        self.file_bytes = int(options.get("fileBytes", str(FILE_BYTES)))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = filesystem(self.path)
        fs.create_dir(f"{path}/_attempts", recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= self.file_bytes:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc" + ".gz" * (self.level is not None))
                    out, size = fs.open_output_stream(f"{path}/_attempts/{names[-1]}", compression=None), 0
                data = record(row["page_id"], row["url"], row["payload"] or b"", row["refers_to"], row["record_type"] == "revisit")
                data = data if self.level is None else member(data, self.level)
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(f"{path}/_attempts/{name}", f"{path}/{name}")
        fs.create_dir(path, recursive=True)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = filesystem(self.path)
        if fs.get_file_info(f"{path}/_attempts").type == pa.fs.FileType.Directory:
            fs.delete_dir(f"{path}/_attempts")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(folder); a schema with some of SCHEMA's columns reads those alone."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, **options: str) -> None:
    """Archive each row of pages(page_id, url, html, ...) in path; other columns are ignored.

    Of the rows with equal payloads of min_revisit_bytes or more, those with the largest page_id are
    response records, the others revisit records of it, rows without page_id among them; if none has
    a page_id all are responses. A null html is an empty payload. Repeated rows give repeated records.
    Only digests that occur more than once are joined to the pages, and broadcast up to MAX_BROADCAST.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.when(F.octet_length(payload) >= min_revisit_bytes, F.sha1(payload))
    keys = pages.select("page_id", digest.alias("digest")).where("digest is not null")
    first = checkpoint(keys.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("__digest"), "first"))
    first = F.broadcast(first) if first.count() <= MAX_BROADCAST else first
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("__d")).join(first, F.col("__d") == F.col("__digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))
    out.write.format("warc").options(**options).mode("append").save(path)


def read_records(spark: SparkSession, path: str, columns: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.read.format("warc").schema(columns).load(path)


def archived(pages: DataFrame, **options: str) -> DataFrame:
    """Archive pages and read the records back: (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    Responses and revisits are read each by a pushed-down predicate on the record type. A response's
    length and digest are taken from the payload read; one that differs from its header raises an
    error. A revisit's are those of its headers, and its block isn't decoded.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_pages(pages, path, **options)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    full = read_records(spark, path).where("record_type = 'response'")
    digest = F.when(F.sha1("payload") == F.col("payload_digest"), F.col("payload_digest"))
    full = full.withColumn("payload_digest", F.coalesce(digest, F.raise_error(F.lit("a payload differs from its digest")).cast("string")))
    heads = read_records(spark, path, SCHEMA.removesuffix(", payload binary")).where("record_type = 'revisit'")
    return full.select(names).unionByName(heads.select(names))


#: The same in DuckDB.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS b FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS f FROM p),
r AS (SELECT *, b >= 1000 AND f IS NOT NULL AND page_id IS DISTINCT FROM f AS again FROM g)
SELECT page_id, b AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN f END AS refers_to
FROM r
"""
