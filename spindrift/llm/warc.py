"""Legacy archive converter: ARC files of either version to WARC files, and a reader of both.

``write_arc`` stores pages as ARC files, each file starting with its version
block; ``read_arc`` parses them by the field names and declared lengths of that
block; ``convert`` synthesises WARC records with ids, dates, types and digests;
``read_warc`` reads those back by their declared lengths.

Records are written by Spark's text writer, whose line separator is the end of
a record: bytes pass through it unchanged, a file exists only once its task has
committed, and any store that Spark writes to will do.  Payloads cross the
cluster once, compressed, as whole archive files; what decides between a
response and a revisit is a narrow table of digests.

Defined cases: a null payload is empty; a null url becomes ``urn:page:null``,
and white space or control characters in a url are percent-encoded, as header
lines need; a null page_id is archived without the id's header and read back as
null; equal payloads revisit the record with the smallest page_id (nulls last,
then first in the archives), also among rows with the same page_id; empty
tables give empty archives; only ``page_id``, ``url`` and ``html`` are read of
the input, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, tidy, written
from spindrift.session import run_dir

RECORDS_PER_FILE = 2_000
ARC_DATE = "20240101000000"
CONTENT_TYPE = "text/html; charset=utf-8"
CRLF = b"\r\n"
WARC_END = "\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 9562

# The fields of a record's header line by version, as each file's version block repeats them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}

ARC_RECORDS = pa.schema(
    [("file", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
     ("payload_digest", pa.string())]
)
WARC_RECORDS = pa.schema(
    [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to_id", pa.string()),
     ("target_uri", pa.string()), ("date", pa.string())]
)


def header_url(url: str | None) -> str:
    text = "urn:page:null" if url is None else url
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in text) or "urn:page:empty"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_response(page_id: int | None, payload: bytes) -> bytes:
    lines = ["HTTP/1.1 200 OK", f"Content-Type: {CONTENT_TYPE}", f"Content-Length: {len(payload)}"]
    lines += [] if page_id is None else [f"X-Page-Id: {page_id}"]
    return "\r\n".join([*lines, "", ""]).encode() + payload


def version_block(version: int) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    block = f"filedesc://pages.arc 0.0.0.0 {ARC_DATE} text/plain ".encode()
    return block + ({1: b"", 2: b"200 - - 0 pages.arc "}[version]) + f"{len(body)}\n".encode() + body


def as_lines(records: DataFrame, path: str, end: str, per_file: int) -> None:
    """Write binary records, each followed by ``end``."""
    (
        records.select(F.col("record").cast("string")).write.option("lineSep", end)
        .option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)
    )


def write_arc(pages: DataFrame, path: str, version: int = 1, per_file: int = RECORDS_PER_FILE) -> None:
    """Store pages as gzipped ARC files of one version."""
    schema = pa.schema([("record", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            out = []
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for page_id, url, html in zip(ids, urls, batch.column("html").cast(pa.binary()).to_pylist()):
                if n % per_file == 0:  # the writer starts a file here
                    out.append(version_block(version))
                    n += 1
                body = http_response(page_id, html or b"")
                head = f"{header_url(url)} 0.0.0.0 {ARC_DATE} text/html "
                head += {1: "", 2: "200 - - 0 pages.arc "}[version] + f"{len(body)}\n"
                out.append(head.encode() + body)
                n += 1
            yield batch_of(schema, out)

    columns = [F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")]
    as_lines(pages.select(*columns).mapInArrow(tidy(records), "record binary"), path, "\n", per_file)


class Archive:
    """A gzipped archive held compressed, opened a stretch at a time."""

    def __init__(self, data: bytes):
        self.data, self.rest = memoryview(data), b""
        self.inflate, self.at, self.held, self.position = zlib.decompressobj(31), 0, bytearray(), 0

    def fill(self, n: int) -> bool:
        """Hold ``n`` bytes, if that many are left."""
        while len(self.held) < n:
            source = self.rest or self.data[self.at : self.at + (1 << 16)]
            if not len(source):
                return False
            if not self.rest:
                self.at += len(source)
            if self.inflate.eof:  # archives may have a gzip member for each record
                self.inflate = zlib.decompressobj(31)
            self.held += self.inflate.decompress(source)
            self.rest = self.inflate.unused_data
        return True

    def take(self, n: int) -> bytes:
        if not self.fill(n):
            raise ValueError(f"archive ends within a record at {self.position}")
        out = bytes(self.held[:n])
        del self.held[:n]
        self.position += n
        return out

    def until(self, end: bytes) -> bytes | None:
        """What comes before ``end``, which is dropped; None at the archive's end."""
        seen = 0
        while (i := self.held.find(end, max(0, seen - len(end)))) < 0:
            seen = len(self.held)
            if not self.fill(seen + 1):
                return None
        out = self.take(i)
        self.take(len(end))
        return out


def arc_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, body) of each record; the version block names the fields."""
    archive, fields = Archive(data), []
    while True:
        position = archive.position
        line = archive.until(b"\n")
        if line is None:
            return
        if not line:
            continue
        values = line.decode("utf-8", "surrogateescape").split(" ")
        body = archive.take(int(values[-1]))
        if values[0].startswith("filedesc:"):
            version, names = body.split(b"\n")[:2]
            fields = names.decode().split(" ")
            if fields != ARC_FIELDS.get(int(version.split(b" ")[0]), "").split(" "):
                raise ValueError(f"unknown ARC version block: {body[:80]!r}")
            continue
        # A content type may hold spaces: the fields before and after it do not.
        extra = len(values) - len(fields)
        kind = fields.index("Content-type")
        values[kind : kind + extra + 1] = [" ".join(values[kind : kind + extra + 1])]
        yield position, dict(zip(fields, values)), body


def http_parts(body: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers by lower-case name, the header block, and the payload."""
    block, found, payload = body.partition(b"\r\n\r\n")
    if not found or not block.startswith(b"HTTP/"):
        return {}, b"", body
    lines = (line.partition(b":") for line in block.split(CRLF)[1:])
    headers = {k.strip().lower().decode("latin-1"): v.strip().decode("latin-1") for k, _, v in lines}
    return headers, block + b"\r\n\r\n", payload


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "content")


def page_id_of(headers: dict[str, str]) -> int | None:
    return int(headers["x-page-id"]) if "x-page-id" in headers else None


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Place, page_id, size and digest of each record's payload."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column("file").to_pylist(), batch.column("content")):
                rows = []
                for position, _, body in arc_records(data.as_buffer()):
                    headers, _, payload = http_parts(body)
                    rows.append((file, position, page_id_of(headers), len(payload), digest_of(payload)))
                yield batch_of(ARC_RECORDS, *(zip(*rows) if rows else [[]] * 5))

    schema = "file string, position long, page_id long, payload_bytes long, payload_digest string"
    return archive_files(spark, path).mapInArrow(tidy(parse), schema)


def record_id(file: str, position: int) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{file}/{position}')}"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogateescape") + block


def revisits(records: DataFrame, min_bytes: int) -> DataFrame:
    """For each file, the records that revisit another: (position, file and position of the other)."""
    place = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "position")
    equal = ["payload_digest", "payload_bytes"]
    first = records.groupBy(*equal).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = records.join(first, equal).filter(
        (F.col("payload_bytes") >= min_bytes)
        & ((F.col("file") != F.col("first.file")) | (F.col("position") != F.col("first.position")))
    )
    each = F.struct("position", F.col("first.file").alias("to_file"), F.col("first.position").alias("to_position"))
    return again.groupBy("file").agg(F.collect_list(each).alias("again"))  # no longer than its file


def convert(
    spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0, per_file: int = RECORDS_PER_FILE
) -> None:
    """Write the records of ARC files as WARC files, equal payloads of ``min_bytes`` or more only once."""
    records = written(read_arc(spark, arc_path), "arc-records")
    files = archive_files(spark, arc_path).join(revisits(records, min_bytes), "file", "left")
    schema = pa.schema([("record", pa.binary())])

    def synthesise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, out, size = 0, [], 0
        info = warc_record(
            [("WARC-Type", "warcinfo"), ("WARC-Date", "2024-01-01T00:00:00Z"),
             ("WARC-Record-ID", f"<{record_id('warcinfo', 0)}>"), ("Content-Type", "application/warc-fields")],
            b"format: WARC File Format 1.0\r\n",
        )
        for batch in batches:
            rows = zip(batch.column("file").to_pylist(), batch.column("content"), batch.column("again").to_pylist())
            for file, data, again in rows:
                refers = {x["position"]: (x["to_file"], x["to_position"]) for x in again or []}
                for position, fields, body in arc_records(data.as_buffer()):
                    _, head, payload = http_parts(body)
                    d = fields["Archive-date"]
                    to = refers.get(position)
                    block = head if to else body
                    lines = [
                        ("WARC-Type", "revisit" if to else "response"),
                        ("WARC-Target-URI", fields["URL"]),
                        ("WARC-Date", f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"),
                        ("WARC-Record-ID", f"<{record_id(file, position)}>"),
                        ("WARC-IP-Address", fields["IP-address"]),
                        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
                        ("WARC-Block-Digest", f"sha1:{digest_of(block)}"),
                        ("Content-Type", "application/http; msgtype=response" if head else fields["Content-type"]),
                    ]
                    if to:
                        lines += [
                            ("WARC-Profile", "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"),
                            ("WARC-Refers-To", f"<{record_id(*to)}>"),
                        ]
                    if n % per_file == 0:
                        out.append(info)
                        n += 1
                    out.append(warc_record(lines, block))
                    n, size = n + 1, size + len(block)
                    if size > 4 << 20:
                        yield batch_of(schema, out)
                        out, size = [], 0
        yield batch_of(schema, out)

    as_lines(files.mapInArrow(tidy(synthesise), "record binary"), warc_path, WARC_END, per_file)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields by lower-case name and block of each record."""
    archive = Archive(data)
    while True:
        head = archive.until(b"\r\n\r\n")
        if head is None:
            return
        version, *lines = head.decode("utf-8", "surrogateescape").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {archive.position}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        block = archive.take(int(fields["content-length"]))
        if archive.take(4) != b"\r\n\r\n":
            raise ValueError(f"no record end at {archive.position}")
        yield fields, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row for each response or revisit, checked against its block's digest."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                rows = []
                for fields, block in warc_records(data.as_buffer()):
                    kind = fields["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    if fields["warc-block-digest"] != f"sha1:{digest_of(block)}":
                        raise ValueError(f"damaged block: {fields['warc-record-id']}")
                    headers, _, payload = http_parts(block)
                    size = int(headers.get("content-length", len(payload))) if kind == "revisit" else len(payload)
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    ids = fields["warc-record-id"].strip("<>"), (fields.get("warc-refers-to") or "").strip("<>") or None
                    rows.append((page_id_of(headers), size, digest, kind, *ids, fields["warc-target-uri"], fields["warc-date"]))
                yield batch_of(WARC_RECORDS, *(zip(*rows) if rows else [[]] * 8))

    schema = (
        "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, "
        "refers_to_id string, target_uri string, date string"
    )
    return archive_files(spark, path).mapInArrow(tidy(parse), schema)


def archived_pages(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC files: what the WARC files say of each, with the page that a revisit refers to."""
    spark = pages.sparkSession
    arc, warc = run_dir(spark, "arc"), run_dir(spark, "warc")
    write_arc(pages, arc, version)
    convert(spark, arc, warc, min_bytes)
    records = written(read_warc(spark, warc), "warc-records")
    targets = records.filter("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")
    )
    # Only revisits are joined: responses refer to nothing.
    again = records.filter("record_type = 'revisit'").join(targets, "refers_to_id", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    first = records.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return first.select(*columns).unionByName(again.select(*columns))
