"""Legacy archives: ARC records parsed and written as equivalent WARC records.

An ARC archive opens with a version block: a ``filedesc://`` line, and a body that names the version.
Version 1 heads each record with ``URL IP date type length``; version 2 with ``URL IP date type status
checksum location offset filename length``.  The declared length delimits the body; a blank line
follows.  For each record the converter makes a WARC record: an identifier derived from its content,
the 14-digit date as ISO time, ``sha1:`` digests in base 32 of payload and block, and the type: of records
with equal payloads (of at least ``min_bytes``) the one with the largest key is the ``response``, the
others are ``revisit`` records without payload that refer to it.

Archives are written by Spark's own text writer, one record per row with the blank lines that end a
WARC record as its separator, so tasks commit whole files or none.  They are read back as binary
files of at most ``RECORDS`` records, unpacked record by record.  Python workers take Arrow
batches in slices and return them in batches of ``ARC_RECORDS`` rows or ``SLICE_BYTES`` bytes, so what
they hold beside their input does not grow with it.  Equal payloads are found on narrow (digest, key) rows,
aggregated before the shuffle.

Nulls and empties: a null payload is empty; a null key counts as smallest, and records whose largest
key is null are all responses.  Repeated rows with the largest key are all responses.  Addresses
lose white space and control characters to percent signs, null ones become empty ``urn:`` names.  An
empty table makes no archive records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import scratch_dir

#: Records of a WARC file, and of an ARC archive in memory.
RECORDS, ARC_RECORDS = 2000, 200
#: Payload bytes after which a batch of returned rows ends.
SLICE_BYTES = 4 << 20
#: Tasks a core that write archives: files are closed by records, so more tasks make only smaller ones.
WRITERS = 4
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Capture time of tables that carry none.
DATE = "20240101000000"
CONVERTED = "key long, url string, date string, ip string, head binary, payload binary, payload_bytes long, digest string, record_id string"
READ = "key long, record_type string, record_id string, refers_to_id string, url string, payload_bytes long, payload_digest string"
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def in_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ARC_RECORDS):
            yield batch.slice(at, ARC_RECORDS)


def as_batches(rows: Iterable[tuple], fields: str) -> Iterator[pa.RecordBatch]:
    """``rows`` of the DDL ``fields`` in batches of ``ARC_RECORDS``, earlier once they hold ``SLICE_BYTES``."""
    schema = pa.schema([(name, ARROW[kind]) for name, kind in (f.split() for f in fields.split(", "))])
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) == ARC_RECORDS or size >= SLICE_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(url: str | None) -> bytes:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:").encode(
        "utf-8", "surrogatepass"
    )


def http_block(key: int | None, payload: bytes) -> bytes:
    name = b"" if key is None else b"X-Page-Id: %d\r\n" % key
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n%s" % (name, len(payload), payload)


def build_arc(records: list[tuple[str | None, bytes]], version: int = 1, date: str = DATE) -> bytes:
    """An ARC archive of (url, body) records in either version of the format."""
    number = b"%d" % version
    extra = b" 200 - - 0 -" if version == 2 else b""
    spec = b"%s 0 gradeflow\n%s\n" % (number, FIELDS[number])
    lead = b"filedesc://pages.arc 0.0.0.0 %s text/plain" % date.encode()
    out = [b"%s%s %d\n%s\n" % (lead, extra, len(spec), spec)]
    for url, body in records:
        out.append(b"%s 0.0.0.0 %s text/html%s %d\n" % (_plain(url), date.encode(), extra, len(body)))
        out += [body, b"\n"]
    return b"".join(out)


def parse_arc(data: bytes) -> Iterator[tuple[str, str, str, bytes]]:
    """(url, ip, date, body) of every record after the version block.

    A header line of the wrong form, or a body shorter than declared, raises ValueError.
    """
    at, version = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        if version is None:
            if not line.startswith(b"filedesc://"):
                raise ValueError("an ARC archive starts with filedesc://")
            body = end + 1
            length = int(line.rsplit(b" ", 1)[1])
            version = data[body : body + length].split(b" ", 1)[0]
            if version not in FIELDS:
                raise ValueError(f"unknown ARC version {version!r}")
        else:
            count = FIELDS[version].count(b" ")
            fields = line.rsplit(b" ", count)
            if end < 0 or len(fields) != count + 1 or not fields[-1].isdigit():
                raise ValueError(f"not an ARC header line at byte {at}: {line[:80]!r}")
            body, length = end + 1, int(fields[-1])
            if body + length > len(data):
                raise ValueError(f"record at byte {at} is shorter than its declared length")
            yield fields[0].decode("utf-8", "replace"), fields[1].decode(), fields[2].decode(), data[body : body + length]
        at = body + length


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head with its blank line, and payload."""
    cut = block.find(b"\r\n\r\n")
    return (block[: cut + 4], block[cut + 4 :]) if cut >= 0 else (b"", block)


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n")[1:]:
        left, _, right = line.partition(b":")
        if left.strip().lower() == name:
            return right.strip()
    return None


def iso_date(date: str) -> str:
    """14 digits as ISO time; shorter dates are filled with their earliest moment."""
    full = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def converted(data: bytes) -> Iterator[tuple]:
    """Rows of ``CONVERTED`` for the records of one ARC archive."""
    for url, ip, date, block in parse_arc(data):
        head, payload = split_http(block)
        key = http_field(head, b"x-page-id")
        digest = sha1_base32(payload)
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{url} {date} {digest} {key}")
        yield (int(key) if key else None, url, iso_date(date), ip, head, payload, len(payload), digest, f"<urn:uuid:{name}>")


def archives(pages: DataFrame, version: int = 1, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(arc): ARC archives of the pages as binary values, one per ``ARC_RECORDS`` rows."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for part in in_slices(batches):
            keys = [int(k) if k is not None else None for k in part["key"].to_pylist()]
            bodies = [http_block(k, h or b"") for k, h in zip(keys, part["html"].to_pylist(), strict=True)]
            yield (build_arc(list(zip(part["url"].to_pylist(), bodies, strict=True)), version),)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return as_batches(built(batches), "arc binary")

    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url"), F.col(html).cast("binary").alias("html"))
    return rows.mapInArrow(write, "arc binary")


def convert(arcs: DataFrame, arc: str = "arc") -> DataFrame:
    """The records of ARC archives with all that their WARC records need, except the type."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for arc in batch.column(0) for row in converted(arc.as_py() or b""))
        return as_batches(found, CONVERTED)

    return arcs.select(F.col(arc).alias("arc")).mapInArrow(parse, CONVERTED)


def typed(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``records`` with ``winner``, the response that a revisit refers to (null for responses)."""
    same = (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("key", "record_id", "url", "date")).alias("winner"), F.count("*").alias("n"))
        .filter("n > 1 and winner.key is not null")
        .select("digest", "winner")
    )
    joined = records.join(same, "digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & ~F.col("winner.key").eqNullSafe(F.col("key"))
    return joined.withColumn("winner", F.when(revisit, F.col("winner")))


def warc_record(row: dict) -> bytes:
    """One record without the two line ends that close it."""
    revisit = row["winner"] is not None
    block = row["head"] if revisit else row["head"] + row["payload"]
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Target-URI: {row['url']}",
        f"WARC-IP-Address: {row['ip']}",
        f"WARC-Payload-Digest: sha1:{row['digest']}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
    ]
    if revisit:
        lines += [
            f"WARC-Profile: {PROFILE}",
            f"WARC-Refers-To: {row['winner']['record_id']}",
            f"WARC-Refers-To-Target-URI: {row['winner']['url']}",
            f"WARC-Refers-To-Date: {row['winner']['date']}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + block


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes typed records as WARC files below ``path``."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = ((warc_record(row),) for part in in_slices(batches) for row in part.to_pylist())
        return as_batches(made, "record binary")

    rows = records.select("record_id", "date", "url", "ip", "digest", "head", F.when(F.col("winner").isNull(), F.col("payload")).alias("payload"), "winner")
    (
        rows.mapInArrow(render, "record binary")
        .select(F.col("record").cast("string"))
        .coalesce(WRITERS * records.sparkSession.sparkContext.defaultParallelism)
        .write.option("lineSep", END)
        .option("compression", compression)
        .option("maxRecordsPerFile", RECORDS)
        .text(path)
    )


def parse_warc(data: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of every record, by declared lengths.

    A file is read record by record.
    """
    file, at = io.BytesIO(data) if isinstance(data, bytes) else data, 0
    while first := file.readline():
        lines = [first]
        while lines[-1] not in (b"\r\n", b""):
            lines.append(file.readline())
        if not lines[-1] or not first.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record at byte {at}")
        fields = {}
        for line in lines[1:-1]:
            name, _, field = line.partition(b":")
            fields[name.decode().strip().lower()] = field.decode("utf-8", "replace").strip()
        length = int(fields["content-length"])
        block = file.read(length)
        if len(block) < length:
            raise ValueError(f"record at byte {at} is shorter than its declared length")
        yield fields, block
        at += sum(map(len, lines)) + length + len(file.read(4))


def read_record(fields: dict[str, str], block: bytes) -> tuple:
    """A row of ``READ``."""
    head, payload = split_http(block)
    key = http_field(head, b"x-page-id")
    revisit = fields["warc-type"] == "revisit"
    size = int(http_field(head, b"content-length") or 0) if revisit else len(payload)
    digest = fields["warc-payload-digest"].partition(":")[2]
    if not revisit and digest != sha1_base32(payload):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return (int(key) if key else None, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to"),
            fields.get("warc-target-uri"), size, digest)


def read_file(data: bytes) -> Iterator[tuple]:
    """Rows of ``READ`` for the records of one WARC file (plain or gzip), unpacked as they are read."""
    file = io.BytesIO(data)
    if data[:2] == b"\x1f\x8b":
        file = io.BufferedReader(gzip.GzipFile(fileobj=file))
    return (read_record(fields, block) for fields, block in parse_warc(file))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the WARC files below ``path`` (plain or gzip)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for content in batch.column(0) for row in read_file(content.as_py()))
        return as_batches(found, READ)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, READ)


def with_references(read: DataFrame) -> DataFrame:
    """``read`` with ``refers_to``: the key of the record that a revisit refers to."""
    named = (
        read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("key").alias("refers_to"))
    )
    return read.join(named, "refers_to_id", "left")


def archive_pages(pages: DataFrame, version: int = 1, min_bytes: int = 0) -> DataFrame:
    """Pages through ARC and WARC and back: one row per page as read from the archives."""
    spark = pages.sparkSession
    path = scratch_dir(spark, "warc")
    write_warc(typed(convert(archives(pages, version)), min_bytes), path)
    return with_references(read_warc(spark, path))
