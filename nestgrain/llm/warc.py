"""Legacy ARC archives converted to WARC, with repeated payloads as revisit records.

The converter reads ARC containers record by record: the first record names the version and
with it the fields of the header lines (five in version 1, ten in version 2); every line
declares how many bytes follow. From each record it synthesises what WARC needs and ARC lacks:
record ids, ISO timestamps, record types and base-32 SHA-1 digests of payload and block.

WARC files are written by Spark's own text writer (each record is one row, closed by the
record separator), so task retries and the commit of files are Spark's, on any file system.
A file is one gzip stream; its size is that of a shuffle partition, at most ``FILE_RECORDS``.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

# Field names of the ARC header lines by version.
ARC_FIELDS = {
    b"1": ("url", "ip", "date", "mime", "length"),
    b"2": ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    b"1": b"URL IP-address Archive-date Content-type Archive-length",
    b"2": b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CONTAINER_BYTES = 2 << 20
FILE_RECORDS, FILE_BYTES = 20_000, 256 << 20  # records and payload bytes of one WARC file
CRAWLED = "20000101000000"

CONVERTED = "page_id long, url string, ip string, date string, head binary, payload binary, payload_bytes long, payload_digest string, record_id string"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(url: str | None) -> bytes:
    """A url without white space or control bytes, as a header line needs it; ``unknown:`` for none."""
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m.group()[0], (url or "").encode()) or b"unknown:"


def arc_record(version: bytes, url: bytes, mime: bytes, body: bytes, date: str, filename: bytes) -> bytes:
    values = {"url": url, "ip": b"0.0.0.0", "date": date.encode(), "mime": mime, "status": b"200", "checksum": b"-",
              "location": b"-", "offset": b"0", "filename": filename, "length": b"%d" % len(body)}
    return b" ".join(values[f] for f in ARC_FIELDS[version]) + b"\n" + body + b"\n"


def _arc_rows(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def container(records: list[tuple]) -> pa.RecordBatch:
            version = b"12"[number % 2 : number % 2 + 1]
            name = b"pages-%d-%d.arc" % (part, number)
            out = io.BytesIO()
            about = version + b" 0 nestgrain\n" + ARC_TITLES[version] + b"\n"
            out.write(arc_record(b"1", b"filedesc://" + name, b"text/plain", about, date, name))
            for page_id, url, payload in records:
                head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
                if page_id is not None:
                    head.append(b"X-Page-Id: %d" % page_id)
                out.write(arc_record(version, _clean(url), b"text/html", b"\r\n".join([*head, b"", b""]) + payload, date, name))
            return pa.RecordBatch.from_arrays([pa.array([name.decode()]), pa.array([out.getvalue()], pa.binary())], ["name", "content"])

        for batch in batches:
            records, size = [], 0
            for page_id, url, html in zip(*batch.columns):
                payload = (html.as_py() or "").encode()
                if records and size + len(payload) > CONTAINER_BYTES:
                    yield container(records)
                    records, size, number = [], 0, number + 1
                records.append((page_id.as_py(), url.as_py(), payload))
                size += len(payload)
            if records:
                yield container(records)
                number += 1

    return run


def arc_containers(pages: DataFrame, date: str = CRAWLED) -> DataFrame:
    """(name, content): the pages as ARC containers of bounded size, versions 1 and 2 in turn."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_arc_rows(date), "name string, content binary")


# Header lines as found in old archives: the address and the type may hold spaces, so fields are taken by their form,
# the later ones from the right.
_FRONT = rb"(?P<url>.*) (?P<ip>[0-9A-Fa-f.:]+) (?P<date>\d{4,14}) (?P<mime>.*)"
ARC_LINES = {
    b"1": re.compile(_FRONT + rb" (?P<length>\d+)", re.S),
    b"2": re.compile(_FRONT + rb" (?P<status>\d{1,3}|-) (?P<checksum>\S+) (?P<location>.*) (?P<offset>\d+|-) (?P<filename>\S+) (?P<length>\d+)", re.S),
}


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, bytes], bytes]]:
    """(header fields, body) of every record but the leading file description, by declared lengths."""
    at, version = 0, None
    while at < len(content):
        end = content.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header line at byte {at} is not closed")
        found = ARC_LINES[version or b"1"].fullmatch(content[at:end].rstrip(b"\r"))
        if not found:
            raise ValueError(f"ARC header line at byte {at} does not have the fields of its version")
        fields = found.groupdict()
        start, length = end + 1, int(fields["length"])
        if start + length > len(content):
            raise ValueError(f"ARC record at byte {at} declares more bytes than there are")
        body = content[start : start + length]
        if version is None:
            version = body.split(b" ", 1)[0]
            if not fields["url"].startswith(b"filedesc://") or version not in ARC_FIELDS:
                raise ValueError("ARC container does not start with a file description of version 1 or 2")
        else:
            yield fields, body
        at = start + length
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1


def warc_date(date: str) -> str:
    """A WARC time stamp of the digits of an ARC date; what a short one leaves out is the earliest it can be."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def header(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*(.*?)[ \t]*\r?$", head)
    return found.group(1) if found else None


def _converted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            rows = []
            for number, (fields, body) in enumerate(parse_arc(content.as_py())):
                cut = body.find(b"\r\n\r\n") + 4 if body.startswith(b"HTTP/") and b"\r\n\r\n" in body else 0
                head, payload = body[:cut], body[cut:]
                page = header(head, b"X-Page-Id")
                stamp = warc_date(fields["date"].decode())
                record = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}#{number}")
                rows.append((int(page) if page else None, fields["url"].decode("utf-8", "replace"), fields["ip"].decode(), stamp, head, payload,
                             len(payload), base32_sha1(payload), f"<urn:uuid:{record}>"))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["page_id", "url", "ip", "date", "head", "payload", "payload_bytes", "payload_digest", "record_id"])


def convert_arc(containers: DataFrame) -> DataFrame:
    """One row per ARC record with the synthesised WARC fields. Damaged containers raise an error.

    Containers without records, and no containers, give no rows; equal containers of one name
    give records with equal ids; columns beside name and content play no part.
    """
    return containers.select("name", "content").mapInArrow(_converted_rows, CONVERTED)


def write_warc(records: DataFrame, path: str, least_bytes: int = 0) -> None:
    """WARC files of ``convert_arc``'s records: of equal payloads the largest page id is the response, others revisit it.

    Payloads below ``least_bytes`` are all responses. Records without a page id count as
    smallest. Equal records with the winning id are all responses; only ids tell records apart.
    A file holds ``FILE_BYTES`` of payload on average, and at most ``FILE_RECORDS`` records.
    """
    narrow = materialise(records.select("record_id", "page_id", "payload_bytes", "payload_digest"))
    won = narrow.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("best"), F.max_by("record_id", F.coalesce("page_id", F.lit(-(1 << 63)))).alias("best_record"))
    # payloads meet their verdicts by record, never by a digest that many pages share
    verdicts = narrow.join(won, ["payload_digest", "payload_bytes"]).select("record_id", "best", "best_record").distinct()
    both = records.join(verdicts, "record_id", "left")
    mean = narrow.agg(F.avg("payload_bytes")).first()[0] or 0
    per_file = int(min(FILE_RECORDS, max(1, FILE_BYTES // max(mean, 1))))
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    block = F.concat("head", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    sha1 = F.sha1(block)  # hex; WARC wants base 32, five characters of hex are four of base 32
    block_digest = F.concat(*[
        F.translate(F.lpad(F.conv(F.substring(sha1, 1 + 10 * k, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        for k in range(4)])
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), "record_id"), F.concat(F.lit("WARC-Date: "), "date"),
        F.concat(F.lit("WARC-Target-URI: "), "url"), F.concat(F.lit("WARC-IP-Address: "), "ip"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "payload_digest"), F.concat(F.lit("WARC-Block-Digest: sha1:"), block_digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), "best_record")), F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")), F.lit("\r\n"),
    ]
    top = F.concat_ws("\r\n", *lines)
    record = F.concat(top.cast("binary"), block).cast("string")  # a cast keeps the bytes as they are
    (both.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", per_file).text(path))


def parse_warc(chunks: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of every record of a stream of bytes, by declared lengths; a record at a time in memory."""
    room = bytearray()

    def more() -> bool:
        part = next(chunks, None)
        if part is not None:
            room.extend(part)
        return part is not None

    while True:
        while (end := room.find(b"\r\n\r\n")) < 0:
            if not more():
                if room.strip():
                    raise ValueError("WARC stream ends inside a record header")
                return
        head = bytes(room[: end + 2])
        length = header(head, b"Content-Length")
        if not head.startswith(b"WARC/") or length is None:
            raise ValueError("not a WARC record")
        stop = end + 4 + int(length)
        while len(room) < stop + 4 and more():
            pass
        if len(room) < stop:
            raise ValueError("WARC stream ends inside a record block")
        block = bytes(room[end + 4 : stop])
        del room[: stop + 4]
        yield head, block


def _inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of one or several gzip members, in pieces."""
    at = 0
    while at < len(data):
        stream = zlib.decompressobj(31)
        while not stream.eof and at < len(data):
            part = stream.decompress(data[at : at + step])
            at += min(step, len(data) - at)
            if part:
                yield part
        at -= len(stream.unused_data)


def _warc_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for head, block in parse_warc(_inflated(memoryview(content.as_buffer()))):
                kind = header(head, b"WARC-Type").decode()
                cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                page, declared = header(block[:cut], b"X-Page-Id"), header(block[:cut], b"Content-Length")
                refers = header(head, b"WARC-Refers-To")
                digest = header(head, b"WARC-Payload-Digest").decode().removeprefix("sha1:")
                if kind == "response" and base32_sha1(block[cut:]) != digest:
                    raise ValueError(f"payload of page {page} does not have its digest")
                size = len(block) - cut if kind == "response" else int(declared)
                rows.append((int(page) if page else None, size, digest, kind, header(head, b"WARC-Record-ID").decode(), refers.decode() if refers else None))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                    ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_record"])


def read_warc(spark, path: str) -> DataFrame:
    """One row per record of the files under ``path``; digests of responses are checked while reading. No files, no rows."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInArrow(_warc_rows, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_record string")
    return rows
