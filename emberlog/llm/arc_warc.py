"""Legacy archive converter: ARC records to WARC records, written and read as archive files.

An ARC file opens with a version block whose line names the version; version 1 records begin with
``URL IP date type length`` and version 2 records with ``URL IP date type status checksum location
offset file length``.  The declared length says where a record ends.  Files may be gzipped, in one member
or one a record.  Each record becomes a WARC record with a name-based UUID, an ISO timestamp, SHA-1 digests
and a type: the version block a ``warcinfo``, a block with an HTTP head a ``response`` (its payload is what
follows the head), anything else, such as ``dns:``, a ``resource``.  Responses whose payload was seen
elsewhere become ``revisit`` records, which keep the head.

Archives are written by Spark's own file commit protocol: a record's text ends in two line breaks as
the format demands, so the text sink with that separator writes a valid archive on any file system
and survives lost executors.  They are read as a stream of such parts, put together again by declared
lengths, so a task holds a record at a time and never a file.

A null payload is an empty one, payloads of any length are kept whole; a null URL becomes
``about:blank``; blanks and control characters in URLs are percent-encoded.  A null id takes no part as
smallest; of rows equal in id and payload all are responses.  Other columns are not read.  An empty table
writes no record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, materialise, release, remove, shared_path
from .token_count import _balanced

RECORDS_PER_FILE = 1000
#: Bytes of records that are handled together.
ARC_BYTES = 4 << 20
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 0
VERSION = "WARC/1.1"
BREAK = "\r\n\r\n"
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:emberlog:arc")


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    payload: bytes
    status: str = ""
    checksum: str = ""


class ArchiveError(ValueError):
    """A header line or a declared length that doesn't hold."""


def _opened(source: bytes | BinaryIO) -> BinaryIO:
    """A buffered stream of the file, unpacked where it is gzipped."""
    raw = io.BufferedReader(io.BytesIO(source) if isinstance(source, bytes) else source)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def _read(stream: BinaryIO, size: int) -> bytes:
    out = stream.read(size)
    if len(out) < size:
        raise ArchiveError(f"{size} bytes declared, {len(out)} left")
    return out


def parse_arc(source: bytes | BinaryIO, blocks: bool = False) -> Iterator[ArcRecord]:
    """Records of an ARC file of version 1 or 2; with ``blocks`` the version block too, by its own URL."""
    stream, version = _opened(source), 0
    while raw := stream.readline():
        if not raw.strip(b"\r\n"):
            continue
        if not raw.endswith(b"\n"):
            raise ArchiveError(f"no header line: {raw[:80]!r}")
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        fields = line.split(" ")
        if line.startswith("filedesc://"):
            if len(fields) < 5 or not fields[-1].isdigit():
                raise ArchiveError(line)
            block = _read(stream, int(fields[-1]))
            number = block.split(b" ", 1)[0]
            version = int(number) if number.isdigit() else 0
            if version not in (1, 2):
                raise ArchiveError(f"version {version}")
            if blocks:
                yield ArcRecord(*fields[:4], block)
            continue
        if version == 0:
            raise ArchiveError("a record before the version block")
        if len(fields) != (5 if version == 1 else 10) or not fields[-1].isdigit():
            raise ArchiveError(f"version {version} header: {line}")
        payload = _read(stream, int(fields[-1]))
        yield ArcRecord(*fields[:4], payload) if version == 1 else ArcRecord(*fields[:4], payload, fields[4], fields[5])


def version_block(version: int, name: str = "pages.arc", date: str = "19960101000000") -> bytes:
    keys = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}[version]
    body = f"{version} 0 emberlog\n{keys}\n\n".encode()
    if version == 1:
        return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(body)}\n".encode() + body
    return f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(body)}\n".encode() + body


def arc_record(r: ArcRecord, version: int, offset: int = 0, name: str = "pages.arc") -> bytes:
    if version == 1:
        head = f"{r.url} {r.ip} {r.date} {r.mime} {len(r.payload)}\n"
    else:
        head = f"{r.url} {r.ip} {r.date} {r.mime} {r.status or '200'} {r.checksum or '-'} - {offset} {name} {len(r.payload)}\n"
    return head.encode() + r.payload + b"\n"


def clean_url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso_date(date: str) -> str:
    d = (date + "0101000000"[max(0, len(date) - 4) :] if len(date) < 14 else date)[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """(head with its blank line, payload) of an HTTP response; None where the block is none."""
    if not block.startswith(b"HTTP/"):
        return None
    end = re.search(rb"\r?\n\r?\n", block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def warc_record(r: ArcRecord, page: str, refers_to: str | None = None) -> bytes:
    """One WARC record without its closing line breaks.  A revisit carries no payload but its digest."""
    parts = http_parts(r.payload)
    head, payload = parts or (b"", r.payload)
    digest = sha1_base32(payload)
    if r.url.startswith("filedesc://"):
        kind, mime, block = "warcinfo", "application/warc-fields", info_fields(r)
    elif refers_to is not None:
        kind, mime, block = "revisit", "application/http;msgtype=response" if parts else r.mime, head
    elif parts:
        kind, mime, block = "response", "application/http;msgtype=response", r.payload
    else:
        kind, mime, block = "resource", r.mime, r.payload
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{record_id(page, digest)}>", f"WARC-Date: {iso_date(r.date)}"]
    if kind == "warcinfo":
        lines.append(f"WARC-Filename: {r.url.removeprefix('filedesc://')}")
    else:
        lines += [f"WARC-Target-URI: {r.url}", f"WARC-IP-Address: {r.ip}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    lines += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Page: {page}"]
    if kind == "revisit":
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{record_id(refers_to, digest)}>",
            f"X-Refers-To-Page: {refers_to}",
        ]
    lines += [f"Content-Type: {mime}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BREAK.encode() + block


def info_fields(r: ArcRecord) -> bytes:
    """The fields of a warcinfo record: the format, and the lines of the version block."""
    lines = [x for x in r.payload.decode("utf-8", "replace").splitlines() if x]
    fields = ["software: emberlog", "format: WARC File Format 1.1", *(f"arc-version-block: {x}" for x in lines)]
    return "".join(f"{x}\r\n" for x in fields).encode()


def record_id(page: str, digest: str) -> uuid.UUID:
    return uuid.uuid5(NAMESPACE, f"{page}/{digest}")


def parse_warc(parts: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths; the block digest must hold.

    A file comes whole or in parts; no more than a record and a part is held.
    """
    parts = iter([gzip.decompress(parts) if parts[:2] == b"\x1f\x8b" else parts] if isinstance(parts, bytes) else parts)
    end = BREAK.encode()
    held = bytearray()

    def fill(size: int) -> bool:
        while len(held) < size:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        while (len(held) >= 2 or fill(2)) and held[:2] == b"\r\n":
            del held[:2]
        if not held:
            return
        looked = 0
        while (at := held.find(end, looked)) < 0:
            looked = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ArchiveError(f"no record in the last {len(held)} bytes")
        lines = bytes(held[:at]).decode().split("\r\n")
        if lines[0] != VERSION:
            raise ArchiveError(f"no record at {lines[0][:40]!r}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        start, size = at + 4, int(headers["Content-Length"])
        fill(start + size + 4)
        block = bytes(held[start : start + size])
        if held[start + size : start + size + 4] != end:
            raise ArchiveError(f"record of {len(block)} bytes not closed")
        if headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
            raise ArchiveError("block digest")
        del held[: start + size + 4]
        yield headers, block


def http_head(payload: bytes, mime: str = "text/html") -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: {mime}; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()


def _convert(date: str):
    """Pages as ARC files of a few megabytes, of the two versions in turn, parsed and converted."""

    def run(batches):
        version = 1
        for whole in batches:
            for at, size in _balanced(whole.column(2), ARC_BYTES):
                pages, urls, htmls, refers = (c.slice(at, size).to_pylist() for c in whole.columns)
                version = 3 - version
                file = io.BytesIO()
                file.write(version_block(version))
                for url, html in zip(urls, htmls):
                    body = html or b""
                    file.write(arc_record(ArcRecord(clean_url(url), "0.0.0.0", date, "text/html", http_head(body) + body), version, file.tell()))
                file.seek(0)
                out = [
                    warc_record(r, "" if page is None else str(page), None if to is None else str(to))
                    for r, page, to in zip(parse_arc(file), pages, refers)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        release()

    return run


def with_revisits(pages: DataFrame, id_: str = "page_id", payload: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Adds refers_to: of equal payloads, the smallest id for all other rows; null for the first and small ones.

    Payloads are equal when length and SHA-256 are; SHA-1 has known collisions.  Of rows equal in id too,
    all are responses.
    """
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    keyed = pages.withColumn("__d", F.concat_ws(":", F.sha2(body, 256), F.length(body)))
    first = keyed.select("__d", id_).groupBy("__d").agg(F.min(id_).alias("__first"), F.count("*").alias("__n"))
    found = lookup(keyed, materialise(first), "__d", "__n", F.coalesce(F.col(id_), F.lit(0)))
    other = (F.length(body) >= least) & ~F.col(id_).eqNullSafe(F.col("__first")) & (F.col("__n") > 1)
    return found.withColumn("refers_to", F.when(other, F.col("__first"))).drop("__d", "__first", "__n")


def write_warc(pages: DataFrame, path: str, *, id_: str = "page_id", url: str = "url", payload: str = "html", date: str = "19960101000000", least: int = LEAST_REVISIT) -> None:
    """Each page as a legacy record, converted, in gzipped WARC files under ``path``."""
    narrow = pages.select(F.col(id_).alias("id"), F.col(url).alias("url"), F.col(payload).cast("binary").alias("payload"))
    found = with_revisits(narrow, "id", "payload", least).select("id", "url", "payload", "refers_to")
    _write(found.mapInArrow(_convert(date), "value binary"), path)


def _write(records: DataFrame, path: str) -> None:
    text = records.select(F.col("value").cast("string"))
    text.write.option("lineSep", BREAK).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).mode("overwrite").text(path)


def convert_arc(arcs: DataFrame, path: str, content: str = "content", name: str = "path") -> None:
    """ARC files (as ``binaryFile`` reads them, gzipped or not) to WARC files under ``path``.

    The file source hands over a file of at most 2 GB; it is unpacked and converted record by record.
    """

    def run(batches):
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                out, weight = [], 0
                for i, r in enumerate(parse_arc(data or b"", blocks=True)):
                    out.append(warc_record(r, f"{file}#{i}"))
                    weight += len(out[-1])
                    if weight > ARC_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, weight = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
        release()

    _write(arcs.select(name, content).mapInArrow(run, "value binary"), path)


READ = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, mime string, payload binary"
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    parts = http_parts(block) if headers["Content-Type"].startswith("application/http") else None
    payload = parts[1] if parts else block
    digest = headers.get("WARC-Payload-Digest", "sha1:" + sha1_base32(payload)).removeprefix("sha1:")
    size = int(headers.get("X-Payload-Length", len(payload)))
    if headers["WARC-Type"] in ("response", "resource") and (digest != sha1_base32(payload) or size != len(payload)):
        raise ArchiveError("payload digest")
    return (headers["X-Page"], size, digest, headers["WARC-Type"], headers.get("X-Refers-To-Page"), headers.get("WARC-Target-URI"), headers["Content-Type"], payload if payloads else None)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the gzipped archives under ``path``.

    A gzipped file isn't split, so its parts come to one task in order.
    """

    def run(batches):
        parts = (part + BREAK.encode() for b in batches for part in b.column(0).to_pylist())
        rows, weight = [], 0
        for headers, block in parse_warc(parts):
            rows.append(_row(headers, block, payloads))
            weight += 200 + len(rows[-1][-1] or b"")
            if weight > ARC_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=[c.split()[0] for c in READ.split(", ")])
                rows, weight = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=[c.split()[0] for c in READ.split(", ")])
        release()

    text = spark.read.option("lineSep", BREAK).option("pathGlobFilter", "*.gz").text(path)
    return text.select(F.col("value").cast("binary")).mapInArrow(run, READ)


def archive_report(pages: DataFrame) -> DataFrame:
    """Writes all pages as archives in the shared folder and returns what reading them back gives.

    The archives go once they have been read; what is returned is a few numbers a page.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_warc(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    page = F.when(F.col("page") != "", F.col("page")).cast(kind).alias("page_id")
    back = read_warc(spark, path, payloads=False)
    out = materialise(back.select(page, "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
    remove(spark, path)
    return out
