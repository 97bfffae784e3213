"""The binary log format: records, chunks of a connection, and a Spark data source for both.

Record, little endian: 3 bytes length and a magic byte, 8 bytes nanoseconds, 1 byte level, fields, and
at the end the span.  Fields are read from the end, so they come back in reverse order of writing.
A field is key text, key tag, value bytes, value tag.  Key tags below 128 are numbers of well-known keys,
others 128 plus the length of the text.  Value tags of 128 and more are short strings.

Text and bytes hold at most 65,535 bytes in this format: longer ones are cut there when written, text
before the character that would not fit.  A record that does not decode is left out when files are read;
``rejected`` counts such records by file.  Paths may be URIs of any file system that Arrow opens.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from emberlog.functions.model import CURRENT, END, LOGS, START, START_WITH_PARENT, Duration, Span, Stamp, record, value

MAGIC = 0xE1
CHUNK_MAGIC, SERVICE_MAGIC = 0x8910FC0E, 0xF745119E
MAX_ENTRY = 4 << 20
MAX_TEXT = 0xFFFF
#: Writers begin a new file beyond this.
FILE_BYTES = 16 << 20
KNOWN_KEYS = tuple(
    "msg err error cause method status size time count total ms id user_id object_id caller target duration timezone content_type conn_id path"
    " length on kind sensor_id handler timestamp elapsed camera_id system_id next".split()
)
_NUMBER_OF = {k: i for i, k in enumerate(KNOWN_KEYS)}
STRING, BYTES, I32, U32, I64, U64, F32, F64, UUID, TRUE, FALSE, NONE, SECONDS, TIMESTAMP = range(0x10, 0x1E)
_FIXED = {I32: "<i", U32: "<I", I64: "<q", U64: "<Q", F32: "<f", F64: "<d"}


class FormatError(ValueError):
    """Bytes that are no record or chunk."""


@dataclass(frozen=True)
class Typed:
    """A number with the width it is written in, for writers that care."""

    tag: int
    number: float


def encode_value(x: Any) -> bytes:
    if x is None:
        return bytes([NONE])
    if isinstance(x, bool):
        return bytes([TRUE if x else FALSE])
    if isinstance(x, Typed):
        return struct.pack(_FIXED[x.tag], x.number) + bytes([x.tag])
    if isinstance(x, int):
        tag = I64 if -(2**63) <= x < 2**63 else U64
        return struct.pack(_FIXED[tag], x) + bytes([tag])
    if isinstance(x, float):
        return struct.pack("<d", x) + bytes([F64])
    if isinstance(x, str):
        raw = x.encode()
        if len(raw) > MAX_TEXT:
            raw = raw[:MAX_TEXT].decode("utf-8", "ignore").encode()
        return raw + (bytes([0x80 | len(raw)]) if len(raw) < 128 else struct.pack("<H", len(raw)) + bytes([STRING]))
    if isinstance(x, bytes):
        raw = x[:MAX_TEXT]
        return raw + struct.pack("<H", len(raw)) + bytes([BYTES])
    if isinstance(x, uuid.UUID):
        return x.bytes + bytes([UUID])
    if isinstance(x, Duration):
        return struct.pack("<f", x.seconds) + bytes([SECONDS])
    if isinstance(x, Stamp):
        return struct.pack("<qI", x.millis // 1000, x.millis % 1000 * 10**6) + bytes([TIMESTAMP])
    raise TypeError(f"no log value: {type(x).__name__}")


def encode_key(key: str) -> bytes:
    if key in _NUMBER_OF:
        return bytes([_NUMBER_OF[key]])
    raw = key.encode()
    if len(raw) > 127:
        raise FormatError("keys have at most 127 bytes")
    return raw + bytes([0x80 | len(raw)])


def encode_record(ts_ns: int, level: int, fields: list[tuple[str, Any]], span: Span | None = None) -> bytes:
    body = struct.pack("<QB", ts_ns, level) + b"".join(encode_key(k) + encode_value(v) for k, v in fields)
    if span is not None:
        kind = START_WITH_PARENT if span.kind == START and span.parent is not None else span.kind
        if kind == START_WITH_PARENT:
            body += struct.pack("<Q", span.parent)
        body += struct.pack("<Q", span.id) + bytes([0x40 | kind])
    if len(body) >= 1 << 24:
        raise FormatError("record too long")
    return struct.pack("<I", MAGIC << 24 | len(body)) + body


def record_length(data: bytes, at: int = 0) -> int | None:
    """Bytes of the record that begins there, with its header; None if none does."""
    if len(data) - at < 4:
        return None
    (header,) = struct.unpack_from("<I", data, at)
    return 4 + (header & 0xFFFFFF) if header >> 24 == MAGIC else None


class _Tail:
    """Pops from the end of a slice."""

    def __init__(self, data: bytes) -> None:
        self.data, self.end = data, len(data)

    def take(self, n: int) -> bytes:
        if n > self.end:
            raise FormatError("record ends inside a value")
        self.end -= n
        return self.data[self.end : self.end + n]

    def number(self, form: str):
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def span(self) -> Span | None:
        if not self.end or self.data[self.end - 1] & 0xC0 != 0x40:
            return None
        kind = self.take(1)[0] & 3
        id_ = self.number("<Q")
        parent = self.number("<Q") if kind == START_WITH_PARENT else None
        if id_ == 0 or parent == 0:
            raise FormatError("span id zero")
        return Span(id_, parent, kind)

    def value(self) -> Any:
        tag = self.take(1)[0]
        if tag & 0x80:
            return self.take(tag & 0x7F).decode("utf-8", "replace")
        if tag in (STRING, BYTES):
            raw = self.take(self.number("<H"))
            return raw if tag == BYTES else raw.decode("utf-8", "replace")
        if tag in _FIXED:
            return self.number(_FIXED[tag])
        if tag == UUID:
            return uuid.UUID(bytes=self.take(16))
        if tag in (TRUE, FALSE):
            return tag == TRUE
        if tag == NONE:
            return None
        if tag == SECONDS:
            return Duration(self.number("<f"))
        if tag == TIMESTAMP:
            nanos = self.number("<I")
            return Stamp(max(0, self.number("<q") * 1000 + nanos // 10**6))
        raise FormatError(f"value tag {tag:#x}")

    def key(self) -> str:
        tag = self.take(1)[0]
        if tag >= 0x80:
            return self.take(tag & 0x7F).decode("utf-8", "replace")
        if tag >= len(KNOWN_KEYS):
            raise FormatError(f"key tag {tag:#x}")
        return KNOWN_KEYS[tag]

    def fields(self) -> Iterator[tuple[str, Any]]:
        while self.end:
            x = self.value()
            yield self.key(), x


def decode_record(data: bytes, at: int = 0) -> tuple[int, int, Span | None, list[tuple[str, Any]], int]:
    """(ts_ns, level, span, fields in reverse order of writing, offset after the record)."""
    size = record_length(data, at)
    if size is None:
        raise FormatError(f"no record at byte {at}")
    if size < 13 or at + size > len(data):
        raise FormatError("record ends early")
    ts_ns, level = struct.unpack_from("<QB", data, at + 4)
    if level > 3:
        raise FormatError(f"level {level}")
    tail = _Tail(data[at + 13 : at + size])
    return ts_ns, level, tail.span(), list(tail.fields()), at + size


def decode(data: bytes) -> Iterator[tuple[int, int, Span | None, list[tuple[str, Any]]]]:
    at = 0
    while at < len(data):
        *out, at = decode_record(data, at)
        yield tuple(out)


def chunk(entries: bytes) -> bytes:
    return struct.pack("<Q", CHUNK_MAGIC << 32 | len(entries)) + entries


def service_chunk(name: str) -> bytes:
    raw = name.encode()
    return struct.pack("<Q", SERVICE_MAGIC << 32 | len(raw)) + raw


class Dechunker:
    """Bytes of a connection, in any portions, to ("service", name) and ("record", bytes) events.

    A wrong magic, an entry larger than allowed or than its chunk ends the connection: ``FormatError``.
    """

    def __init__(self, max_entry: int = MAX_ENTRY) -> None:
        self.held, self.left, self.max_entry = bytearray(), 0, max_entry

    def feed(self, data: bytes) -> Iterator[tuple[str, Any]]:
        self.held += data
        at = 0
        try:
            while True:
                if not self.left:
                    if len(self.held) - at < 8:
                        return
                    (header,) = struct.unpack_from("<Q", self.held, at)
                    magic, size = header >> 32, header & 0xFFFFFFFF
                    if magic == SERVICE_MAGIC:
                        if len(self.held) - at < 8 + size:
                            return
                        yield "service", bytes(self.held[at + 8 : at + 8 + size]).decode("utf-8", "replace")
                        at += 8 + size
                    elif magic == CHUNK_MAGIC:
                        self.left = size
                        at += 8
                    else:
                        raise FormatError("chunk magic")
                    continue
                if len(self.held) - at < 4:
                    return
                size = record_length(self.held, at)
                if size is None:
                    raise FormatError("entry magic")
                if size > self.max_entry:
                    raise FormatError(f"entry of {size} bytes")
                if size > self.left:
                    raise FormatError("entry exceeds its chunk")
                if len(self.held) - at < size:
                    return
                yield "record", bytes(self.held[at : at + size])
                self.left -= size
                at += size
        finally:
            del self.held[:at]

    @property
    def partial(self) -> bool:
        return bool(self.held or self.left)


#: Field names that are also parameters of ``record``.
_TAKEN = ("seq", "ts_ns", "level", "span", "service", "generation")


def to_row(seq: int, raw: bytes, service: str | None, generation: int = 0) -> tuple:
    ts_ns, level, span, fields, _ = decode_record(raw)
    named = dict(reversed(fields))  # fields come newest first, and later writes win
    row = record(seq, ts_ns, level, span=span, service=service, generation=generation, **{k: v for k, v in named.items() if k not in _TAKEN})
    row["fields"] |= {k: value(named[k]) for k in _TAKEN if k in named}
    return tuple(row[f.name] for f in LOGS)


def records_of(data: bytes, service: str | None = None) -> Iterator[tuple[str | None, bytes]]:
    """(service, record) of a file of plain records or of chunks."""
    if record_length(data) is None and data:
        for kind, x in Dechunker().feed(data):
            if kind == "service":
                service = x
            else:
                yield service, x
        return
    at = 0
    while at < len(data):
        size = record_length(data, at)
        if size is None or at + size > len(data):
            raise FormatError(f"no record at byte {at}")
        yield service, data[at : at + size]
        at += size


def rows_of(data: bytes, service: str | None = None, start: int = 0, generation: int = 0) -> Iterator[tuple]:
    """Rows of a file of plain records or of chunks; records that do not decode are left out."""
    seq = start
    for named, x in records_of(data, service):
        try:
            yield to_row(seq, x, named, generation)
        except FormatError:
            continue
        seq += 1


def read_files(spark: SparkSession, path: str, service: str | None = None) -> DataFrame:
    """Log files as rows of ``LOGS``; the file's place in name order is the generation.

    A file is read by one task; writers rotate files at 16 MiB.
    """
    register(spark)
    return spark.read.format("emberlog").option("service", service or "").load(path)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, rejected) of log files: how many records there are and how many do not decode."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def count(batches):
        from emberlog.sources.record_columns import counts

        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                total, bad = counts(records_of(data))
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total]), pa.array([bad])], names=["file", "records", "rejected"])

    return files.mapInArrow(count, "file string, records long, rejected long")


@dataclass
class _File(InputPartition):
    path: str
    generation: int


def _opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _listing(path: str) -> list[str]:
    """Files under a path, as the file system names them, in name order; hidden ones are left out."""
    from pyarrow import fs

    system, inner = _opened(path)
    found = system.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        return []
    files = [found] if found.is_file else [f for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
    return sorted(f.path for f in files if not f.base_name.startswith((".", "_")))


def _content(path: str, file: str) -> bytes:
    with _opened(path)[0].open_input_stream(file) as f:
        return f.read()


def _batches(path: str, service: str | None, file: _File) -> Iterator[pa.RecordBatch]:
    from emberlog.sources.record_columns import batches

    return batches(records_of(_content(path, file.path), service), file.generation)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.service = options["path"], options.get("service") or None

    def partitions(self):
        return [_File(p, i) for i, p in enumerate(_listing(self.path))] or [_File("", 0)]

    def read(self, partition):
        if partition.path:
            yield from _batches(self.path, self.service, partition)


def number_of(file: str) -> int:
    """A landed file's generation: the last number in its name, or a checksum where there is none."""
    import re
    import zlib

    name = file.rsplit("/", 1)[-1]
    found = re.findall(r"\d+", name)
    return int(found[-1]) % 2**31 if found else zlib.crc32(name.encode()) % 2**31


class _StreamReader(DataSourceStreamReader):
    """Files of a landing directory, one a task.

    The offset holds the names of the files present, so a file counts as new by its name alone, wherever
    it sorts; names of files that have been removed leave it.
    """

    def __init__(self, options: dict) -> None:
        self.path, self.service = options["path"], options.get("service") or None

    def initialOffset(self):
        return {"files": []}

    def latestOffset(self):
        return {"files": _listing(self.path)}

    def partitions(self, start, end):
        known = set(start["files"])
        return [_File(p, number_of(p)) for p in end["files"] if p not in known]

    def read(self, partition):
        yield from _batches(self.path, self.service, partition)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Record files of one task, a new one beyond ``FILE_BYTES``, under hidden names until all tasks are done.

    The number in a file's name is its task's and its own within the task.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator):
        from pyspark import TaskContext

        from emberlog.sources.record_columns import encode_batch

        context = TaskContext.get()
        system, inner = _opened(self.path)
        system.create_dir(inner, recursive=True)
        files, out, room = [], None, 0
        try:
            for batch in iterator:
                data, sizes = encode_batch(batch)
                ends, begin, at = sizes.cumsum(), 0, 0
                while at < len(ends):
                    if room <= 0:
                        if out is not None:
                            out.close()
                        stem = f"part-{context.partitionId():05d}{len(files):05d}"
                        files.append((f"{inner}/.{stem}-{context.taskAttemptId()}.tmp", f"{inner}/{stem}"))
                        out, room = system.open_output_stream(files[-1][0]), FILE_BYTES
                    # up to the record that fills the file
                    at = min(len(ends), int(ends.searchsorted(begin + room)) + 1)
                    out.write(data[begin : ends[at - 1]].tobytes())
                    room -= int(ends[at - 1]) - begin
                    begin = int(ends[at - 1])
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        import uuid as uuid_

        system, _ = _opened(self.path)
        made = [f for m in messages if m for f in m.files]
        if self.overwrite:
            written = {hidden for hidden, _ in made}
            for p in _listing(self.path):
                if p not in written:
                    system.delete_file(p)
        tag = "" if self.overwrite else f"-{uuid_.uuid4().hex[:12]}"
        for hidden, final in made:
            system.move(hidden, f"{final}{tag}.log")

    def abort(self, messages) -> None:
        system, _ = _opened(self.path)
        for m in messages:
            for hidden, _ in m.files if m else ():
                system.delete_file(hidden)


class LogSource(DataSource):
    """``spark.read.format("emberlog")`` and ``spark.readStream.format("emberlog")``."""

    @classmethod
    def name(cls) -> str:
        return "emberlog"

    def schema(self):
        return LOGS

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LogSource)


def write_files(df: DataFrame, path: str) -> None:
    """Rows of ``LOGS`` as record files of 16 MiB per partition, in arrival order within each."""
    register(df.sparkSession)
    df.sortWithinPartitions("generation", "seq").write.format("emberlog").mode("overwrite").save(path)


def from_row(r) -> bytes:
    fields: list[tuple[str, Any]] = []
    if r["target"]:
        fields.append(("target", r["target"]))
    for k, v in r["fields"].items():
        fields.append((k, plain(v)))
    if r["message"]:
        fields.append(("msg", r["message"]))
    span = None
    if r["span_id"] is not None:
        up = r["parent_span_id"]
        kind = CURRENT if r["span_kind"] is None else r["span_kind"]
        span = Span(r["span_id"] % 2**64, None if up is None else up % 2**64, START if kind == START_WITH_PARENT else kind)
        if kind == END:
            span = Span(span.id, None, END)
    return encode_record(r["ts_ns"], r["level"], fields, span)


def plain(v) -> Any:
    """The Python value of a tagged struct."""
    kind = v["kind"]
    return (
        None, v["s"], v["b"], None if v["i"] is None else int(v["i"]), v["f"], bool(v["i"]), None if kind != 6 else uuid.UUID(v["s"]),
        None if kind != 7 else Duration(v["f"]), None if kind != 8 else Stamp(int(v["i"])),
    )[kind]
