"""Exact dedup by Grace hashing.

The shuffle is the first partitioning of the records.  Before it every task folds its own copies of
a text into one record, so a text that holds a third of all rows reaches its bucket once per map
task and not once per row.  In a bucket, records go into an open-addressing table that compares the
complete content.  When the distinct contents outgrow the memory allowed, table and rest are
partitioned by the next hash to spill files, and each of those is handled the same way.

Spill files are scratch of the running task, in the directories Spark's own block manager gives its
Python workers (``SPARK_LOCAL_DIRS``).  No other task reads them, so a lost executor only repeats
its own tasks.

Equality: contents after lower-casing A-Z only; null counts as empty.  Of equal texts the row with
the largest id stays; a null id is smaller than any other; of rows equal in text and id one stays.
An empty table gives an empty result; other columns are carried through untouched.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, lookup, materialise, release

FANOUT = 16
NO_ID = -(2**63)

#: text, count, best id, payload
Record = tuple[bytes, int, int, bytes | None]


def normalise(raw: bytes) -> bytes:
    """Lower-case A-Z and nothing else."""
    return raw.lower()


class ContentTable:
    """Open addressing with linear probing from complete content to (count, best id, payload).

    With ``raw`` the entry keeps the winning row's text as it stands and compares it normalised, so a
    row's text is held once.
    """

    def __init__(self, raw: bool = False) -> None:
        self.raw = raw
        self.mask = 1023
        self.slots = [-1] * (self.mask + 1)
        self.hashes: list[int] = []
        self.keys: list[bytes] = []
        self.counts: list[int] = []
        self.ids: list[int] = []
        self.payloads: list[bytes | None] = []
        self.bytes = 0

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, key: bytes, hashed: int, count: int, best: int, payload: bytes | None, content: bytes) -> None:
        """``key`` is kept, ``content`` (the normalised key) is compared."""
        slots, mask = self.slots, self.mask
        at = hashed & mask
        while (entry := slots[at]) >= 0:
            if self.hashes[entry] == hashed:
                held = self.keys[entry]
                if (normalise(held) if self.raw else held) == content:
                    self.counts[entry] += count
                    if best > self.ids[entry]:
                        self.bytes += len(key) - len(held) + len(payload or b"") - len(self.payloads[entry] or b"")
                        self.ids[entry], self.keys[entry], self.payloads[entry] = best, key, payload
                    return
            at = (at + 1) & mask
        slots[at] = len(self.keys)
        self.hashes.append(hashed)
        self.keys.append(key)
        self.counts.append(count)
        self.ids.append(best)
        self.payloads.append(payload)
        self.bytes += len(key) + len(payload or b"") + 250
        if len(self.keys) * 2 > mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = self.mask * 4 + 3
        self.slots = slots = [-1] * (self.mask + 1)
        for entry, hashed in enumerate(self.hashes):
            at = hashed & self.mask
            while slots[at] >= 0:
                at = (at + 1) & self.mask
            slots[at] = entry

    def items(self) -> Iterator[Record]:
        return zip(self.keys, self.counts, self.ids, self.payloads)


def _scratch(level: int) -> str | None:
    """A local directory of Spark's; tasks and levels take turns among them."""
    found = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return found[(os.getpid() + level) % len(found)] if found else None


def grace(records: Iterator[Record], memory: int, raw: bool = False, level: int = 0) -> Iterator[Record]:
    """Fold (text, count, id, payload) records by complete content within ``memory`` bytes of table.

    Texts are contents, or with ``raw`` texts to be normalised.
    """
    table = ContentTable(raw)
    # bits that earlier levels partitioned by are equal within a bucket: each level hashes anew
    for key, count, best, payload in records:
        content = normalise(key) if raw else key
        table.add(key, xxhash.xxh3_64_intdigest(content, seed=level), count, best, payload, content)
        if table.bytes > memory and len(table) > 1:
            break
    else:
        yield from table.items()
        return
    with tempfile.TemporaryDirectory(prefix="grace-", dir=_scratch(level)) as folder:
        paths = [os.path.join(folder, str(i)) for i in range(FANOUT)]
        files = [open(p, "wb") for p in paths]
        try:
            for source in (table.items(), records):
                for record in source:
                    at = xxhash.xxh3_64_intdigest(normalise(record[0]) if raw else record[0], seed=level + 101) % FANOUT
                    pickle.dump(record, files[at], protocol=5)
                table = None
        finally:
            for f in files:
                f.close()
        for path in paths:
            yield from grace(_unspill(path), memory, raw, level + 1)
            os.unlink(path)


def _unspill(path: str) -> Iterator[Record]:
    with open(path, "rb") as f:
        while True:
            try:
                yield pickle.load(f)
            except EOFError:
                return


def _records(batches, text: str, id_: str, others: list[str] | None) -> Iterator[Record]:
    """Of each row its text, normalised unless ``others`` names the columns of its payload."""
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index(id_)).to_pylist()
        raws = byte_values(batch.column(batch.schema.get_field_index(text)))
        if others is None:
            yield from ((normalise(raw), 1, NO_ID if i is None else i, None) for raw, i in zip(raws, ids))
            continue
        known = batch.column(batch.schema.get_field_index(text)).is_valid().to_pylist()
        rest = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in others]
        for raw, i, *row in zip(raws, ids, known, *rest):
            yield raw, 1, NO_ID if i is None else i, pickle.dumps(row, protocol=5)


FOLDED = "digest binary, n long, best long, content binary, payload binary"
FOLDED_ARROW = pa.schema(
    [("digest", pa.binary()), ("n", pa.int64()), ("best", pa.int64()), ("content", pa.binary()), ("payload", pa.binary())]
)


def _emit(rows, size: int = 8 << 20):
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row[3] or b"") + len(row[4] or b"") + 64
        if weight > size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), FOLDED_ARROW)], schema=FOLDED_ARROW)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), FOLDED_ARROW)], schema=FOLDED_ARROW)


def _fold_local(text: str, id_: str, others: list[str] | None, memory: int):
    raw = others is not None

    def packed(table):
        for key, n, best, payload in table.items():
            yield hashlib.sha256(normalise(key) if raw else key).digest(), n, best, key, payload

    def rows(batches):
        table = ContentTable(raw)
        for key, n, best, payload in _records(batches, text, id_, others):
            content = normalise(key) if raw else key
            table.add(key, xxhash.xxh3_64_intdigest(content), n, best, payload, content)
            if table.bytes > memory:
                yield from packed(table)
                table = ContentTable(raw)
        yield from packed(table)
        del table
        release()

    return lambda batches: _emit(rows(batches))


def _fold_bucket(raw: bool, memory: int):
    def rows(batches):
        stream = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in (3, 1, 2, 4))))
        for key, n, best, payload in grace(stream, memory, raw):
            yield hashlib.sha256(normalise(key) if raw else key).digest(), n, best, key if raw else None, payload
        release()

    return lambda batches: _emit(rows(batches))


def distinct_contents(
    docs: DataFrame, text: str = "text", id_: str = "doc_id", *, payload: bool = False, memory: int = 64 << 20
) -> DataFrame:
    """One row per distinct content: digest, n (rows), best (largest id); with ``payload`` also the winning
    row's text (as ``content``) and its other columns.

    Two contents may not share a digest; the caller joins by digest, and this is where complete
    contents were compared, so a shared digest would show as two rows of one digest.
    """
    others = [c for c in docs.columns if c != text] if payload else None
    narrow = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([text, id_, *(others or [])])])
    folded = narrow.mapInArrow(_fold_local(text, id_, others, memory // 4), FOLDED)
    return folded.repartition("digest").mapInArrow(_fold_bucket(payload, memory), FOLDED)


def _digests(text: str, extra: list[str]):
    def run(batches):
        for b in batches:
            t = b.schema.get_field_index(text)
            shas = pa.array([hashlib.sha256(normalise(x)).digest() for x in byte_values(b.column(t))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in extra], shas], names=[*extra, "digest"])

    return run


def report(docs: DataFrame, text: str = "text", id_: str = "doc_id", memory: int = 64 << 20) -> DataFrame:
    """Per document: id, keep_id, group_size, kept, text_sha256.  Of equal rows with equal ids all show kept."""
    groups = distinct_contents(docs, text, id_, memory=memory).select(
        "digest", F.col("n").alias("group_size"), F.when(F.col("best") != NO_ID, F.col("best")).alias("keep_id")
    )
    groups = materialise(groups)  # some fifty bytes a content, read three times
    kind = docs.schema[id_].dataType.simpleString()
    each = docs.select(F.col(text).alias("text"), F.col(id_).alias("id")).mapInArrow(_digests("text", ["id"]), f"id {kind}, digest binary")
    found = lookup(each, groups, "digest", "group_size", F.col("id"))
    return found.select(
        F.col("id").alias(id_),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("id").isNull() & F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _unpack(arrow_schema: pa.Schema, text: str):
    others = [f for f in arrow_schema if f.name != text]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = [pickle.loads(x) for x in b.column(b.schema.get_field_index("payload")).to_pylist()]
            known, *rest = zip(*rows)
            held = {f.name: pa.array(c, f.type) for f, c in zip(others, rest)}
            whole = b.column(b.schema.get_field_index("content")).cast(arrow_schema.field(text).type)
            held[text] = pc.if_else(pa.array(known), whole, pa.scalar(None, whole.type))
            yield pa.RecordBatch.from_arrays([held[f.name] for f in arrow_schema], schema=arrow_schema)

    return run


def dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", memory: int = 64 << 20) -> DataFrame:
    """The documents without exact copies: whole rows travel with their content, in one shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kept = distinct_contents(docs, text, id_, payload=True, memory=memory)
    return kept.select("content", "payload").mapInArrow(_unpack(to_arrow_schema(docs.schema), text), docs.schema)
