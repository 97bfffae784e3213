"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at safe boundaries and only the pieces are encoded.  For a tokenizer that drops white
space (its pre-tokenizer never matches across it and its normaliser composes nothing over it), every
run of white space is such a boundary, so a text of any length is counted piece by piece.  Pieces of
a batch that were not met before are encoded together, in slices balanced by bytes; counts of pieces
seen lately are kept in a bounded memo.  For other tokenizers whole texts are encoded, in slices
balanced by bytes.

Null and empty texts have no bytes and no tokens; special strings inside a text are recognised as the
library does by default.  A text without white space is one piece and encoded whole, however long.  Ids
may be null or repeat, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handed to the library at once.
SLICE_BYTES = 1 << 18
#: Pieces in each of the two generations of the memo.
MEMO = 200_000

_SPACE = regex.compile(r"\p{White_Space}+")
_ODD = regex.compile(r"[\x1c-\x1f]")


class Memo(dict):
    """Two generations: what the old one knows moves to the young one on use; bounded at 2 x size."""

    def __init__(self, size: int = MEMO) -> None:
        super().__init__()
        self.size, self.old = size, {}

    def missing(self, keys: set) -> list:
        """Keys that neither generation has; those of the old one become young again."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        unknown = []
        for k in keys:
            if k not in self:
                if (v := self.old.get(k)) is not None:
                    self[k] = v
                else:
                    unknown.append(k)
        return unknown


def slices(texts: list[str], most: int = SLICE_BYTES) -> Iterator[list[str]]:
    """Consecutive slices of about equal weight in bytes; one long text is a slice of its own."""
    held, weight = [], 0
    for t in texts:
        size = len(t.encode()) + 8
        if held and weight + size > most:
            yield held
            held, weight = [], 0
        held.append(t)
        weight += size
    if held:
        yield held


def pieces(text: str) -> list[str]:
    """The runs between white space, by the Unicode property."""
    # str.split() also cuts at U+001C to U+001F, which are no white space to the tokenizer
    return text.split() if not _ODD.search(text) else [p for p in _SPACE.split(text) if p]


_encoders: dict[str, tuple[Callable[[list[str]], list[int]], bool]] = {}


def encoder(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(function from texts to lengths, whether white space is a safe boundary) for a vocabulary file."""
    if path not in _encoders:
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)], False)
        else:
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _encoders[path] = (
                lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)],
                _drops_space(json.load(open(path, encoding="utf-8"))),
            )
    return _encoders[path]


def _drops_space(spec: dict) -> bool:
    """Whether the tokenizer removes white space: an inverted split that matches no white space.

    Normalisers that act inside a piece only, and added tokens without white space around or inside.
    """
    pre = spec.get("pre_tokenizer") or {}
    parts = pre.get("pretokenizers", [pre])
    norm = spec.get("normalizer") or {}
    norms = norm.get("normalizers", [norm] if norm else [])
    split = parts[0] if parts else {}
    return (
        split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert") is True
        and r"\s" not in str(split["pattern"].get("Regex", r"\s")).replace(r"[^\s", "[^")
        and all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") for p in parts[1:])
        and all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"].get("Regex") == r"\s+" for n in norms)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in spec["added_tokens"])
    )


def lengths(texts: list[str], path: str, memo: Memo) -> list[int]:
    """Tokens of each text."""
    encode, splits = encoder(path)
    if not splits:
        return [n for part in slices(texts) for n in encode(part)]
    cut = [pieces(t) for t in texts]
    for part in slices(memo.missing(set().union(*cut))):
        memo.update(zip(part, encode(part)))
    get = memo.__getitem__
    return [sum(map(get, c)) for c in cut]


def _count(text: str, extra: list[str], path: str):
    def run(batches):
        memo = Memo()
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            for at, size in _balanced(column):
                part = column.slice(at, size)
                texts = ["" if t is None else t for t in part.to_pylist()]
                n_bytes = [len(x) if x else 0 for x in part.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(b.schema.get_field_index(c)).slice(at, size) for c in extra], pa.array(n_bytes, pa.int64()), pa.array(lengths(texts, path, memo), pa.int64())],
                    names=[*extra, "n_bytes", "n_tokens"],
                )

    return run


def _balanced(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of an Arrow column balanced by bytes."""
    start = weight = 0
    for i, x in enumerate(column.cast(pa.binary())):
        weight += 64 + (len(x.as_buffer()) if x.is_valid else 0)
        if weight > most:
            yield start, i + 1 - start
            start, weight = i + 1, 0
    if start < len(column) or not len(column):
        yield start, len(column) - start


def count_tokens(docs: DataFrame, path: str, text: str = "text", id_: str = "doc_id", limit: int = 2048) -> DataFrame:
    """Per document: id, n_bytes, n_tokens, over_limit."""
    kind = docs.schema[id_].dataType.simpleString()
    counted = docs.select(id_, text).mapInArrow(_count(text, [id_], path), f"`{id_}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
