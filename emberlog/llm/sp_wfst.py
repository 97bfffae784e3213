"""SentencePiece encoding and decoding by a weighted finite-state transducer.

``Transducer`` compiles a model into arcs between integer states, in arrays that are looked up many at
a time:

* the normaliser maps code points to classes; a blank and U+2581 are one class, and the first arc of a
  text writes the dummy prefix;
* the pieces are a prefix automaton over classes, ``Table`` its arcs, with the piece that each state ends;
* byte fallback is an arc for every character that no piece covers, which writes its UTF-8 bytes' pieces.

Words of many texts are composed with it at once: a node for each position, an arc for each piece that
fits.  The tropical shortest path (weights add along a path, the least total wins) is the encoding.

Weights.  In a unigram model an arc weighs minus the piece's score.  A merge (BPE) model is no sum of
scores, so there the state also holds the last piece: after a, an arc of b weighs nothing when merging
their joint text gives exactly (a, b), and infinity otherwise.  A sequence is the merge result of a
text exactly when each neighbouring pair is so, because a merge over a boundary depends on the two
pieces beside it alone.  So each position has one finite state, the last piece of its prefix's result.
Whether a merge runs over a boundary is read from the compiled merges by undoing, again and again,
the later of the two pieces beside it.

Words are cut where no arc can reach over: before U+2581, when no piece has one inside, and between
two characters that no piece holds side by side.  The encodings of words seen lately are kept in a
bounded memo that ends with the task.

Null is an empty text; an empty text has no pieces.  Texts of any length are encoded whole, in memory
proportional to the longest.  Equal rows give equal ids, an empty table gives an empty result, and
columns outside ``keep`` are not read; a kept column named like a result column is refused.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release
from .token_count import Memo, _balanced, slices

SPACE = "▁"
INF = float("inf")
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words in each generation of a task's memo, bytes of text taken at once, and characters composed at once.
MEMO, SLICE, COMPOSED = 100_000, 2 << 20, 1 << 18


def _fields(data: bytes):
    """(number, value) of a protocol-buffer message; sub-messages and strings as bytes."""
    at, n = 0, len(data)

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 1:
            yield tag >> 3, data[at : at + 8]
            at += 8
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield tag >> 3, data[at : at + 4]
            at += 4
        else:
            raise ValueError(f"wire type {kind}")


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and the settings that encoding needs, from a SentencePiece model file."""
    out = {"pieces": [], "scores": [], "kinds": [], "bpe": False, "byte_fallback": False, "prefix": True, "extra_space": True, "escape": True, "charsmap": b"", "suffix": False}
    for number, value in _fields(open(path, "rb").read()):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            out["pieces"].append(piece)
            out["scores"].append(score)
            out["kinds"].append(kind)
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    out["bpe"] = v == 2
                elif k == 35:
                    out["byte_fallback"] = bool(v)
                elif k == 24:
                    out["suffix"] = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    out["charsmap"] = v
                elif k == 3:
                    out["prefix"] = bool(v)
                elif k == 4:
                    out["extra_space"] = bool(v)
                elif k == 5:
                    out["escape"] = bool(v)
    return out


class Table:
    """Open addressing from longs of at least 0 to ints of at least 0, for arrays of keys; -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(10, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            left = np.setdiff1d(left, won)
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        hit = found == keys
        out = np.where(hit, self.values[at], -1)
        open_ = np.flatnonzero(~hit & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    @classmethod
    def of(cls, items: dict[int, int]) -> Table:
        return cls(np.fromiter(items.keys(), np.int64, len(items)), np.fromiter(items.values(), np.int32, len(items)))


class Transducer:
    """Normaliser, piece automaton and byte fallback of one model, composed with words; encodes and decodes."""

    def __init__(self, model: str | dict) -> None:
        m = read_model(model) if isinstance(model, str) else model
        if m["charsmap"] or m["extra_space"] or m["suffix"] or not m["escape"] or USER in m["kinds"]:
            raise ValueError("only identity normalisation with escaped white space is compiled")
        self.prefix, self.bpe, self.size = m["prefix"], m["bpe"], len(m["pieces"])
        self.score_of: dict[str, float] = {}
        symbols: dict[str, int] = {}
        self.unknown = m["kinds"].index(UNKNOWN)
        self.bytes_of = np.full(256, -1, np.int32)
        for i, (piece, kind) in enumerate(zip(m["pieces"], m["kinds"])):
            if kind == BYTE:
                self.bytes_of[int(piece[3:5], 16)] = i
            elif kind == NORMAL and piece:
                self.score_of[piece] = m["scores"][i]
                symbols[piece] = i
        self.fallback = m["byte_fallback"] and (self.bytes_of >= 0).all()
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(m["pieces"], m["kinds"])
        ]
        self.is_byte = np.array([k == BYTE for k in m["kinds"]])
        self._compile_normaliser(symbols)
        merges = self._compile_merges(symbols) if self.bpe else {}
        self._compile_pieces({p: i for p, i in symbols.items() if len(p) > 1 and (not self.bpe or p in merges)})
        self._compile_weights(symbols)

    # compilation

    def _compile_normaliser(self, symbols: dict[str, int]) -> None:
        """Classes of code points, 0 for those in no piece, and the symbol of each class; uncovered ones come after the pieces."""
        chars = sorted({c for p in symbols for c in p})
        self.class_of = np.zeros(0x110000, np.int32)
        for k, c in enumerate(chars, 1):
            self.class_of[ord(c)] = k
        self.classes = len(chars) + 1
        self.class_of[ord(" ")] = self.class_of[ord(SPACE)]
        for k, c in enumerate([c for c in chars if c not in symbols]):
            symbols[c] = self.size + k
        #: a character in no piece at all is one symbol, which merges with nothing
        self.alien = self.size + sum(i >= self.size for i in symbols.values())
        self.symbol_of = np.array([self.alien, *(symbols[c] for c in chars)], np.int32)
        sides = {int(self.class_of[ord(a)]) * self.classes + int(self.class_of[ord(b)]): 1 for p in self.score_of for a, b in zip(p, p[1:])}
        self.beside = Table.of(sides)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score_of)

    def _compile_pieces(self, pieces: dict[str, int]) -> None:
        """Arcs (state, class) to state, and the piece that a state ends or -1; states of one class come first."""
        states: dict[str, int] = {}
        arcs: dict[int, int] = {}
        ends: dict[int, int] = {}
        for piece, id_ in pieces.items():
            at = int(self.class_of[ord(piece[0])])
            for n in range(2, len(piece) + 1):
                key = at * self.classes + int(self.class_of[ord(piece[n - 1])])
                at = states.setdefault(piece[:n], self.classes + len(states))
                arcs[key] = at
            ends[at] = id_
        self.arcs = Table.of(arcs)
        self.ends = np.full(self.classes + len(states), -1, np.int32)
        for at, id_ in ends.items():
            self.ends[at] = id_

    def _compile_merges(self, symbols: dict[str, int]) -> dict[str, tuple[str, str]]:
        """How each piece comes about, and the rank at which two symbols side by side merge."""
        order = {s: r for r, s in enumerate(sorted(set(self.score_of.values()), reverse=True))}
        rank = {p: order[s] for p, s in self.score_of.items()}
        merges, joins = {}, {}
        many = self.alien + 1
        self.rank, self.left, self.right = np.full(many, -1, np.int32), np.zeros(many, np.int32), np.zeros(many, np.int32)
        for piece in self.score_of:
            for n in range(1, len(piece)):
                a, b = symbols.get(piece[:n]), symbols.get(piece[n:])
                if a is not None and b is not None:
                    joins[a * many + b] = rank[piece]
            if len(piece) > 1 and (halves := self._last_merge(piece)):
                merges[piece] = halves
        for piece, (a, b) in merges.items():
            if any(len(x) > 1 and rank[x] > rank[piece] for x in (a, b)):
                raise ValueError(f"{piece!r} scores above a part it is merged from")
            i = symbols[piece]
            self.rank[i], self.left[i], self.right[i] = rank[piece], symbols[a], symbols[b]
        self.joins, self.many = Table.of(joins), many
        return merges

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the merge rules leave before the piece; None when they don't make it."""
        parts = list(piece)
        while len(parts) > 2:
            parts = self._merged(parts)
            if parts is None:
                return None
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _merged(self, parts: list[str]) -> list[str] | None:
        gains = [self.score_of.get(a + b, -INF) for a, b in zip(parts, parts[1:])]
        best = max(gains, default=-INF)
        if best == -INF:
            return None
        at = gains.index(best)
        return [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]

    def merge(self, text: str) -> list[str]:
        """The merge result of a text, by definition: best score first, leftmost on ties."""
        parts = list(text)
        while (after := self._merged(parts)) is not None:
            parts = after
        return parts

    def _compile_weights(self, symbols: dict[str, int]) -> None:
        """Of a unigram model: minus the score, and for uncovered characters more than any piece."""
        self.cost = np.full(self.alien + 1, 10.0 - min(self.score_of.values(), default=0.0))
        for piece, score in self.score_of.items():
            self.cost[symbols[piece]] = -score
        self.least = 0.0 if self.bpe else float(self.cost.min())

    # composition and shortest path

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the joint text of two symbols merges to exactly these two.

        Seen backwards in time, the later of the two goes back to its parts; a merge over the boundary
        that would have come before it (left of it: not after it) rules the pair out.
        """
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int32).max, np.int32)
        while len(at):
            joined = self.joins.get(a.astype(np.int64) * self.many + b)
            over = (joined >= 0) & (joined < limit)
            out[at[over]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~over & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            undo = ra > rb
            limit = np.where(undo, ra, rb + 1)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def _lattice(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """(from, to, symbol, step) of all arcs; a segment of n characters has n + 1 nodes."""
        segment = np.repeat(np.arange(len(starts), dtype=np.int64), sizes)
        until = np.repeat(starts + sizes, sizes)
        place = np.arange(len(classes))
        froms, lengths, symbols = [place], [np.ones(len(place), np.int64)], [self.symbol_of[classes]]
        at = place[(place + 1 < until) & (classes > 0)]
        state, n = classes[at].astype(np.int64), 1
        while len(at):
            state = self.arcs.get(state * self.classes + classes[at + n])
            n += 1
            ok = state >= 0
            at, state = at[ok], state[ok].astype(np.int64)
            piece = self.ends[state]
            ended = piece >= 0
            froms.append(at[ended])
            lengths.append(np.full(len(froms[-1]), n, np.int64))
            symbols.append(piece[ended])
            ok = at + n < until[at]
            at, state = at[ok], state[ok]
        at = np.concatenate(froms)
        step = at - starts[segment[at]]
        order = np.argsort(step.astype(np.int16) if step.max(initial=0) < 32768 else step, kind="stable")
        at, n, symbol = at[order], np.concatenate(lengths)[order], np.concatenate(symbols)[order]
        node = at + segment[at]
        return node, node + n, symbol, step[order], segment

    def _shortest(self, classes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """By position the symbol of the arc of the shortest path that leaves it, or -1."""
        source, target, symbol, step, segment = self._lattice(classes, starts, sizes)
        nodes = len(classes) + len(starts)
        first = starts + np.arange(len(starts))
        total, last, back = np.full(nodes, INF), np.full(nodes, -1, np.int32), np.zeros(nodes, np.int64)
        total[first] = 0.0
        edges = np.flatnonzero(np.concatenate([[True], step[1:] != step[:-1], [True]])) if len(step) else np.zeros(1, np.int64)
        for low, high in zip(edges, edges[1:]):
            u, v, s = source[low:high], target[low:high], symbol[low:high]
            ok = total[u] + self.least < total[v]  # no arc weighs less
            u, v, s = u[ok], v[ok], s[ok]
            through = total[u] + self._weights(last[u], s)
            ok = through < total[v]
            u, v, s = u[ok], v[ok], s[ok]
            total[v], last[v], back[v] = through[ok], s, u
        out = np.full(len(classes), -1, np.int32)
        at, own = first + sizes, np.arange(len(starts))
        while len(at):
            up = back[at]
            out[up - own] = last[at]
            ok = up != first[own]
            at, own = up[ok], own[ok]
        return out

    def _weights(self, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of arcs after the symbol ``before``, which is -1 at the start of a segment."""
        if not self.bpe:
            return self.cost[symbol]
        weights = np.zeros(len(symbol))
        inner = np.flatnonzero(before >= 0)
        weights[inner[~self._apart(before[inner], symbol[inner])]] = INF
        return weights

    def compose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Shortest paths of words: code points, where arcs begin, their symbols, and the word of each arc."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        classes = self.class_of[codes]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        cut = np.ones(len(codes), bool)
        cut[1:] = self.beside.get(classes[:-1].astype(np.int64) * self.classes + classes[1:]) < 0
        cut[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut)
        symbols = self._shortest(classes, starts, np.diff(np.append(starts, len(codes))))
        at = np.flatnonzero(symbols >= 0)
        return codes, at, symbols[at], np.repeat(np.arange(len(words)), sizes)[at]

    def path(self, text: str) -> list[str]:
        """Texts of the arcs of the shortest path of a normalised text."""
        _, at, _, _ = self.compose([text])
        return [text[i:j] for i, j in zip(at.tolist(), [*at[1:].tolist(), len(text)])]

    def _ids(self, words: list[str]) -> list[bytes]:
        codes, at, ids, word = self.compose(words)
        counts = np.ones(len(at), np.int64)
        alien = np.flatnonzero(ids >= self.size)
        if len(alien) and not self.fallback:
            ids[alien] = self.unknown
        elif len(alien):
            distinct, which = np.unique(codes[at[alien]], return_inverse=True)
            raw = [chr(c).encode() for c in distinct.tolist()]
            width = np.array([len(r) for r in raw])[which]
            table = np.array([list(r.ljust(4, b"\0")) for r in raw])[which]
            counts[alien] = width
            ids = np.repeat(ids, counts)
            begin = (np.cumsum(counts) - counts)[alien]
            for k in range(4):
                ids[begin[width > k] + k] = self.bytes_of[table[width > k, k]]
        ends = np.concatenate([[0], 4 * np.cumsum(np.bincount(word, counts, len(words)).astype(np.int64))]).tolist()
        data = ids.astype("<i4").tobytes()
        return [data[i:j] for i, j in zip(ends, ends[1:])]

    def words(self, text: str) -> list[str]:
        """The prefixed text cut before blanks (which are U+2581 to all arcs): a word keeps its own, and blanks in a row stay with the next word."""
        if not text:
            return []
        text = (" " if self.prefix else "") + text.replace(SPACE, " ")
        if not self.cuts:
            return [text]
        head, *rest = text.split(" ")
        out = [head] if head else []
        if "" not in rest:
            out += [" " + w for w in rest]
            return out
        run = 0
        for w in rest:
            run += 1
            if w:
                out.append(" " * run + w)
                run = 0
        if run:
            out.append(" " * run)
        return out

    def encode(self, texts: list[str], memo: Memo | None = None) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        memo = Memo(MEMO) if memo is None else memo
        cut = [self.words(t) for t in texts]
        for fresh in slices(memo.missing(set().union(*cut)), COMPOSED):
            memo.update(zip(fresh, self._ids(fresh)))
        get = memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids; the dummy prefix goes, invalid bytes become U+FFFD one by one."""
        if not len(ids):
            return ""
        surface = self.surface
        try:
            out = b"".join([surface[i] for i in ids.tolist()]).decode()
        except UnicodeDecodeError:
            out = self._decode_bytes(ids)
        if self.prefix and out.startswith(" ") and not self.is_byte[ids[0]]:
            out = out[1:]
        return out

    def _decode_bytes(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()

        def flush():
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.surface[i]
            else:
                flush()
                out.append(self.surface[i].decode())
        flush()
        return "".join(out)


_loaded: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _loaded:
        _loaded[path] = Transducer(path)
    return _loaded[path]


def _encode(text: str, extra: list[str], path: str):
    def run(batches):
        t, memo = transducer(path), Memo(MEMO)
        for b in batches:
            column = b.column(b.schema.get_field_index(text))
            for at, size in _balanced(column, SLICE):
                texts = ["" if x is None else x for x in column.slice(at, size).to_pylist()]
                coded = t.encode(texts, memo)
                ids = [np.frombuffer(c, np.int32) for c in coded]
                exact = [t.decode(i) == x for i, x in zip(ids, texts)]
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                flat = np.frombuffer(b"".join(coded), np.int32)
                is_byte = np.concatenate([[0], np.cumsum(t.is_byte[flat])])
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(b.schema.get_field_index(c)).slice(at, size) for c in extra],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                        pa.array(np.diff(offsets).astype(np.int64)),
                        pa.array(np.diff(is_byte[offsets]).astype(np.int64)),
                        pa.array(exact),
                    ],
                    names=[*extra, *RESULT],
                )
        memo.clear()
        memo.old.clear()
        release()

    return run


RESULT = ["ids", "n_pieces", "n_bytes_fallback", "round_trip"]


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, the ids, their number, how many are byte pieces, and whether decoding gives the text back."""
    keep = ["doc_id"] if keep is None else keep
    if clash := set(keep) & set(RESULT):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "ids array<int>", "n_pieces long", "n_bytes_fallback long", "round_trip boolean"])
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    return source.mapInArrow(_encode(text, keep, path), schema)


def decode(coded: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and the decoded ``text``; null ids decode to null."""
    keep = ["doc_id"] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in coded.schema}

    def run(batches):
        t = transducer(path)
        for b in batches:
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            out = [None if r is None else t.decode(np.array(r, np.int32)) for r in rows]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array(out, pa.string())], names=[*keep, "text"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "text string"])
    return coded.select(*keep, ids).mapInArrow(run, schema)
