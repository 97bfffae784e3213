"""Quality rules: a linear-chain conditional random field over the lines of a text.

Viterbi decoding marks each line as content or boilerplate; a text stays when the words of its content
lines are at least ``SHARE`` of all its words.  Before that, fixed rules fail very short and very
repetitive texts.

A line's features are bins of counts over its bytes (words, symbols, bars, exclamation marks, digits,
capitals), of its word lengths, of its first and last characters, and whether an equal line came
before.  No line is labelled; documents are, by ``labels.quality``.  So the labels of lines are latent and
fitted by expectation-maximisation with posterior constraints: of a document of label 0 at most ``LOW`` of
the words may be expected in content lines, of one of label 1 at least ``HIGH``.  A document that breaks its
constraint gets a bias on its lines, moved a step each round until it holds (the multiplier of the
constraint); how lines differ within a document is left to their features.  Meanwhile lines stand alone, or
neighbours would make all lines of a document agree; the labels so found then teach the whole field,
transitions included.  Both climb the exact log likelihood by forward-backward.  It is fitted on a bounded
sample (``SAMPLE`` documents, of which those are left out that don't fit into ``SAMPLE_LINES``).
Without two classes of labels every line is content.

Words are runs of anything but ASCII white space; a null or empty text has none and fails.  Lines end at
line feeds; texts of any length are read whole.  Null labels and labels of null documents are not read,
repeated ones count as the largest.  Equal rows are judged alike, other columns are carried through on
request, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, labelled_sample, release, within
from .token_count import _balanced

SAMPLE, SAMPLE_LINES = 3000, 150_000
#: Bounds on the expected share of words in content lines, for documents of label 0 and 1.
LOW, HIGH = 0.3, 0.8
ROUNDS, STEPS, FINISH = 15, 4, 60
#: Words in content lines over all words from which a text stays.
SHARE = 0.5
MIN_WORDS = 50
SEGMENT = 32

_SPACE, _SYMBOL, _BAR, _SHOUT, _DIGIT, _UPPER, _LOWER, _TAIL = (np.zeros(256, np.uint8) for _ in range(8))
for _t, _c in ((_SPACE, b"\t\n\x0b\x0c\r "), (_SYMBOL, b"#*$%&|<>"), (_BAR, b"|"), (_SHOUT, b"!?"), (_DIGIT, b"0123456789"), (_UPPER, bytes(range(65, 91))), (_LOWER, bytes(range(97, 123))), (_TAIL, bytes(range(128, 192)))):
    _t[list(_c)] = 1

WORD_BINS = np.array([0.5, 1.5, 3.5, 6.5, 10.5, 20.5, 50.5])
RATIO_BINS = np.array([0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.8])
LENGTH_BINS = np.array([2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0])
WIDTH = 9
FEATURES = 10


class Lines:
    """Byte counts of all lines of some texts at once, and the base counts of the texts."""

    def __init__(self, values: np.ndarray, offsets: np.ndarray) -> None:
        feeds = np.flatnonzero(values == 10)
        ends = np.sort(np.concatenate([feeds, offsets[1:]]))
        starts = np.sort(np.concatenate([feeds + 1, offsets[:-1]]))
        self.starts, self.ends = starts, ends
        #: lines of text i are first[i] to first[i + 1]; a text has one line more than line feeds
        self.first = np.searchsorted(feeds, offsets) + np.arange(len(offsets))
        space = _SPACE[values].astype(bool)
        begins = ~space
        begins[1:] &= space[:-1]
        inside = offsets[:-1][(offsets[:-1] < len(values)) & (np.diff(offsets) > 0)]
        begins[inside] = ~space[inside]
        self.words = self._sum(begins)
        self.letters = self._sum(~space & (_TAIL[values] == 0))
        self.symbols, self.bars, self.shouts, self.digits, self.upper, self.lower = (self._sum(t[values]) for t in (_SYMBOL, _BAR, _SHOUT, _DIGIT, _UPPER, _LOWER))
        full = ends > starts
        self.head = np.zeros(len(starts), np.uint8)
        self.tail = np.zeros(len(starts), np.uint8)
        self.head[full], self.tail[full] = values[starts[full]], values[ends[full] - 1]

    def _sum(self, mask: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return run[self.ends] - run[self.starts]

    def per_text(self, counts: np.ndarray) -> np.ndarray:
        run = np.concatenate([[0], np.cumsum(counts)])
        return run[self.first[1:]] - run[self.first[:-1]]

    def features(self, again: np.ndarray) -> np.ndarray:
        words = np.maximum(self.words, 1)
        cased = self.upper + self.lower
        columns = [
            np.searchsorted(WORD_BINS, self.words),
            np.searchsorted(RATIO_BINS, (self.symbols - self.bars) / words),
            np.searchsorted(RATIO_BINS, self.bars / words),
            np.searchsorted(RATIO_BINS, self.shouts / words),
            np.searchsorted(RATIO_BINS, self.digits / np.maximum(self.letters, 1)),
            np.searchsorted(RATIO_BINS, self.upper / np.maximum(cased, 1)),
            np.searchsorted(LENGTH_BINS, self.letters / words),
            again.astype(np.int64),
            np.isin(self.tail, list(b".!?:,")) + 2 * (self.tail == ord("|")),
            _UPPER[self.head] + 2 * _DIGIT[self.head] + 4 * (self.head >= 128),
        ]
        return np.stack(columns, axis=1).astype(np.int64) + np.arange(FEATURES) * WIDTH


def repeats(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words) - 2
    if n < 2 or len(set(zip(words, words[1:], words[2:]))) == n:
        return 0
    counts = Counter(zip(words, words[1:], words[2:]))
    hit = np.fromiter((counts[w] > 1 for w in zip(words, words[1:], words[2:])), bool, n)
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift : shift + n] |= hit
    return int(covered.sum())


def earlier(raw: bytes) -> list[bool]:
    """For each line whether it has a word and equals an earlier line."""
    rows = raw.split(b"\n")
    if len(set(rows)) == len(rows):
        return [False] * len(rows)
    seen: set[bytes] = set()
    out = []
    for r in rows:
        out.append(r in seen)
        if r.strip():
            seen.add(r)
    return out


class Field:
    """Binary linear chain: ``w`` scores content against boilerplate by line, ``t`` the transitions."""

    def __init__(self, w: np.ndarray, t: np.ndarray, start: np.ndarray) -> None:
        self.w, self.t, self.start = w, t, start

    def decode(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Viterbi over all texts side by side; true marks content."""
        gain = self.w[features].sum(axis=1)
        sizes = np.diff(first)
        out = np.ones(len(gain), bool)
        order = np.argsort(-sizes, kind="stable")
        begin, sizes = first[:-1][order], sizes[order]
        live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        back = []
        best = np.zeros((len(order), 2))
        for step, n in enumerate(live):
            here = np.stack([np.zeros(n), gain[begin[:n] + step]], axis=1)
            if step == 0:
                best[:n] = self.start + here
            else:
                through = best[:n, :, None] + self.t
                back.append(through.argmax(axis=1).astype(np.int8))
                best[:n] = through.max(axis=1) + here
        state = best.argmax(axis=1)
        for step in range(len(live) - 1, -1, -1):
            n = live[step]
            out[begin[:n] + step] = state[:n] == 1
            if step:
                state[:n] = back[step - 1][np.arange(n), state[:n]]
        return out


def expectations(e: np.ndarray, t: np.ndarray, start: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By forward-backward over segments: log normalisers, probability of content by line, of transitions by place.

    ``e`` is segments x lines x 2; lines of a segment that are not ``real`` come last and count for nothing.
    """
    n, length, _ = e.shape
    a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    a[:, 0] = start + e[:, 0]
    for i in range(1, length):
        a[:, i] = np.where(real[:, i, None], np.logaddexp(a[:, i - 1, :1] + t[0], a[:, i - 1, 1:] + t[1]) + e[:, i], a[:, i - 1])
    for i in range(length - 2, -1, -1):
        after = e[:, i + 1] + b[:, i + 1]
        b[:, i] = np.where(real[:, i + 1, None], np.logaddexp(t[:, 0] + after[:, :1], t[:, 1] + after[:, 1:]), 0.0)
    z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    content = np.exp(a[:, :, 1] + b[:, :, 1] - z[:, None]) * real
    pairs = np.exp(a[:, :-1, :, None] + t + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * real[:, 1:, None, None]
    return z, content, pairs


class Segments:
    """Lines of the sample in segments of ``SEGMENT``: features, words, and the document of each."""

    def __init__(self, chains: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        cut = [(f[at : at + SEGMENT], w[at : at + SEGMENT], d) for d, (f, w, _) in enumerate(chains) for at in range(0, len(f), SEGMENT)]
        n, self.pad = len(cut), FEATURES * WIDTH
        self.x = np.full((n, SEGMENT, FEATURES), self.pad, np.int16)
        self.words = np.zeros((n, SEGMENT))
        self.document = np.array([d for _, _, d in cut])
        sizes = np.array([len(f) for f, _, _ in cut])
        for i, (f, w, _) in enumerate(cut):
            self.x[i, : len(f)], self.words[i, : len(w)] = f, w
        self.real = np.arange(SEGMENT) < sizes[:, None]
        self.flat = self.x[self.real].ravel().astype(np.int64)

    def scores(self, w: np.ndarray) -> np.ndarray:
        e = np.zeros((*self.x.shape[:2], 2))
        e[:, :, 1] = np.append(w, 0.0)[self.x].sum(axis=2)
        return e

    def statistics(self, content: np.ndarray, pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of features with content, of transitions and of first states."""
        line = (content * weight[:, None])[self.real]
        begin = np.array([((1 - content[:, 0]) * weight).sum(), (content[:, 0] * weight).sum()])
        return np.concatenate([np.bincount(self.flat, np.repeat(line, FEATURES), self.pad), (pairs * weight[:, None, None, None]).sum(axis=(0, 1)).ravel(), begin])


def fit(chains: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = ROUNDS, steps: int = STEPS, decay: float = 1e-3) -> Field:
    """The field from (features, words, label) of documents, by constrained expectation-maximisation."""
    chains = [c for c in chains if len(c[0])]
    at = Segments(chains)
    y = np.array([label for _, _, label in chains])
    share = min(max(y.mean(), 1e-6), 1 - 1e-6)
    weight = (np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5)[at.document]
    total = np.maximum(np.bincount(at.document, at.words.sum(axis=1), len(y)), 1)
    lines = np.bincount(at.document, at.real.sum(axis=1), len(y))
    heft = at.words / total[at.document][:, None]
    # a document's bias falls on its lines by their words, one a line on average
    spread = heft * lines[at.document][:, None]
    bias = np.where(y == 1, 1.5, -1.5)
    theta = np.zeros(at.pad + 4 + 2)
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    real, k = at.real.sum(), 0

    def climb(goal: np.ndarray, steps: int, alone: bool) -> None:
        """Steps towards given counts; ``alone``: features only, no transitions."""
        nonlocal k
        for _ in range(steps):
            k += 1
            w, t, start = parts()
            _, content, pairs = expectations(at.scores(w), t, start, at.real)
            g = (goal - at.statistics(content, pairs, weight)) / real - decay * theta
            if alone:
                g[at.pad :] = 0
            m[:], s[:] = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            theta[:] += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)

    def parts() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return theta[: at.pad], theta[at.pad : at.pad + 4].reshape(2, 2), theta[at.pad + 4 :]

    for _ in range(rounds):
        w, t, start = parts()
        e = at.scores(w)
        e[:, :, 1] += bias[at.document][:, None] * spread
        _, content, pairs = expectations(e, t, start, at.real)
        expected = np.bincount(at.document, (content * heft).sum(axis=1), len(y))
        bias = np.where(y == 1, np.clip(bias + 4 * (HIGH - expected), 0, 20), np.clip(bias + 4 * (LOW - expected), -20, 0))
        climb(at.statistics(content, pairs, weight), steps, True)
    hard = (content > 0.5) & at.real
    both = hard[:, :-1], hard[:, 1:]
    pairs = np.stack([np.stack([(both[0] == i) & (both[1] == j) for j in (0, 1)], axis=-1) for i in (0, 1)], axis=-2) * at.real[:, 1:, None, None]
    climb(at.statistics(hard.astype(float), pairs.astype(float), weight), FINISH, False)
    return Field(theta[: at.pad], theta[at.pad : at.pad + 4].reshape(2, 2), theta[at.pad + 4 :])


def _texts(column: pa.Array):
    """Per slice of a column: (start, rows, texts as bytes, Lines, features)."""
    for at, size in _balanced(column, 4 << 20):
        part = column.slice(at, size)
        values, offsets = flat_bytes(part)
        whole = values.tobytes()
        raw = [whole[a:b] for a, b in zip(offsets, offsets[1:])]
        lines = Lines(values, offsets)
        again = np.array([x for r in raw for x in earlier(r)], bool)
        yield at, size, raw, lines, again


def _sample_lines(batches):
    for b in batches:
        for at, size, _, lines, again in _texts(b.column(0)):
            f = lines.features(again)
            own = list(zip(lines.first, lines.first[1:]))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(1).slice(at, size), b.column(2).slice(at, size), pa.array([j - i for i, j in own], pa.int64()),
                    pa.array([f[i:j].ravel() for i, j in own], pa.list_(pa.int16())), pa.array([lines.words[i:j] for i, j in own], pa.list_(pa.int32())),
                ],
                names=["y", "place", "weight", "features", "words"],
            )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Field | None:
    """The field from at most ``rows`` labelled documents; None without two classes."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "quality", 1, 1, rows)
    made = sample.select("text", "y", F.xxhash64("doc_id").alias("place")).mapInArrow(_sample_lines, "y int, place long, weight long, features array<short>, words array<int>")
    made = within(made, SAMPLE_LINES).toArrow()
    y = made["y"].to_pylist()
    if len(set(y)) < 2:
        return None
    chains = [(np.array(f.as_py(), np.int16).reshape(-1, FEATURES), np.array(w.as_py(), np.int64), label) for f, w, label in zip(made["features"], made["words"], y)]
    chains.sort(key=lambda c: (c[2], c[0].tobytes(), c[1].tobytes()))
    return fit(chains)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words"]


def _judge(field: Field | None, extra: list[str]):
    def run(batches):
        for b in batches:
            for at, size, raw, lines, again in _texts(b.column(0)):
                words = lines.per_text(lines.words)
                good = np.ones(len(again), bool) if field is None else field.decode(lines.features(again), lines.first)
                counts = [
                    words,
                    lines.per_text(lines.letters),
                    lines.per_text(lines.symbols),
                    lines.per_text(again),
                    np.array([repeats(r.split()) for r in raw], np.int64),
                    lines.per_text(np.where(good, lines.words, 0)),
                ]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, size) for c in b.columns[1:]], *[pa.array(c.astype(np.int64)) for c in counts]], names=[*extra, *NAMES])
        release()

    return run


def judge(docs: DataFrame, field: Field | None, keep: list[str] | None = None, text: str = "text", share: float = SHARE) -> DataFrame:
    """Columns ``keep``, the base counts, content_words, base_failed and kept."""
    keep = ["doc_id"] if keep is None else keep
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    slots = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in zip(slots, keep)), *(f"{c} long" for c in NAMES)])
    source = docs.select(F.col(f"`{text}`").alias("text"), *[F.col(f"`{c}`").alias(k) for k, c in zip(slots, keep)])
    made = source.mapInArrow(_judge(field, slots), schema)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = ~failed & (F.col("content_words") >= share * F.col("n_words"))
    return made.select(*[F.col(k).alias(c) for k, c in zip(slots, keep)], *NAMES, failed.alias("base_failed"), kept.alias("kept"))


def mark_lines(docs: DataFrame, field: Field | None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line: id, line (from 0), line_text, content."""

    def run(batches):
        for b in batches:
            for at, size, raw, lines, again in _texts(b.column(0)):
                good = np.ones(len(again), bool) if field is None else field.decode(lines.features(again), lines.first)
                ids = b.column(1).slice(at, size)
                counts = np.diff(lines.first)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(size), counts))),
                        pa.array(np.concatenate([np.arange(c) for c in counts]) if size else [], pa.int64()),
                        pa.array([x for r in raw for x in r.split(b"\n")], pa.binary()).cast(pa.string()),
                        pa.array(good),
                    ],
                    names=[id_, "line", "line_text", "content"],
                )

    kind = docs.schema[id_].dataType.simpleString()
    return docs.select(F.col(text), F.col(id_)).mapInArrow(run, f"`{id_}` {kind}, line long, line_text string, content boolean")
