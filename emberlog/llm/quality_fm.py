"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = w0 + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j.  The pair term is taken in linear time as
half of (sum v_i x_i)^2 - sum (v_i x_i)^2 per factor.  Features of a text: its words hashed into
``WORDS`` buckets with log counts scaled to length one, and each structure statistic as the one of its
quantile bins that it falls into.  ``n_chars`` is the metadata, used by the ratio of what it declares
to what the text has; a null counts as right.

The model is fitted on a bounded sample of labelled rows (``SAMPLE`` rows, of which those are left out
that don't fit into ``SAMPLE_WORDS``) by AdaGrad on the driver, where only hashed features arrive; whole
texts are scored in Arrow functions.  Null and empty texts are scored by their statistics, texts of any
length whole.  Without both labels every score is 0.5; null labels and labels of null documents are not
read, repeated ones count as the largest.  Equal rows score alike, an empty table gives an empty result,
and other columns, whatever their names, are carried through untouched by ``keep_good``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_values, labelled_sample, learnable, release, within
from .token_count import _balanced

WORDS = 1 << 14
#: Labelled rows that the fit reads at most, and hashed words in them.
SAMPLE, SAMPLE_WORDS = 10_000, 4_000_000
BINS = 10
FACTORS = 8
EPOCHS = 12
MODULUS, HELD = 3, 1

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>@^~=", b"|", b"!?", b".,;:", b"\n", b"{}[]()/\\_"]
STATS = 18


def statistics(raw: bytes, words: list[bytes], n_chars: int | None) -> list[float]:
    """Structure statistics of a text, each about evenly scaled and independent of language."""
    n, m = len(raw) or 1, len(words) or 1
    upper, lower, digit, symbol, pipe, shout, stop, lines, bracket = (n - len(raw.translate(None, k)) if raw else 0 for k in _CLASSES)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    rows = [r for r in raw.split(b"\n") if r.strip()]
    spaces = raw.count(b" ")
    chars = len(raw.decode("utf-8", "replace"))
    return [
        np.log1p(len(words)),
        distinct / m,
        again / m,
        sum(map(len, words)) / m,
        max(map(len, words), default=0) / 50,
        upper / (upper + lower + 1),
        digit / n,
        symbol / m,
        pipe / m,
        shout / m,
        stop / m,
        bracket / m,
        np.log1p(len(rows)),
        len(set(rows)) / (len(rows) or 1),
        len(words) / (len(rows) or 1),
        spaces / m,
        sum(map(bytes.isupper, words)) / m,
        1.0 if n_chars is None else min(3.0, n_chars / (chars or 1)),
    ]


def hashed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & (WORDS - 1)
    index, counts = np.unique(at, return_counts=True)
    x = np.log1p(counts)
    return index.astype(np.int32), (x / np.sqrt((x * x).sum())).astype(np.float32)


def features(raw: bytes, n_chars: int | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    cased = raw.split()
    return statistics(raw, cased, n_chars), *hashed(raw.lower().split())


class FactorisationMachine:
    def __init__(self, edges: list[np.ndarray], w0: float, w: np.ndarray, v: np.ndarray) -> None:
        self.edges, self.w0, self.w, self.v = edges, w0, w, v
        self.v2 = v * v

    def bins(self, stats: np.ndarray) -> np.ndarray:
        """Feature numbers of the statistics of n texts: n x STATS."""
        return np.stack([WORDS + s * BINS + np.searchsorted(e, stats[:, s], side="left") for s, e in enumerate(self.edges)], axis=1)

    def score(self, stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Probabilities of label 1."""
        binned = self.bins(stats)
        linear = self.w0 + self.w[binned].sum(axis=1)
        total = self.v[binned].sum(axis=1)
        squares = self.v2[binned].sum(axis=(1, 2))
        for i, (index, x) in enumerate(words):
            if len(index):
                linear[i] += self.w[index] @ x
                total[i] += x @ self.v[index]
                squares[i] += ((x * x) @ self.v2[index]).sum()
        return 1 / (1 + np.exp(-np.clip(linear + 0.5 * ((total**2).sum(axis=1) - squares), -30, 30)))


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """AdaGrad on the logistic loss, classes weighted alike up to a factor of three."""
    quantiles = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = [np.unique(np.quantile(stats[:, s], quantiles)) for s in range(STATS)]
    size = WORDS + STATS * BINS
    rng = np.random.default_rng(seed)
    w, v, w0 = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.0
    machine = FactorisationMachine(edges, 0.0, w, v)
    binned = machine.bins(stats)
    gw, gv, g0 = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    share = y.mean()
    weight = np.where(y == 1, min(3.0, max(1.0, (1 - share) / max(share, 1e-6))), min(3.0, max(1.0, share / max(1 - share, 1e-6))))
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for low in range(0, len(y), 128):
            rows = order[low : low + 128]
            sizes = np.array([len(words[r][0]) for r in rows])
            index = np.concatenate([*(words[r][0] for r in rows), binned[rows].ravel()])
            x = np.concatenate([*(words[r][1] for r in rows), np.ones(len(rows) * STATS)])
            row = np.concatenate([np.repeat(np.arange(len(rows)), sizes), np.repeat(np.arange(len(rows)), STATS)])
            vx = v[index] * x[:, None]
            total = np.stack([np.bincount(row, vx[:, f], len(rows)) for f in range(FACTORS)], axis=1)
            squares = np.bincount(row, (vx * vx).sum(axis=1), len(rows))
            z = w0 + np.bincount(row, w[index] * x, len(rows)) + 0.5 * ((total**2).sum(axis=1) - squares)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) * weight[rows] / len(rows)
            gx = g[row] * x
            dw = np.bincount(index, gx, size) + 1e-5 * w
            part = gx[:, None] * (total[row] - vx)
            dv = np.stack([np.bincount(index, part[:, f], size) for f in range(FACTORS)], axis=1) + 1e-5 * v
            gw += dw * dw
            gv += dv * dv
            g0 += g.sum() ** 2
            w -= 0.1 * dw / np.sqrt(gw)
            v -= 0.05 * dv / np.sqrt(gv)
            w0 -= 0.1 * g.sum() / np.sqrt(g0)
    return FactorisationMachine(edges, w0, w, v)


def _sample_features(batches):
    for b in batches:
        rows = [features(r, c) for r, c in zip(byte_values(b.column(0)), b.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [b.column(2), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.list_(pa.int32())), pa.array([r[2] for r in rows], pa.list_(pa.float32())), b.column(3), pa.array([len(r[1]) for r in rows], pa.int64())],
            names=["y", "stats", "index", "x", "place", "weight"],
        )


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> FactorisationMachine | None:
    """Fit on at most ``rows`` labelled documents outside the held-out fold; None without two classes."""
    sample = labelled_sample(docs.select("doc_id", "text", declared(docs).alias("chars")), labels, "quality", MODULUS, HELD, rows)
    made = sample.select("text", "chars", "y", F.xxhash64("doc_id").alias("place")).mapInArrow(_sample_features, "y int, stats array<double>, index array<int>, x array<float>, place long, weight long")
    made = within(made, SAMPLE_WORDS).toArrow()
    y = made["y"].to_numpy()
    if len(np.unique(y)) < 2:
        return None
    order = np.lexsort((made["stats"].combine_chunks().flatten().to_numpy().reshape(-1, STATS)[:, 3], y))
    stats = made["stats"].combine_chunks().flatten().to_numpy().reshape(-1, STATS)[order]
    index, x = made["index"].combine_chunks(), made["x"].combine_chunks()
    words = [(index[int(i)].values.to_numpy(), x[int(i)].values.to_numpy()) for i in order]
    return fit(stats, words, y[order].astype(float))


def _score(machine: FactorisationMachine | None, text: int, chars: int, keep: int):
    """Columns by place: the first ``keep`` pass through, the text and the declared length are among all."""

    def run(batches):
        for whole in batches:
            for at, size in _balanced(whole.column(text), 4 << 20):
                b = whole.slice(at, size)
                raw = byte_values(b.column(text))
                if machine is None:
                    scores = np.full(len(raw), 0.5)
                else:
                    rows = [features(r, c) for r, c in zip(raw, b.column(chars).to_pylist())]
                    scores = machine.score(np.array([r[0] for r in rows]).reshape(-1, STATS), [r[1:] for r in rows])
                yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(scores, pa.float64())], names=[*(f"k{i}" for i in range(keep)), "score"])
        release()

    return run


def scored(docs: DataFrame, machine: FactorisationMachine | None, keep: list[str]) -> DataFrame:
    """Columns ``keep`` as k0, k1 and so on, and ``score``; the text travels once."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    columns = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    text = keep.index("text") if "text" in keep else len(columns)
    if text == len(columns):
        columns.append(F.col("text").alias("text"))
    columns.append(declared(docs).alias("chars"))
    schema = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "score double"])
    return docs.select(*columns).mapInArrow(_score(machine, text, len(columns) - 1, len(keep)), schema)


def declared(docs: DataFrame) -> Column:
    """The declared number of characters, null where the table has none."""
    return F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    held, _ = learnable("doc_id", MODULUS, HELD)
    out = scored(docs, train(docs, labels, rows), ["doc_id"]).select(F.col("k0").alias("doc_id"), "score")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The documents whose score is at least 0.5, with their columns."""
    good = scored(docs, train(docs, labels, rows), docs.columns).where("score >= 0.5")
    return good.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
