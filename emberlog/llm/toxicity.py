"""Toxicity by lexicon induction on a word graph.

1. All documents give the nodes: every word in at least ``SUPPORT`` documents, or in one of
   ``1 / SUPPORT_SHARE`` where that is more.  Of rarer words, each goes by its longest beginning that such
   words have in as many documents together, if any.  A document adds each of its words once, so the
   nodes are at most the mean number of distinct words of a document over ``SUPPORT_SHARE``; tasks get
   them as two arrays.
2. All documents give the edges: how often two nodes stand within ``WINDOW`` words.  Tasks count into
   sorted arrays, which travel and stay in a table as compressed blobs, one or more per bucket of nodes.
3. A bounded sample of labelled documents (``SAMPLE``) gives only the seeds and the score model.  Terms
   are its words and beginnings of words.  Seeds of the toxic side are all terms whose document frequency
   depends on the label significantly (log-likelihood ratio), and those found by covering: the term with
   the largest ratio among the toxic documents that no seed is in, again and again while it is
   significant.  Neutral seeds are all terms that are common in the other documents and don't lean.
   Documents of the sample that are copies or near copies share one document's weight.
4. Edges weigh positive pointwise mutual information.  Random walks with restart from the nodes of
   either set of seeds give each node two visiting rates; the logarithm of their ratio is its polarity.
   A step is a pass over the table of edges, summed by ranges of nodes; the driver holds a few numbers
   per node, never edges.  Words that no labelled document has get their polarity the same way.
5. A document is scored from the polarities of its distinct nodes, each squashed around an edge: the
   four strongest, their sum and its share of the words, by a logistic model; edge and model are fitted
   on the sample.

Words are lower-cased and parted at white space and ASCII punctuation; whole texts of any length are
read.  Null and empty texts have no words and get the score of such.  Without both labels every score is
0.5; null labels and labels of null documents are not read, repeated ones count as the largest.  Equal
rows score alike, an empty table gives an empty result, and other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropping_shuffles, labelled_sample, learnable, materialise, release, remove, shared_path
from .token_count import _balanced

SAMPLE = 8000
#: Lengths, in characters, of the beginnings of words that are terms.
STEMS = (3, 4, 5, 6, 7)
MEMO = 300_000
INPUTS = 7
#: Documents that a node stands in at least, outright and as a share of all.
SUPPORT, SUPPORT_SHARE = 3, 1e-6
WINDOW = 4
RESTART = 0.3
#: Visiting rate, in parts of the average, that both sides of the ratio get for free.
FLOOR = 2.0
STEPS = 60
#: A walk ends when a step moves less than this part of it.
SETTLED = 0.003
#: Words of the corpus per bucket of edges, pairs that a task holds before it passes them on, bytes of text taken at once.
BUCKET_WORDS, HELD_PAIRS, SLICE = 1_000_000, 6_000_000, 4 << 20
#: Log-likelihood ratio from which a term is a seed: among all documents, and among those left over.
SIGNIFICANT = 24.0
COVERING = 16.0
#: Ratio below which a term isn't even looked at as a seed (one in twenty by chance), and the ratio that counts as leaning.
NOTICED, LEANING = 3.84, 4.0
#: Share of the sample's other documents that a neutral seed stands in at least.
COMMON = 0.05
#: Nodes whose visiting rates are summed together.
RANGE = 1 << 16
MODULUS, HELD = 5, 0

_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TABLE = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))


def words_of(text: str) -> list[str]:
    return text.lower().encode("utf-8", "replace").translate(_TABLE).decode().split()


def ratio(a: np.ndarray, b: np.ndarray, na: float, nb: float) -> np.ndarray:
    """Log-likelihood ratio of document frequencies a of na and b of nb, negative where b leans."""
    na, nb = max(na, 1.0), max(nb, 1.0)
    p, pa_, pb = (a + b) / (na + nb), a / na, b / nb

    def term(k, n, q):
        q = np.clip(q, 1e-12, 1 - 1e-12)
        return k * np.log(q) + (n - k) * np.log(1 - q)

    g = 2 * (term(a, na, pa_) + term(b, nb, pb) - term(a, na, p) - term(b, nb, p))
    return np.where(pa_ >= pb, g, -g)


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Terms(dict):
    """Bounded memo from a word to the number of its strongest term, or -1."""

    def __init__(self, index: dict[str, int]) -> None:
        super().__init__()
        self.words = {t: i for t, i in index.items() if t[-1] != "*"}
        self.stems = {t[:-1]: i for t, i in index.items() if t[-1] == "*"}
        self.none = len(index)

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO:
            self.clear()
        none, stem, n = self.none, self.stems.get, len(word)
        best = self.words.get(word, none)
        for k in STEMS:
            if n <= k:
                break
            if (i := stem(word[:k], none)) < best:
                best = i
        self[word] = best = -1 if best == none else best
        return best


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def sketch(words: list[str]) -> int:
    """Equal for most near copies: from the two smallest hashes of the longer words."""
    hashes = sorted(xxhash.xxh3_64_intdigest(w) for w in words if len(w) > 5)[:2]
    return xxhash.xxh3_64_intdigest(repr(hashes or words).encode()) >> 1


def _sample_words(batches):
    for b in batches:
        words = [sorted(set(words_of(r))) for r in texts_of(b.column(0))]
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(words, pa.list_(pa.string())), pa.array([sketch(w) for w in words], pa.int64())], names=["y", "words", "sketch"]
        )


def _sample_terms(batches):
    """Document frequencies of terms, one row per term and task."""
    counts = (Counter(), Counter())
    for b in batches:
        for y, words, weight in zip(*(b.column(k).to_pylist() for k in range(3))):
            count = counts[1 if y else 0]
            for t in {t for w in words for t in terms_of(w)}:
                count[t] += weight
    terms = list(counts[0].keys() | counts[1].keys())
    for low in range(0, len(terms), 50_000):
        part = terms[low : low + 50_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.float64()), pa.array([counts[0][t] for t in part], pa.float64())],
            names=["term", "a", "b"],
        )


def tokens(raws: list[str], once: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words of some texts, the number of each word in order, and the words of each text; ``once``: a text's
    words without repeats."""
    lists = [set(words_of(r)) if once else words_of(r) for r in raws]
    coded = pa.array(list(chain.from_iterable(lists)), pa.string()).dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Nodes:
    """Numbers of nodes by the hash of their term, in two arrays."""

    def __init__(self, hashes: np.ndarray) -> None:
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int32)
        self.memo: dict[str, int] = {}

    def find(self, terms: list[str]) -> np.ndarray:
        """Numbers of terms, -1 where there is no such node."""
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
        if not len(self.hashes):
            return np.full(len(terms), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.numbers[at], -1)

    def resolve(self, words: list[str]) -> np.ndarray:
        """The node of each word: its own, or that of its longest beginning that is one, or -1.

        Words met lately are kept in a bounded memo.
        """
        if len(self.memo) > MEMO:
            self.memo.clear()
        out = np.fromiter(map(self.memo.get, words, repeat(-2)), np.int32, len(words))
        at = np.flatnonzero(out == -2)
        fresh = [words[i] for i in at.tolist()]
        found = self.find(fresh)
        for k in reversed(STEMS):
            left = [i for i in np.flatnonzero(found < 0).tolist() if len(fresh[i]) > k]
            found[left] = self.find([fresh[i][:k] + "*" for i in left])
        out[at] = found
        self.memo.update(zip(fresh, found.tolist()))
        return out

    def __reduce__(self):
        back = np.empty_like(self.hashes)
        back[self.numbers] = self.hashes
        return Nodes, (back,)

    def __getitem__(self, word: str) -> int:
        return int(self.resolve([word])[0])


def _word_counts(batches):
    """Per word and task: documents it is in, and occurrences."""
    docs, all_ = Counter(), Counter()

    def rows():
        terms = list(all_)
        for low in range(0, len(terms), 50_000):
            part = terms[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([docs[t] for t in part], pa.int64()), pa.array([all_[t] for t in part], pa.int64())], names=["term", "docs", "n"]
            )
        docs.clear()
        all_.clear()

    for b in batches:
        for raw in texts_of(b.column(0)):
            words = words_of(raw)
            docs.update(set(words))
            all_.update(words)
            if len(all_) > MEMO:
                yield from rows()
    yield from rows()
    release()


def word_counts(docs: DataFrame) -> DataFrame:
    """(term, docs, n) of every word of the corpus."""
    each = docs.select("text").mapInArrow(_word_counts, "term string, docs long, n long")
    return each.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


def _with_hashes(term: pa.Array, n: pa.Array) -> pa.RecordBatch:
    hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in term.to_pylist()], np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([term, n, pa.array(hashes, pa.int64())], names=["term", "n", "hash"])


def _hashed(batches):
    for b in batches:
        yield _with_hashes(b.column(0), b.column(1))


def _beginnings(support: int):
    """Words that begin alike meet here: each goes by its longest beginning with support."""

    def run(batches):
        words = [w for b in batches for w in zip(*(b.column(k).to_pylist() for k in range(3)))]
        docs, n = Counter(), Counter()
        for term, d, _ in words:
            for k in STEMS:
                if len(term) > k:
                    docs[term[:k]] += d
        for term, _, m in words:
            for k in reversed(STEMS):
                if len(term) > k and docs[term[:k]] >= support:
                    n[term[:k] + "*"] += m
                    break
        del words, docs
        yield _with_hashes(pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()))
        release()

    return run


def supported(docs: DataFrame, support: int | None = None) -> DataFrame:
    """(term, n, hash) of every node; a beginning ends in a star and counts the words that go by it."""
    if support is None:
        support = max(SUPPORT, int(np.ceil(SUPPORT_SHARE * docs.count())))
    spark, path = docs.sparkSession, shared_path(docs.sparkSession, "words")
    with dropping_shuffles(spark):
        word_counts(docs).write.parquet(path)
    counts = spark.read.parquet(path)
    rare = counts.where((F.col("docs") < support) & (F.length("term") > STEMS[0]))
    # both sides hash their own terms: a function over the union would be a second Python worker beside that of each task
    kind = "term string, n long, hash long"
    stems = rare.repartition(F.substring("term", 1, STEMS[0])).mapInArrow(_beginnings(support), kind)
    out = materialise(counts.where(F.col("docs") >= support).select("term", "n").mapInArrow(_hashed, kind).unionByName(stems))
    remove(spark, path)
    return out


def _planes(values: np.ndarray) -> np.ndarray:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T


def pack(x: np.ndarray, y: np.ndarray, n: np.ndarray, buckets: int) -> bytes:
    """Pairs of one bucket, sorted by x and y: differences by byte planes, compressed."""
    raw = np.empty((3, 4, len(x)), np.uint8)
    dx = np.diff(x // buckets, prepend=0)
    raw[0] = _planes(dx)
    dy = y.copy()
    np.subtract(dy[1:], y[:-1], out=dy[1:], where=dx[1:] == 0)
    raw[1] = _planes(dy)
    raw[2] = _planes(np.minimum(n, 0xFFFFFFFF))
    return len(x).to_bytes(8, "little") + pa.compress(pa.py_buffer(raw), codec="zstd", asbytes=True)


def unpack(blob: bytes, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], 12 * size, codec="zstd", asbytes=True), np.uint8).reshape(3, 4, size)
    dx, dy, n = (np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.int64) for p in raw)
    starts = np.flatnonzero(np.concatenate([[True], dx[1:] != 0]))
    through = np.cumsum(dy)
    before = through[starts] - dy[starts]
    y = through - np.repeat(before, np.diff(np.append(starts, size)))
    return np.cumsum(dx) * buckets + bucket, y, n


def folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts, dtype=np.int64)


def folded_runs(keys: list[np.ndarray], counts: list[np.ndarray], cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``folded`` of several arrays that are sorted, in runs of keys from one cut to the next, each a small part of all."""
    ends = [np.searchsorted(k, cuts) for k in keys]
    for r in range(len(cuts) - 1):
        parts = [(a, e[r], e[r + 1]) for a, e in enumerate(ends) if e[r] < e[r + 1]]
        if parts:
            yield folded(np.concatenate([keys[a][i:j] for a, i, j in parts]), np.concatenate([counts[a][i:j] for a, i, j in parts]))


def _pairs(nodes: Nodes, buckets: int):
    """Per task: blobs of pair counts by bucket, x the smaller number."""

    def run(batches):
        size = len(nodes.hashes)
        # sorted by bucket, then x, then y
        rows = -(-size // buckets)
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush():
            """Folds what is held by runs of whole buckets and passes each run on before the next."""
            step = max(1, buckets // 16)
            for k, n in folded_runs(keys, counts, np.arange(0, buckets + step, step) * (rows * size)):
                line, y = np.divmod(k, size)
                bucket, row = np.divmod(line, rows)
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                at = [int(bucket[i]) for i in cuts[:-1]]
                blobs = [pack(row[i:j] * buckets + bucket[i], y[i:j], n[i:j], buckets) for i, j in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "pairs"])
            keys.clear()
            counts.clear()

        def in_a_row(raws):
            """Nodes of the words in a row, with a gap after each text."""
            words, at, sizes = tokens(raws)
            ids = np.full(len(at) + WINDOW * len(raws), -1, np.int32)
            if words:
                ids[np.arange(len(at)) + WINDOW * np.repeat(np.arange(len(raws)), sizes)] = nodes.resolve(words)[at]
            return ids

        def count(texts):
            # words are held as text for a part of the slice only
            ids = np.concatenate([in_a_row(texts_of(texts.slice(at, part))) for at, part in _balanced(texts, SLICE // 8)])
            found, end = np.empty(WINDOW * len(ids), np.int64), 0
            for k in range(1, WINDOW + 1):
                x, y = ids[:-k], ids[k:]
                ok = (x >= 0) & (y >= 0)
                x, y = x[ok], y[ok]
                low, high = np.minimum(x, y).astype(np.int64), np.maximum(x, y)
                found[end : end + len(x)] = (low % buckets * rows + low // buckets) * size + high
                end += len(x)
            found = found[:end]
            if end:
                found.sort()
                starts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
                keys.append(found[starts])
                counts.append(np.diff(starts, append=end).astype(np.uint32))

        for b in batches:
            for at, part in _balanced(b.column(0), SLICE):
                count(b.column(0).slice(at, part))
                if sum(map(len, keys)) > HELD_PAIRS:
                    yield from flush()
        if keys:
            yield from flush()
        nodes.memo.clear()
        release()

    return run


def _merged(buckets: int):
    def run(batches):
        blobs: dict[int, list[bytes]] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                blobs.setdefault(k, []).append(blob)
        for k in sorted(blobs):
            keys, counts = [], []
            for blob in blobs.pop(k):
                x, y, n = unpack(blob, k, buckets)
                keys.append((x << 32) | y)
                counts.append(n.astype(np.uint32))
            del x, y, n
            # cut where the longest part has a sixteenth each
            longest = max(keys, key=len)
            cuts = np.unique(np.concatenate([[0], longest[:: len(longest) // 16 + 1], [np.iinfo(np.int64).max]]))
            runs = list(folded_runs(keys, counts, cuts))
            del keys, counts, longest
            found, n = (np.concatenate(c) for c in zip(*runs))
            del runs
            x, y = found >> 32, found & 0xFFFFFFFF
            del found
            ordered = int(n.sum() + n[x != y].sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([pack(x, y, n, buckets)], pa.binary()), pa.array([ordered], pa.int64())], names=["bucket", "pairs", "ordered"]
            )
            del x, y, n
        release()

    return run


def pair_table(docs: DataFrame, nodes: Nodes, buckets: int) -> DataFrame:
    """Pair counts of the nodes over all documents, a row per bucket; ``ordered`` counts both orders."""
    each = docs.select("text").mapInArrow(_pairs(nodes, buckets), "bucket int, pairs binary")
    return materialise(each.repartition("bucket").mapInArrow(_merged(buckets), "bucket int, pairs binary, ordered long"))


def cooccurrence(docs: DataFrame, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric pair counts within the window over all documents, and counts of the words, of a few nodes."""
    size = len(index)
    together, single = np.zeros((size, size)), np.zeros(size)
    nodes = Nodes(np.array([xxhash.xxh3_64_intdigest(t) for t in sorted(index, key=index.get)], np.uint64))
    for r in pair_table(docs, nodes, 2).collect():
        x, y, n = unpack(bytes(r["pairs"]), r["bucket"], 2)
        together[x, y] = together[y, x] = n
    for r in word_counts(docs).where(F.col("term").isin(*index)).collect():
        single[index[r["term"]]] = r["n"]
    return together, single


def edge_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray, share: np.ndarray, level: float) -> np.ndarray:
    """Pointwise mutual information of pairs: log n - log of all pairs - the words' log shares."""
    small = np.log(np.maximum(np.arange(1 << 12), 1)).astype(np.float32)
    logs = small[np.minimum(n, len(small) - 1)]
    large = np.flatnonzero(n >= len(small))
    logs[large] = np.log(n[large])
    return logs + np.float32(level) - share[x] - share[y]


def _moved(buckets: int, share: np.ndarray, level: float, rates: np.ndarray):
    """Per task: what its edges carry from ``rates`` (walks x nodes) to each node, by ranges of nodes."""

    def run(batches):
        size = len(share)
        out = np.zeros(rates.shape)
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y, n = unpack(blob, k, buckets)
                weight = edge_weights(x, y, n, share, level)
                ok = np.flatnonzero(weight > 0)
                if not len(ok):
                    continue
                x, y, weight = x[ok], y[ok], weight[ok]
                back = np.where(x != y, weight, 0)
                runs = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))  # pairs are sorted by x
                heads = x[runs]
                for walk_, rate in zip(out, rates):
                    walk_ += np.bincount(y, weight * rate[x], size)
                    walk_[heads] += np.add.reduceat(back * rate[y], runs, dtype=np.float64)
        for low in range(0, size, RANGE):
            part = out[:, low : low + RANGE]
            if part.any():
                yield _range(low // RANGE, part)
        release()

    return run


def _range(number: int, part: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.astype(np.float32).tobytes()], pa.binary())], names=["part", "moved"])


def _added(walks_: int):
    """The sum of each range's rows."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                row = np.frombuffer(blob, np.float32).reshape(walks_, -1)
                sums[k] = sums[k] + row if k in sums else row.astype(np.float64)
        for k, total in sums.items():
            yield _range(k, total)

    return run


def walks(pairs: DataFrame, counts: np.ndarray, buckets: int, starts: np.ndarray, settled: float = SETTLED) -> np.ndarray:
    """Visiting rates of random walks with restart at ``starts`` (walks x nodes) on the graph of mutual information.

    A node without edges, or what a walk loses there, restarts.
    """
    ordered = pairs.agg(F.sum("ordered")).first()[0]
    if not ordered:
        return starts
    share = np.log(counts / counts.sum()).astype(np.float32)
    level = -float(np.log(ordered))
    tasks = pairs.select("bucket", "pairs").coalesce(pairs.sparkSession.sparkContext.defaultParallelism)

    def moved(rates: np.ndarray) -> np.ndarray:
        total = np.zeros(rates.shape)
        with dropping_shuffles(pairs.sparkSession):
            each = tasks.mapInArrow(_moved(buckets, share, level, rates.astype(np.float32)), "part int, moved binary")
            sums = each.repartition("part").mapInArrow(_added(len(rates)), "part int, moved binary").collect()
        for r in sums:
            low = r["part"] * RANGE
            total[:, low : low + RANGE] = np.frombuffer(r["moved"], np.float32).reshape(len(rates), -1)
        return total

    out = moved(np.ones((1, len(counts))))[0]
    scale = np.divide(1.0, out, out=np.zeros_like(out), where=out > 0)
    before = rates = starts
    # Chebyshev semi-iteration (Golub and Varga, 1961): the graph is symmetric, so the walk's eigenvalues are real and
    # at most 1 - RESTART in size; each step corrects the one before, and about half as many are needed
    pull = 1.0
    for k in range(STEPS):
        come = (1 - RESTART) * moved(rates * scale)
        step = come + (1 - come.sum(axis=1, keepdims=True)) * starts
        if np.abs(step - rates).sum(axis=1).max() < settled:
            return step
        if k:
            pull = 1 / (1 - (1 - RESTART) ** 2 * pull / (2 if k == 1 else 4))
        before, rates = rates, pull * (step - before) + before if k else step
    return np.maximum(rates, 0.0)


def polarities(up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Logarithm of the ratio of two visiting rates; 0 where neither walk comes."""
    floor = FLOOR / len(up)
    return np.where((up + down) == 0, 0.0, np.log((up + floor) / (down + floor)))


def _seeded(index: dict[str, int]):
    """Of nodes that a candidate fits: the strongest candidate, the hash and the count."""

    def run(batches):
        get = Terms(index).__getitem__
        for b in batches:
            # a beginning is fitted by beginnings only
            at = np.array([get(t[:-1] + "\0" if t[-1] == "*" else t) for t in b.column(0).to_pylist()], np.int64)
            ok = pa.array(at >= 0)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()).filter(ok), b.column(1).filter(ok), b.column(2).filter(ok)], names=["candidate", "n", "hash"])

    return run


class Lexicon:
    def __init__(self, nodes: Nodes, polarity: np.ndarray) -> None:
        self.nodes, self.polarity = nodes, polarity.astype(np.float32)
        self.fitted(1.0, np.zeros(INPUTS))

    def fitted(self, edge: float, model: np.ndarray) -> None:
        """``edge``: polarity at which a node counts half; only nodes that lean to the toxic side count."""
        self.edge, self.model = edge, model
        self.held = np.where(self.polarity > 0, 1 / (1 + np.exp(-8.0 * (self.polarity - edge))), 0)

    def inputs(self, doc: np.ndarray, node: np.ndarray, distinct: np.ndarray) -> np.ndarray:
        """Of documents by number, from their distinct nodes, sorted by both, and their numbers of distinct words:
        the four strongest, their sum and its share of the words."""
        held = self.held[node]
        out = np.zeros((len(distinct), INPUTS))
        out[:, 0] = 1.0
        order = np.lexsort((-held, doc))
        sizes = np.bincount(doc, minlength=len(distinct))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        top = place < 4
        out[doc[top], 1 + place[top]] = held[order[top]]
        total = np.bincount(doc, held, len(distinct))
        out[:, 5], out[:, 6] = np.log1p(total), np.minimum(5.0, 100 * total / np.maximum(distinct, 1))
        return out

    def score(self, raws: list[str]) -> np.ndarray:
        words, ids, sizes = tokens(raws, once=True)
        node = self.nodes.resolve(words)[ids] if words else np.zeros(0, np.int64)
        ok = np.flatnonzero(node >= 0)
        ok = ok[self.held[node[ok]] > 0]  # others add nothing
        size = max(len(self.polarity), 1)
        both = np.unique(np.repeat(np.arange(len(raws)), sizes)[ok] * size + node[ok])
        x = self.inputs(both // size, both % size, sizes)
        return 1 / (1 + np.exp(-np.clip(x @ self.model, -30, 30)))


def choose_seeds(rows: list[np.ndarray], y: np.ndarray, weight: np.ndarray, terms: int) -> tuple[list[int], list[int]]:
    """(toxic, neutral) term numbers from the terms of each document of the sample."""

    def frequency(which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros(terms)
        sizes = [len(rows[i]) for i in which]
        return np.bincount(np.concatenate([rows[i] for i in which]).astype(np.int64), np.repeat(weight[which], sizes), terms)

    good, left = np.flatnonzero(y == 0), np.flatnonzero(y != 0)
    clean, n_clean = frequency(good), weight[good].sum()
    lean = ratio(frequency(left), clean, weight[left].sum(), n_clean)
    toxic = [int(i) for i in np.argsort(-lean, kind="stable") if lean[i] >= SIGNIFICANT]
    held = set(toxic)
    left = np.array([i for i in left if held.isdisjoint(rows[i].tolist())], np.int64)
    while len(left):
        g = ratio(frequency(left), clean, weight[left].sum(), n_clean)
        best = int(g.argmax())
        if g[best] < COVERING:
            break
        toxic.append(best)
        held.add(best)
        left = np.array([i for i in left if best not in rows[i]], np.int64)
    return toxic, [i for i in np.flatnonzero((lean < LEANING) & (clean >= COMMON * n_clean)).tolist() if i not in held]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton steps on the ridge-penalised logistic loss."""
    beta = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists of ints, as views of one array."""
    whole = column.combine_chunks()
    return np.split(whole.flatten().to_numpy(), np.cumsum(pc.list_value_length(whole).to_numpy())[:-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Lexicon | None:
    """Graph over all of ``docs``, seeds, polarities and score model; None without both labels."""
    sample = labelled_sample(docs.select("doc_id", "text"), labels, "toxic", MODULUS, HELD, rows)
    sample = materialise(sample.select("text", "y").mapInArrow(_sample_words, "y int, words array<string>, sketch long"))
    copies = sample.groupBy("y", "sketch").count()
    sample = sample.join(F.broadcast(copies), ["y", "sketch"]).select("y", "words", (1 / F.col("count")).alias("weight"))
    totals = {r["y"]: r["n"] for r in copies.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return None
    per = sample.mapInArrow(_sample_terms, "term string, a double, b double").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    na, nb = F.lit(float(totals[1])), F.lit(float(totals[0]))
    p, qa, qb = (F.col("a") + F.col("b")) / (na + nb), F.col("a") / na, F.col("b") / nb

    def term(k, n, q):
        q = F.least(F.greatest(q, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(q) + (n - k) * F.log(1 - q)

    g = 2 * (term(F.col("a"), na, qa) + term(F.col("b"), nb, qb) - term(F.col("a"), na, p) - term(F.col("b"), nb, p))
    rated = per.withColumn("g", g).withColumn("toxic", qa > qb)
    noticed = rated.where((F.col("toxic") & (F.col("g") >= NOTICED)) | (F.col("b") >= COMMON * nb))
    terms = noticed.select("term", "g").toArrow()
    found = [(-g, len(t), t) for t, g in zip(terms["term"].to_pylist(), terms["g"].to_pylist())]
    if not found:
        return None
    chosen = [t for _, _, t in sorted(found)]  # numbers follow strength
    index = {w: i for i, w in enumerate(chosen)}

    table = supported(docs)
    known = table.select("hash", "n").orderBy(F.col("n").desc(), "hash").toArrow()  # commonest first, so that pairs pack well
    if not known.num_rows:
        return None
    counts = known["n"].to_numpy().astype(np.float64)
    nodes = Nodes(known["hash"].to_numpy().view(np.uint64))

    def hits(batches):
        get = Terms(index).__getitem__
        for b in batches:
            words = b.column(1).to_pylist()
            found = [sorted({i for i in map(get, ws) if i >= 0}) for ws in words]
            each = list(set().union(*words))
            node = dict(zip(each, nodes.resolve(each).tolist()))
            at = [sorted({i for i in map(node.__getitem__, ws) if i >= 0}) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(found, pa.list_(pa.int32())), pa.array(at, pa.list_(pa.int32())), pa.array([len(w) for w in words], pa.int32())], names=["y", "weight", "hits", "nodes", "distinct"]
            )

    made = sample.mapInArrow(hits, "y int, weight double, hits array<int>, nodes array<int>, distinct int").toArrow()
    y = made["y"].to_numpy()
    toxic, neutral = choose_seeds(_lists(made["hits"]), y, made["weight"].to_numpy(), len(chosen))
    if not toxic or not neutral:
        return None
    # a seed's share of the restarts goes to its nodes by their counts
    fits = table.mapInArrow(_seeded(index), "candidate long, n long, hash long").where(F.col("candidate").isin(*toxic, *neutral)).toArrow()
    seed, weight = fits["candidate"].to_numpy(), fits["n"].to_numpy().astype(np.float64)
    at = nodes.numbers[np.searchsorted(nodes.hashes, fits["hash"].to_numpy().view(np.uint64))]
    weight /= np.bincount(seed, weight, len(chosen))[seed] if len(seed) else 1
    starts = np.zeros((2, len(counts)))
    for side, own in enumerate((toxic, neutral)):
        ok = np.isin(seed, own)
        np.add.at(starts[side], at[ok], weight[ok])
    if not starts.any(axis=1).all():
        return None
    starts /= starts.sum(axis=1, keepdims=True)
    buckets = 4 + int(counts.sum()) // BUCKET_WORDS
    up, down = walks(pair_table(docs, nodes, buckets), counts, buckets, starts)
    lexicon = Lexicon(nodes, polarities(up, down))
    hits_of, distinct = _lists(made["nodes"]), made["distinct"].to_numpy()
    doc = np.repeat(np.arange(len(hits_of)), [len(h) for h in hits_of])
    node = np.concatenate(hits_of).astype(np.int64)
    best = -np.inf
    for edge in np.linspace(0.4, 2.2, 10):
        lexicon.fitted(float(edge), lexicon.model)
        x = lexicon.inputs(doc, node, distinct)
        model = logistic(x, y.astype(float))
        p = np.clip(1 / (1 + np.exp(-x @ model)), 1e-9, 1 - 1e-9)
        fits = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
        if fits > best + 1e-6:
            best, kept = fits, (lexicon.edge, model)
    lexicon.fitted(*kept)
    return lexicon


def _score(lexicon: Lexicon | None, extra: list[str]):
    def run(batches):
        for whole in batches:
            for at, size in _balanced(whole.column(0), SLICE):
                b = whole.slice(at, size)
                raws = texts_of(b.column(0))
                scores = np.full(len(raws), 0.5) if lexicon is None else lexicon.score(raws)
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64())], names=[*extra, "__score"])
        release()

    return run


def classify(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    lexicon = train(docs, labels, rows)
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("text", "doc_id").mapInArrow(_score(lexicon, ["doc_id"]), f"doc_id {kind}, __score double")
    held, _ = learnable("doc_id", MODULUS, HELD)
    return out.select("doc_id", held.alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
