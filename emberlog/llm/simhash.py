"""SimHash near-dedup by multi-index hashing.

A text's fingerprint comes from the XXH64 (seed 42) of its 2-word shingles, repeats included; a bit
is set when it is set in over half of them.  Two texts link when their fingerprints differ in at
most ``RADIUS`` bits.

Search works on distinct fingerprints.  Each is cut into segments; two fingerprints within the
radius agree up to a small number of bits in at least one segment (pigeonhole), so it is enough to
enumerate the small Hamming ball around every segment value, fetch the table entries of each value
in it, and verify complete distances.  A pair counts only in the first segment that finds it, hence
once.  Tables and probes of a segment value meet in one cell; a bucket of more than ``CHUNK`` rows is
split, both its entries and its probes dealt into chunks, and every pair of chunks is a cell.  Tasks
get their cells sorted and take them a block at a time, so their memory does not grow with the input;
their number follows that of the entries.  They return per fingerprint a number of links and one edge,
never the pairs.

Nulls and empty texts have fingerprint zero and link like any other; texts of any length are read
whole; an empty table gives an empty result; repeated rows and ids count as further members of their
fingerprint; other columns are not read by ``report`` and carried along by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, lookup, materialise, release

RADIUS = 6
SEED = 42


def fingerprint(raw: bytes) -> int:
    """64-bit SimHash of a text's UTF-8 bytes."""
    words = raw.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if len(words) == 1:
        return h(words[0], SEED)
    hashes = np.array([h(a + b" " + b, SEED) for a, b in zip(words, words[1:])], dtype="<u8")
    return fold(hashes)


def fold(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(text: str, extra: list[str]):
    def run(batches):
        for b in batches:
            raw = byte_values(b.column(b.schema.get_field_index(text)))
            fps = np.array([fingerprint(x) for x in raw], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in extra], pa.array(fps, pa.int64())], names=[*extra, "__fp"])

    return run


def with_fingerprint(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the fingerprint as a signed long ``__fp``."""
    source = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "__fp long"])
    return source.mapInArrow(_fingerprints(text, keep), schema)


class Scheme:
    """Segments of a 64-bit fingerprint with a ball radius for each.

    With r = a * m + b, one of the first b + 1 segments differs in at most a bits or one of the
    others in at most a - 1; else the distances would add up to more than r.  Segments are made about
    as wide as the binary logarithm of the table, which keeps buckets at a few entries at any size.
    """

    def __init__(self, entries: int, radius: int = RADIUS) -> None:
        self.radius = radius
        self.m = max(2, min(radius + 1, 64 // max(9, entries.bit_length() - 2)))
        widths = [64 // self.m + (i < 64 % self.m) for i in range(self.m)]
        starts = [sum(widths[:i]) for i in range(self.m)]
        a, b = divmod(radius, self.m)
        self.segments = [(starts[i], widths[i], a if i <= b else a - 1) for i in range(self.m)]
        self.segments = [s for s in self.segments if s[2] >= 0]

    def value(self, fps: np.ndarray, segment: int) -> np.ndarray:
        start, width, _ = self.segments[segment]
        return (fps >> np.uint64(start)) & np.uint64((1 << width) - 1)

    def ball(self, segment: int) -> np.ndarray:
        """Masks of the Hamming ball of the segment, zero first."""
        _, width, radius = self.segments[segment]
        masks, layer = [0], [(0, -1)]
        for _ in range(radius):
            layer = [(m | 1 << i, i) for m, last in layer for i in range(last + 1, width)]
            masks += [m for m, _ in layer]
        return np.array(masks, np.uint64)

    def first(self, xored: np.ndarray, segment: int) -> np.ndarray:
        """Whether no earlier segment finds the pair with this difference."""
        ok = np.ones(len(xored), bool)
        for s in range(segment):
            ok &= np.bitwise_count(self.value(xored, s)) > self.segments[s][2]
        return ok


def _entries(scheme: Scheme):
    """Table entries and probes by segment value, two arrays at a time.

    The relation is symmetric, so of a pair of different segment values only the smaller probes.
    """

    def run(batches):
        for b in batches:
            fps = b.column(0).to_numpy().view(np.uint64)
            ns = b.column(1).to_numpy()
            for s in range(len(scheme.segments)):
                value = scheme.value(fps, s)
                yield from _pack(s, value, fps, ns, False)
                for mask in scheme.ball(s)[1:]:
                    other = value ^ mask
                    up = other > value
                    if up.any():
                        yield from _pack(s, other[up], fps[up], ns[up], True)

    return run


def _pack(segment: int, value: np.ndarray, fps: np.ndarray, ns: np.ndarray, probe: bool):
    n = len(value)
    if n:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, segment, np.int32)),
                pa.array(value.view(np.int64)),
                pa.array(np.full(n, probe)),
                pa.array(fps.view(np.int64)),
                pa.array(ns),
            ],
            names=["seg", "value", "probe", "fp", "n"],
        )


LINKS = "fp long, near long, root long"
_LINKS = pa.schema([("fp", pa.int64()), ("near", pa.int64()), ("root", pa.int64())])
#: Pairs verified at once; bounds the memory of a task.
BLOCK = 1 << 20
#: Entries and probes of one bucket that one task takes; a larger bucket becomes a grid of tasks.
CHUNK = 1 << 15
#: Rows of whole cells matched at once, linked fingerprints held before they are passed on, and rows of a task.
ROWS, HELD_LINKS, TASK_ROWS = 1 << 18, 500_000, 4_000_000
#: A cell is value, left chunk and right chunk in 32, 15 and 15 bits.
_CHUNKS, _SHIFT_I = np.uint64(1 << 15), np.uint64(15)


class _Links:
    """Per task: links per fingerprint, and a union-find over the linked ones."""

    def __init__(self) -> None:
        self.near: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        up = parent.setdefault(x, x)
        while up != parent[up]:
            parent[up] = parent[parent[up]]
            up = parent[up]
        parent[x] = up
        return up

    def add(self, a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> None:
        both = np.concatenate([a, b])
        keys, inverse = np.unique(both, return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, np.concatenate([nb, na]))
        for k, v in zip(keys.tolist(), sums.tolist()):
            self.near[k] = self.near.get(k, 0) + v
        for x, y in zip(a.tolist(), b.tolist()):
            rx, ry = self.root(x), self.root(y)
            if rx != ry:
                self.parent[max(rx, ry)] = min(rx, ry)

    def rows(self):
        keys = list(self.near)
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(part, np.uint64).view(np.int64)),
                    pa.array([self.near[k] for k in part], pa.int64()),
                    pa.array(np.array([self.root(k) for k in part], np.uint64).view(np.int64)),
                ],
                schema=_LINKS,
            )


def _pairs(sizes_a: np.ndarray, sizes_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray):
    """Index pairs of the products of matching runs, in blocks of about BLOCK."""
    products = sizes_a * sizes_b
    edges = np.concatenate([[0], np.cumsum(products)])
    total = int(edges[-1])
    for low in range(0, total, BLOCK):
        flat = np.arange(low, min(total, low + BLOCK))
        run = np.searchsorted(edges, flat, side="right") - 1
        within = flat - edges[run]
        yield start_a[run] + within // sizes_b[run], start_b[run] + within % sizes_b[run]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and values of the runs of a sorted array."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(keys)]])), keys[starts]


def _verify(links: _Links, scheme: Scheme, s: int, fa, na, ia, fb, nb, ib, within: bool) -> None:
    if within:
        upper = fa[ia] < fb[ib]
        ia, ib = ia[upper], ib[upper]
    x = fa[ia] ^ fb[ib]
    ok = np.bitwise_count(x) <= scheme.radius
    if not ok.any():
        return
    ia, ib, x = ia[ok], ib[ok], x[ok]
    ok = scheme.first(x, s)
    ia, ib = ia[ok], ib[ok]
    if len(ia):
        links.add(fa[ia], fb[ib], na[ia], nb[ib])


def match(links: _Links, scheme: Scheme, s: int, cell, right, fps, ns) -> None:
    """All links of one segment among the table entries (left) and the entries that meet them (right)."""
    t, p = ~right, right
    order = np.lexsort((fps[t], cell[t]))
    tv, tf, tn = cell[t][order], fps[t][order], ns[t][order]
    starts, sizes, keys = _runs(tv)
    own = (keys >> _SHIFT_I) % _CHUNKS == keys % _CHUNKS
    for ia, ib in _pairs(sizes[own], sizes[own], starts[own], starts[own]):
        _verify(links, scheme, s, tf, tn, ia, tf, tn, ib, True)
    order = np.argsort(cell[p], kind="stable")
    pv, pf, pn = cell[p][order], fps[p][order], ns[p][order]
    pstarts, psizes, pkeys = _runs(pv)
    _, at, pat = np.intersect1d(keys, pkeys, assume_unique=True, return_indices=True)
    for ia, ib in _pairs(sizes[at], psizes[pat], starts[at], pstarts[pat]):
        _verify(links, scheme, s, tf, tn, ia, pf, pn, ib, False)


class _Held:
    """Rows of whole cells, of which the last may still be coming in."""

    def __init__(self) -> None:
        self.parts: list[pa.RecordBatch] = []
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.rows += batch.num_rows

    def take(self, whole: bool) -> tuple[np.ndarray, ...] | None:
        """All rows held, or all but those of the last cell; None where there are none."""
        if not self.rows:
            return None
        table = pa.Table.from_batches(self.parts)
        seg, cell = table["seg"].to_numpy(), table["cell"].to_numpy()
        size = len(seg) if whole else int(np.flatnonzero((seg != seg[-1]) | (cell != cell[-1])).max(initial=-1)) + 1
        columns = (seg, cell.view(np.uint64), table["right"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["n"].to_numpy())
        self.parts = table.slice(size).combine_chunks().to_batches()
        self.rows = len(seg) - size
        return tuple(c[:size] for c in columns) if size else None


def _match_partition(scheme: Scheme):
    """Rows come sorted by segment and cell; they are matched in blocks of whole cells."""

    def run(batches):
        links, held, want = _Links(), _Held(), ROWS

        def work(whole: bool):
            got = held.take(whole)
            if got is not None:
                seg, cell, right, fps, ns = got
                for s in np.unique(seg).tolist():
                    own = seg == s
                    match(links, scheme, s, cell[own], right[own], fps[own], ns[own])

        for b in batches:
            if b.num_rows:
                held.add(b)
            if held.rows >= want:
                work(False)
                want = held.rows + ROWS  # what is left of a cell stays until the cell is complete
                if len(links.near) > HELD_LINKS:
                    yield from links.rows()
                    links = _Links()
        work(True)
        yield from links.rows()
        release()

    return run


def links_of(table: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """From distinct (fp, n): per linked fp the number of rows it links to, and edges (fp, root).

    Sizes of buckets are counted first, by a pass of its own over the enumeration, which is several times
    larger than the table it comes from and not worth storing.
    """
    spark = table.sparkSession
    entries = table.count()
    scheme = Scheme(entries, radius)
    each = table.mapInArrow(_entries(scheme), "seg int, value long, probe boolean, fp long, n long")
    sizes = each.groupBy("seg", "value").count().where(F.col("count") > chunk)
    grids = materialise(sizes.select("seg", "value", F.least(F.ceil(F.col("count") / chunk), F.lit(1 << 15)).cast("int").alias("g")))
    found = _with_grid(each, grids).withColumn("g", F.coalesce("g", F.lit(1)))
    i = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
    every = F.sequence(F.lit(0), F.col("g") - 1)
    as_left = F.transform(every, lambda j: F.struct(i.alias("i"), j.alias("j"), F.lit(False).alias("right")))
    as_right = F.transform(every, lambda k: F.struct(k.alias("i"), i.alias("j"), F.lit(True).alias("right")))
    places = F.when(F.col("probe"), as_right).otherwise(F.concat(as_left, F.filter(as_right, lambda x: x["i"] < x["j"])))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("probe").alias("right")))
    placed = found.select("seg", "value", "fp", "n", F.explode(F.when(F.col("g") == 1, one).otherwise(places)).alias("p"))
    cell = F.shiftleft("value", 30) + F.col("p.i") * (1 << 15) + F.col("p.j")
    cells = placed.select("seg", cell.alias("cell"), F.col("p.right").alias("right"), "fp", "n")
    probes = sum(len(scheme.ball(s)) + 1 for s in range(len(scheme.segments))) // 2
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries * probes // TASK_ROWS)
    return cells.repartition(tasks, "seg", "cell").sortWithinPartitions("seg", "cell").mapInArrow(_match_partition(scheme), LINKS)


def _with_grid(each: DataFrame, grids: DataFrame, most: int = 100_000) -> DataFrame:
    """``each`` with the grid of its bucket, null for small ones: broadcast while there are few grids, else
    a shuffled join in which every grid stands once per salt, so that no large bucket meets in one task."""
    if grids.count() <= most:
        return each.join(F.broadcast(grids), ["seg", "value"], "left")
    salts = 64
    salted = grids.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(salted, ["seg", "value", "salt"], "left").drop("salt")


def components(edges: DataFrame, a: str = "fp", b: str = "root") -> DataFrame:
    """(node, root) with the smallest node of each connected component, by alternating stars.

    Large-star and small-star steps (Kiveris et al., 2014) halve the distance to the smallest node
    each time; edges stay at most as many as they were.  Ends when a round changes nothing.  The
    neighbours of a node are combined by minimum, never collected.
    """
    now = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
        large = lookup(both, least, "u", "d", F.col("v"), 2 * state[0])
        large = large.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = lookup(large, least, "u", "d", F.col("v"), state[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = materialise(small.where(F.col("u") != F.col("v")).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Number and two order-free hashes of the edges."""
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(7)))).first()
    return tuple(x or 0 for x in row)


def clusters(prints: DataFrame, id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per distinct ``__fp``: n (rows), near (rows it links to elsewhere), component_id (least id), root (its component's least ``__fp``)."""
    table = materialise(prints.groupBy("__fp").agg(F.count("*").alias("n"), F.min(id_).alias("least")))
    links = materialise(links_of(table.select(F.col("__fp").alias("fp"), "n"), radius))
    near = links.groupBy("fp").agg(F.sum("near").alias("near"))
    rooted = components(links)
    joined = (
        table.join(near, table["__fp"] == near["fp"], "left")
        .join(rooted, F.col("__fp") == F.col("node"), "left")
        .select("__fp", "n", "least", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "__fp").alias("root"))
    )
    joined = materialise(joined)
    linked = joined.where(F.col("near") > 0)
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    return lookup(joined, ids, "root", "members", F.col("__fp"), total=None).select(
        "__fp", "n", "near", F.coalesce("component_id", "least").alias("component_id"), "root"
    )


def report(docs: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Per document: id, fingerprint (16 hex digits), n_near, component_id."""
    prints = materialise(with_fingerprint(docs, text, [id_]))
    found = lookup(prints, clusters(prints, id_, radius), "__fp", "n", F.col(id_))
    return found.select(
        id_,
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        (F.col("near") + F.col("n") - 1).alias("n_near"),
        "component_id",
    )


def dedup(docs: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One document of each component: its smallest id; of rows equal in that, the first by their other columns.

    Documents whose component has no other row stay as they are, also with a null id.  Columns of any
    name and type are carried along; those without an order have no say in ties.
    """
    slots = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, slots))
    keyed = docs.toDF(*slots)
    id_, text = at[id_], at[text]
    keyed = keyed.withColumn("row", F.concat_ws(":", F.coalesce(F.col(id_).cast("string"), F.lit("null")), F.xxhash64(text), F.hash(text)))
    prints = materialise(with_fingerprint(keyed, text, [id_, "row"]))
    found = lookup(prints, clusters(prints, id_, radius), "__fp", "n", F.col("row"))
    alone = (F.col("n") == 1) & (F.col("near") == 0)
    stays = alone | F.col(id_).eqNullSafe(F.col("component_id"))
    rows = found.select("row", alone.alias("alone"), stays.alias("stays"), F.col("root").alias("root")).groupBy("row")
    rows = materialise(rows.agg(F.count("*").alias("rows"), *[F.first(c).alias(c) for c in ("alone", "stays", "root")]))
    kept = lookup(keyed, rows, "row", "rows", F.rand(SEED)).where("stays")
    single = kept.where("alone").select(*slots)
    ordered = [s for s, kind in keyed.dtypes if s in slots and "map<" not in kind and kind != "variant"]
    chosen = kept.where("not alone").groupBy("root").agg(F.min_by(F.struct(*slots), F.struct(*ordered)).alias("one"))
    return single.unionByName(chosen.select("one.*")).toDF(*docs.columns)
