"""The ten operators: against brute force, SQL or the public library, and over odd tables."""

from __future__ import annotations

import collections
import gzip
import hashlib
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from conftest import agree
from pyspark.sql import functions as F

from emberlog.llm import arc_warc, chat_format, exact_dedup, line_crf, mixing, quality_fm, queries, simhash, sp_wfst, token_count, toxicity
from emberlog.llm.common import lookup, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
VOCAB = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use themselves.
CLASHES = ["size", "key", "k", "c", "n", "id", "row", "rows", "score", "digest", "copies", "__i", "__t", "__n", "__score", "__k", "__fp", "__rows", "__copies", "__hk", "k0", "c0", "u", "q", "p", "bin", "tie", "digits", "root", "chars"]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and very long texts, ties, repeated rows and clashing extra columns."""
    long = "word " * 60_000 + "é" * 5000
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "", "en", "a", None), (4, long, None, "b", 5), (5, "Same text here", "en", "b", 14), (6, "same TEXT here", "en", None, 14),
        (6, "same TEXT here", "en", None, 14), (None, "no id", "en", "c", 5), (None, "no id", "en", "c", 5), (7, "ÄÖ ünï 漢字 🙂\n\n x", "de", "é", 12), (8, " \t\n ", "en", "Z", 4), (9, "one", "en", "a", 3), (10, "|" * 300, "", "", -1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)}).cache()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def empty(df):
    return df.where(F.lit(False))


# lookup


def test_lookup_spreads_hot_keys(spark):
    left = spark.range(4000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") == 1, None).otherwise(F.col("id").cast("string")).alias("key"))
    right = left.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = {r["id"]: (r["n"], r["least"]) for r in lookup(left, right, "key", "n", F.col("id")).collect()}
    assert got[0] == got[3999] == (1334, 0) and got[1] == (None, None) and got[2] == (1, 2) and len(got) == 4000


def test_materialise_keeps_rows(spark):
    assert materialise(spark.range(5)).count() == 5


# 1


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    alphabet = "aab  \n\tÀé漢字🙂\x00▁.,!thein  <s>0x'"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*made, "", " ", "   x  ", "a" * 70, "<s></s><0x0A><unk>", "the quick brown fox", "l'été d'où ☃"]


def test_paths_equal_the_library(docs):
    import sentencepiece

    sp, t = sentencepiece.SentencePieceProcessor(model_file=MODEL), sp_wfst.Transducer(MODEL)
    known = [*texts(1, 800), *(r["text"] or "" for r in docs.select("text").collect()), "a" * 3000, "ab" * 500, " ▁ ▁ ", "x" + " " * 40]
    for text, ids in zip(known, t.encode(known)):
        ids = np.frombuffer(ids, np.int32)
        assert ids.tolist() == sp.encode(text)
        assert t.decode(ids) == sp.decode(ids.tolist())


def test_shortest_paths_are_merge_results():
    """The compiled weights against merging by definition, for small models with ties and unreachable pieces."""
    rng, compiled = random.Random(8), 0
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(2, 6))) for _ in range(14)}, key=lambda p: (len(p), rng.random()))
        pieces = ["<unk>", *(p for p in pieces)] + ["a", "b"]
        scores = [0.0, *(-float(k // rng.choice([1, 2])) for k in range(1, len(pieces) - 2)), -90.0, -91.0]
        model = {"pieces": pieces, "scores": scores, "kinds": [2] + [1] * (len(pieces) - 1), "bpe": True, "byte_fallback": False, "prefix": False, "extra_space": False, "escape": True, "charsmap": b"", "suffix": False}
        try:
            t = sp_wfst.Transducer(model)
        except ValueError:  # a piece above its parts
            continue
        for _ in range(40):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
            assert t.path(text) == t.merge(text), (pieces, scores, text)
        compiled += 1
    assert compiled > 20


def test_decoding_of_any_ids():
    import sentencepiece

    sp, t, rng = sentencepiece.SentencePieceProcessor(model_file=MODEL), sp_wfst.Transducer(MODEL), random.Random(4)
    for _ in range(500):
        ids = [rng.choice([3 + rng.randrange(256), rng.randrange(259, 3000)]) for _ in range(rng.randrange(12))]
        assert t.decode(np.array(ids, np.int32)) == sp.decode(ids)


def test_tropical_path_of_scores():
    """The best sum of scores, against all segmentations."""
    scores = {"a": -3.0, "b": -3.5, "ab": -4.0, "ba": -3.2, "aba": -8.0, "c": -2.0}
    t = sp_wfst.Transducer({"pieces": ["<unk>", *scores], "scores": [0.0, *scores.values()], "kinds": [2] + [1] * 6, "bpe": False, "byte_fallback": False, "prefix": False, "extra_space": False, "escape": True, "charsmap": b"", "suffix": False})

    def best(s):
        return 0.0 if not s else min((-scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=np.inf)

    for s in ("a", "ab", "aba", "ababa", "bab", "cabac", "bbaab"):
        path = t.path(s)
        assert "".join(path) == s
        assert sum(-scores[p] for p in path) == pytest.approx(best(s))


def test_encode_and_decode_tables(odd):
    coded = sp_wfst.encode(odd, MODEL, keep=["doc_id", "size"])
    got = coded.collect()
    assert len(got) == odd.count() and all(r["round_trip"] for r in got)
    back = sp_wfst.decode(coded, MODEL)
    assert rows_of(back, "doc_id", "text") == sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=str)
    assert sp_wfst.encode(empty(odd), MODEL).count() == 0


# 2


def shares(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(w[s] for s in open_)
        full = {s for s in open_ if unit * w[s] >= cap * sizes[s]}
        if not full:
            return out | {s: unit * w[s] for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    sized = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    sizes = collections.Counter()
    for _, s, n in sized:
        sizes[s] += n
    want = shares(sizes)
    got = [r.asDict() for r in mixing.mix(df.withColumn("src", F.col("source")), extra=["src"]).collect()]
    assert len(got) == len(sized)
    assert collections.Counter((r["doc_id"], r["src"], r["size"]) for r in got) == collections.Counter(sized)
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["src"]] and r["target"] == pytest.approx(want[r["src"]])
        assert r["taken"] == r["copies"] * r["size"] and r["taken"] <= 2 * r["size"]
        taken[r["src"]] += r["taken"]
    for s, t in want.items():
        largest = max(n for _, x, n in sized if x == s)
        assert abs(taken[s] - t) <= largest
    if which == "docs":
        assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
        again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix(df.repartition(7)).collect())
        assert again == sorted((r["doc_id"], r["taken"]) for r in got)


def test_mix_sql(spark, sf_dir):
    agree(queries.op2_mix_sources(spark, sf_dir), sf_dir, queries.ORACLE_SQL["op2_mix_sources"])


def test_resample(odd):
    assert mixing.mix(empty(odd)).count() == 0 and mixing.resample(empty(odd)).count() == 0
    copies = collections.Counter()
    for r in mixing.mix(odd).collect():
        copies[r["doc_id"]] += r["copies"]
    made = mixing.resample(odd)
    assert made.columns == odd.columns
    assert collections.Counter(r["doc_id"] for r in made.collect()) == +copies


def test_rows_that_differ_in_one_column_stay(spark):
    """Equal id, text and source, but another language: none may stand for another."""
    rows = [(1, "a b c d", "x", "s"), (1, "a b c d", "y", "s"), (1, "a b c d", None, "s"), (2, "q r", "x", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("tags", F.create_map(F.lit("k"), F.col("lang")))
    made = collections.Counter((r["doc_id"], r["lang"]) for r in mixing.resample(df, share=2.0).collect())
    assert made == {(1, "x"): 2, (1, "y"): 2, (1, None): 2, (2, "x"): 2}


def test_inclusion_follows_size(spark):
    """Over many seeds a document is taken as often as its own probability says, which grows with its size."""
    sizes = [(i, 1 + (i * 37) % 250) for i in range(240)] + [(900, 5000)]
    df = spark.createDataFrame([(i, "w " * n, "s") for i, n in sizes], "doc_id long, text string, source string").cache()
    total = sum(n for _, n in sizes)
    # the measure, by definition: certain ones from the top until the factor leaves none at 1
    left, words, certain = 0.5 * total, collections.Counter(), set()
    while True:
        factor = (left - sum(n for _, n in sizes if n in certain)) / sum(n.bit_length() * n for _, n in sizes if n not in certain)
        over = {n for _, n in sizes if n not in certain and factor * n.bit_length() >= 1}
        if not over:
            break
        certain |= over
    want = {i: 1.0 if n in certain else factor * n.bit_length() for i, n in sizes}
    seeds = 8
    for seed in range(seeds):
        for r in mixing.mix(df, weights=(1,), share=0.5, seed=f"t{seed}").collect():
            assert r["p"] == pytest.approx(want[r["doc_id"]])
            words[r["doc_id"]] += r["copies"]
    assert len({round(p, 6) for p in want.values()}) > 5
    for low, high in ((1, 15), (16, 63), (64, 250)):
        group = [i for i, n in sizes if low <= n <= high]
        assert sum(words[i] for i in group) / (seeds * len(group)) == pytest.approx(sum(want[i] for i in group) / len(group), abs=0.07)


# 3


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    size = quality_fm.WORDS + quality_fm.STATS * quality_fm.BINS
    edges = [np.array([0.0, 1.0])] * quality_fm.STATS
    m = quality_fm.FactorisationMachine(edges, 0.3, rng.normal(size=size) * 0.1, rng.normal(size=(size, quality_fm.FACTORS)) * 0.1)
    stats, index, x = rng.normal(size=(1, quality_fm.STATS)), np.array([3, 50, 900], np.int32), np.array([0.5, 0.2, 0.8])
    flat, values = np.concatenate([index, m.bins(stats)[0]]), np.concatenate([x, np.ones(quality_fm.STATS)])
    z = m.w0 + m.w[flat] @ values + sum(m.v[flat[i]] @ m.v[flat[j]] * values[i] * values[j] for i in range(len(flat)) for j in range(i))
    assert m.score(stats, [(index, x)])[0] == pytest.approx(1 / (1 + np.exp(-z)))


@pytest.mark.parametrize("n", [1, 150, 399, 400, 20_000])
def test_capitals_are_counted_over_all_words(n):
    words = [b"LOUD" if i % 100 in (1, 2, 3) else b"calm" for i in range(n)]
    assert quality_fm.statistics(b" ".join(words), words, None)[16] == pytest.approx(words.count(b"LOUD") / n)
    assert quality_fm.statistics(b"A " * n, [b"A"] * n, None)[16] == 1.0


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_fm.classify(docs, labels).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)


def test_held_out_labels_are_not_read(docs, labels):
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rows_of(quality_fm.classify(docs, labels), "doc_id", "score") == rows_of(quality_fm.classify(docs, flipped), "doc_id", "score")


@pytest.mark.parametrize("module", [quality_fm, toxicity])
def test_classifiers_over_odd_tables(odd, docs, labels, module):
    both = odd.select(docs.columns).unionByName(docs)
    got = module.classify(both, labels)
    assert got.count() == both.count() and got.where("score is null or isnan(score) or score not between 0 and 1").count() == 0
    assert {r["score"] for r in module.classify(odd, empty(labels)).collect()} == {0.5}
    assert module.classify(empty(docs), labels).count() == 0
    strange = labels.unionByName(labels.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic")))
    assert module.classify(docs, strange.union(strange)).count() == docs.count()


def test_keep_good_keeps_columns(odd, docs, labels):
    kept = quality_fm.keep_good(odd.unionByName(docs, allowMissingColumns=True), labels)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count() + docs.count()


# 4


def base(text: str | None) -> tuple:
    text = text or ""
    words, seen, again = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    counts = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_base_counts(request, labels, which):
    df = request.getfixturevalue(which)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted(((r["doc_id"], *base(r["text"])) for r in df.collect()), key=str)
    got = line_crf.judge(df, line_crf.train(df, labels))
    assert rows_of(got, "doc_id", *names) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert line_crf.judge(empty(df), None).count() == 0


def test_viterbi_is_the_best_sequence():
    import itertools

    rng = np.random.default_rng(2)
    field = line_crf.Field(rng.normal(size=line_crf.FEATURES * line_crf.WIDTH), rng.normal(size=(2, 2)), rng.normal(size=2))
    sizes = [1, 4, 7, 2]
    f = rng.integers(0, line_crf.WIDTH, (sum(sizes), line_crf.FEATURES)) + np.arange(line_crf.FEATURES) * line_crf.WIDTH
    first = np.concatenate([[0], np.cumsum(sizes)])
    got = field.decode(f, first)
    gain = field.w[f].sum(axis=1)
    for a, b in zip(first, first[1:]):
        def total(s):
            return field.start[s[0]] + sum(gain[a + i] * x for i, x in enumerate(s)) + sum(field.t[x, y] for x, y in zip(s, s[1:]))

        assert total(tuple(got[a:b].astype(int))) == pytest.approx(max(map(total, itertools.product((0, 1), repeat=b - a))))


def test_expectations_by_enumeration():
    """Normaliser, line and transition probabilities against all label sequences; their gradient numerically."""
    import itertools

    rng = np.random.default_rng(5)
    t, start, sizes = rng.normal(size=(2, 2)), rng.normal(size=2), [1, 3, 5]
    e = rng.normal(size=(3, 6, 2))
    real = np.arange(6) < np.array(sizes)[:, None]
    z, content, pairs = line_crf.expectations(e, t, start, real)
    for k, n in enumerate(sizes):
        every = list(itertools.product((0, 1), repeat=n))
        total = np.array([start[s[0]] + sum(e[k, i, x] for i, x in enumerate(s)) + sum(t[a, b] for a, b in zip(s, s[1:])) for s in every])
        p = np.exp(total - np.logaddexp.reduce(total))
        assert z[k] == pytest.approx(np.logaddexp.reduce(total))
        for i in range(6):
            assert content[k, i] == pytest.approx(sum(q for q, s in zip(p, every) if i < n and s[i] == 1))
        for i, a, b in itertools.product(range(5), (0, 1), (0, 1)):
            assert pairs[k, i, a, b] == pytest.approx(sum(q for q, s in zip(p, every) if i + 1 < n and s[i] == a and s[i + 1] == b))
    # the log likelihood's gradient is the given counts less the expected ones, so z's is the expected ones
    step = np.zeros((2, 2))
    step[0, 1] = 1e-6
    up, down = line_crf.expectations(e, t + step, start, real)[0].sum(), line_crf.expectations(e, t - step, start, real)[0].sum()
    assert (up - down) / 2e-6 == pytest.approx(pairs.sum(axis=(0, 1))[0, 1], rel=1e-5)


def test_lines_of_a_document_get_labels_of_their_own():
    """Documents of label 0 that hold a few lines as those of label 1 do: only the others become boilerplate."""
    rng, offsets = np.random.default_rng(1), np.arange(line_crf.FEATURES) * line_crf.WIDTH

    def lines(kinds):
        f = rng.integers(0, 3, (len(kinds), line_crf.FEATURES))
        f[:, 0] = np.where(np.array(kinds) == 1, rng.integers(0, 4, len(kinds)), rng.integers(3, 7, len(kinds)))
        return (f + offsets).astype(np.int16), np.full(len(kinds), 10)

    plain = [[1] * 6 for _ in range(60)]
    mixed = [[0, 0, 1, 0, 0, 0, 1, 0] for _ in range(40)]
    field = line_crf.fit([(*lines(k), 1) for k in plain] + [(*lines(k), 0) for k in mixed])
    marks, truth = [], []
    for k in mixed[:20]:
        f, _ = lines(k)
        marks += field.decode(f.astype(np.int64), np.array([0, len(k)])).astype(int).tolist()
        truth += k
    marks, truth = np.array(marks), np.array(truth)
    assert marks[truth == 0].mean() < 0.35 and marks[truth == 1].mean() > 0.7  # one bin in four is of both


def test_field_separates_labels(docs, labels):
    judged = line_crf.judge(docs, line_crf.train(docs, labels)).join(labels, "doc_id").where("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in judged]) > 0.95
    lines = line_crf.mark_lines(docs, line_crf.train(docs, labels))
    bad = lines.join(labels.where("quality = 0"), "doc_id").where("length(trim(line_text)) > 0").groupBy("doc_id").agg(F.avg(F.col("content").cast("int")).alias("m"), F.count("*").alias("n"))
    shares = [r["m"] for r in bad.where("n > 1").collect()]
    assert np.mean([0 < m < 1 for m in shares]) > 0.2
    assert lines.count() == sum((r["text"] or "").count("\n") + 1 for r in docs.collect())


# 5


def test_exact_dedup_sql(spark, sf_dir):
    agree(queries.op5_exact_dedup(spark, sf_dir), sf_dir, queries.ORACLE_SQL["op5_exact_dedup"])


def test_exact_dedup_odd(odd):
    got = exact_dedup.report(odd)
    assert got.count() == odd.count()
    by = collections.defaultdict(list)
    for r in odd.collect():
        by[(r["text"] or "").encode().lower()].append(r["doc_id"])
    want = {hashlib.sha256(t).hexdigest(): (len(ids), max((i for i in ids if i is not None), default=None)) for t, ids in by.items()}
    assert {r["text_sha256"]: (r["group_size"], r["keep_id"]) for r in got.collect()} == want
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == sorted(map(str, (v[1] for v in want.values())))
    assert exact_dedup.report(empty(odd)).count() == exact_dedup.dedup(empty(odd)).count() == 0


@pytest.mark.parametrize("memory", [1, 3000, 1 << 20])
def test_grace_recursion(memory):
    rng = random.Random(1)
    records = [(rng.choice([b"hot", b"w%d" % rng.randrange(300)]), 1, i, None) for i in range(3000)]
    want = {}
    for c, n, i, _ in records:
        have = want.get(c, (0, -1))
        want[c] = (have[0] + n, max(have[1], i))
    assert {c: (n, i) for c, n, i, _ in exact_dedup.grace(iter(records), memory)} == want


# 6


def test_chat_sql(spark, sf_dir):
    agree(queries.op6_chat_format(spark, sf_dir), sf_dir, queries.ORACLE_SQL["op6_chat_format"])


def test_chat_escapes_and_merges(spark):
    rng = random.Random(8)
    parts = ["<|", "|>", "\\", "|", "<", ">", "end", "\n", "turn ", "next", "é🙂", "$1", "</s>[INST]"]
    made = [(c, t, rng.choice(["user", "assistant", None, "x|>y<|"]), rng.choice([None, "".join(rng.choice(parts) for _ in range(rng.randrange(9)))])) for c in range(40) for t in range(rng.randrange(1, 7))]
    made += [(1, 0, "user", "tie"), (1, 0, "user", "tie"), (None, None, "assistant", "z")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    want = collections.defaultdict(list)
    for c, t, r, x in made:
        want[c].append((-1 if t is None else t, r or "", x or ""))
    made_ = {r["conv_id"]: r for r in chat_format.format_conversations(df).collect()}
    for r in chat_format.read_back(chat_format.format_conversations(df)).collect():
        turns = sorted(want[r["conv_id"]])
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(b, x) for _, b, x in turns]
        assert r["loss_text"] == "".join(x for _, b, x in turns if b == "assistant")
        f = made_[r["conv_id"]]
        blocks = 1 + sum(a[1] != b[1] for a, b in zip(turns, turns[1:]))
        assert f["formatted"].count(chat_format.END) == blocks
    assert chat_format.digest(empty(df)).count() == 0


def test_long_conversations(spark):
    """More turns than a block of spans holds; the mask against walking through the output."""
    rows = [(5, i, "assistant" if i % 3 else "user", "x|>" * (i % 5)) for i in range(3 * chat_format.BLOCK + 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    made = chat_format.format_conversations(df).collect()[0]
    said = [r[3].replace("|>", "|\\>") for r in rows if r[2] == "assistant"]
    assert [made["formatted"][s["start"] - 1 : s["start"] - 1 + s["length"]] for s in made["loss_spans"]] == said


# 7


def solved(graph: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Visiting rates of the walk with restart from the linear equations; lost mass restarts."""
    out = graph.sum(axis=1)
    step = np.divide(graph, out[:, None], out=np.zeros_like(graph), where=out[:, None] > 0)
    lost = (out == 0).astype(float)
    keep = 1 - toxicity.RESTART
    matrix = keep * step + np.outer(1 - keep * (1 - lost), starts)
    a = np.vstack([matrix.T - np.eye(len(graph)), np.ones(len(graph))])
    return np.linalg.lstsq(a, np.append(np.zeros(len(graph)), 1.0), rcond=None)[0]


def test_cooccurrence_counts(spark):
    texts = ["a b c a", "c, A. b!", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    index = {"a": 0, "b": 1, "c": 2}
    together, single = toxicity.cooccurrence(df, index)
    want = np.zeros((3, 3))
    for t in texts:
        ids = [index[w] for w in re.findall(r"\w+", (t or "").lower())]
        for i, x in enumerate(ids):
            for y in ids[i + 1 : i + 1 + toxicity.WINDOW]:
                want[x, y] += 1
                if x != y:
                    want[y, x] += 1
    assert (together == want).all() and single.tolist() == [3, 2, 2]


def test_pair_counts_hold_little():
    """Counting and merging pairs: right counts, and at most so many bytes at once for a byte of text and for a pair."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(3000)]
    nodes = toxicity.Nodes(np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64))
    drawn = (3000 * rng.random((400, 1000)) ** 2).astype(np.int64)
    texts = pa.array([" ".join(names[i] for i in row) for row in drawn.tolist()], pa.string())

    def peak(function, batches):
        tracemalloc.start()
        made = [r for b in function(batches) for r in b.to_pylist()]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return made, most

    blobs, counting = peak(toxicity._pairs(nodes, 4), [pa.RecordBatch.from_arrays([texts], names=["text"])])
    sent = [b for b in blobs for _ in range(6)]  # as if six tasks had counted the same
    merged, merging = peak(toxicity._merged(4), [pa.RecordBatch.from_pylist(sent, pa.schema([("bucket", pa.int32()), ("pairs", pa.binary())]))])
    want = np.zeros((3000, 3000), np.int64)
    for k in range(1, toxicity.WINDOW + 1):
        np.add.at(want, (np.minimum(drawn[:, k:], drawn[:, :-k]), np.maximum(drawn[:, k:], drawn[:, :-k])), 1)
    got = np.zeros_like(want)
    for r in merged:
        x, y, n = toxicity.unpack(r["pairs"], r["bucket"], 4)
        got[x, y] = n
    assert (got == 6 * want).all()
    pairs = sum(int.from_bytes(b["pairs"][:8], "little") for b in sent) / 4
    assert counting < 33 * texts.nbytes and merging < 45 * pairs


def test_walks_solve_the_linear_equations(spark):
    """Weights, walks and polarities against counting pairs by hand and a linear solve, on a graph with a lone node."""
    rng = random.Random(3)
    names = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choice(names[:11]) for _ in range(9)) for _ in range(40)] + ["w11", "w11"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    together, single = np.zeros((12, 12)), np.zeros(12)
    for t in texts:
        ids = [int(w[1:]) for w in t.split()]
        for i, x in enumerate(ids):
            single[x] += 1
            for y in ids[i + 1 : i + 1 + toxicity.WINDOW]:
                together[x, y] += 1
                together[y, x] += x != y
    share = single / single.sum()
    graph = np.array([[max(0.0, np.log(together[i, j] / together.sum() / (share[i] * share[j]))) if together[i, j] else 0.0 for j in range(12)] for i in range(12)])
    nodes = toxicity.Nodes(np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64))
    starts = np.zeros((2, 12))
    starts[0, 1] = starts[1, [4, 5]] = 1
    starts /= starts.sum(axis=1, keepdims=True)
    up, down = toxicity.walks(toxicity.pair_table(df, nodes, 3), single, 3, starts, settled=1e-6)
    want = solved(graph, starts[0]), solved(graph, starts[1])
    assert np.abs(up - want[0]).max() < 1e-4 and np.abs(down - want[1]).max() < 1e-4
    floor = toxicity.FLOOR / 12
    by_hand = [0.0 if a + b < 1e-9 else np.log((a + floor) / (b + floor)) for a, b in zip(*want)]
    assert np.abs(toxicity.polarities(up, down) - by_hand).max() < 1e-3 and by_hand[11] == 0.0


def test_scores_by_hand():
    """A document's score from its words' polarities, written out."""
    names = ["vile", "nasty", "kind", "calm", "rotten", "mean", "ugly"]
    polarity = np.array([1.5, 0.9, -1.0, 0.0, 2.0, 1.1, 0.3])
    lexicon = toxicity.Lexicon(toxicity.Nodes(np.array([xxhash.xxh3_64_intdigest(w) for w in names], np.uint64)), polarity)
    model = np.array([-2.0, 1.0, 0.8, 0.6, 0.4, 0.5, 0.3])
    lexicon.fitted(1.0, model)
    for text in ("", None, "Vile, VILE kind words", "vile nasty rotten mean ugly calm day " * 3, "calm"):
        words = set(re.findall(r"\w+", (text or "").lower()))
        held = sorted((1 / (1 + np.exp(-8 * (polarity[names.index(w)] - 1.0))) for w in words if w in names and polarity[names.index(w)] > 0), reverse=True)
        x = [1.0, *(held + [0] * 4)[:4], np.log1p(sum(held)), min(5.0, 100 * sum(held) / max(len(words), 1))]
        assert lexicon.score([text or ""])[0] == pytest.approx(1 / (1 + np.exp(-np.dot(x, model))), rel=1e-5)


def test_seeds_by_hand():
    """Significant terms, then covering, then common terms that don't lean."""
    y = (np.arange(600) % 3 == 0).astype(int)
    has = [[i % 2 == 0, yi and i % 5 != 0, yi and i % 5 == 0 and i % 2 == 0, i % 7 == 0] for i, yi in enumerate(y)]
    rows = [np.flatnonzero(h).astype(np.int32) for h in has]
    toxic, neutral = toxicity.choose_seeds(rows, y, np.ones(600), 4)
    assert set(toxic) == {1, 2} and set(neutral) == {0, 3}


def test_unlabelled_documents_give_words_a_polarity(spark):
    """A word that no labelled document has, beside the seeds in unlabelled ones."""
    rng = random.Random(5)
    common = [f"common{i}" for i in range(60)]
    talk = lambda *more: " ".join(rng.sample([*rng.sample(common, 12), *more], 12 + len(more)))
    rows = [(i, talk("vile", "nasty") if i % 4 == 0 else talk()) for i in range(400)]
    rows += [(i, " ".join([*rng.sample(common, 3), "vile", "zorgle", "nasty", "zorgle", *rng.sample(common, 3)])) for i in range(400, 440)]
    rows += [(i, " ".join([*rng.sample(common, 4), "quibble", *rng.sample(common, 4)])) for i in range(440, 480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    polarity = {w: lexicon.polarity[lexicon.nodes[w]] for w in ("vile", "zorgle", "quibble")}
    assert polarity["zorgle"] > 0.4 > polarity["quibble"] and polarity["vile"] > 0.4


def test_toxicity_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r["predicted"] for r in rows if r["toxic"] == 1]
    clean = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) > 0.6 and np.mean(clean) < 0.05


# 8


def test_arc_versions():
    a = arc_warc.ArcRecord("http://x/", "1.2.3.4", "19970102030405", "text/html", b"<p>\n\nhi")
    b = a._replace(url="http://y/", payload=b"", status="404", checksum="abc")
    for version in (1, 2):
        data = arc_warc.version_block(version) + arc_warc.arc_record(a, version) + arc_warc.arc_record(b, version)
        got = list(arc_warc.parse_arc(data))
        assert [(r.url, r.date, r.payload) for r in got] == [(r.url, r.date, r.payload) for r in (a, b)]
        assert got[1].status == ("404" if version == 2 else "")
        with pytest.raises(arc_warc.ArchiveError):
            list(arc_warc.parse_arc(data.replace(b" 7\n", b" 99999\n")))
        packed = gzip.compress(arc_warc.version_block(version)) + gzip.compress(arc_warc.arc_record(a, version)) + gzip.compress(arc_warc.arc_record(b, version))
        assert list(arc_warc.parse_arc(packed)) == got and list(arc_warc.parse_arc(gzip.compress(data))) == got
    with pytest.raises(arc_warc.ArchiveError):
        list(arc_warc.parse_arc(arc_warc.arc_record(a, 1)))
    raw = arc_warc.warc_record(a, "5") + arc_warc.BREAK.encode()
    ((headers, block),) = arc_warc.parse_warc(raw)
    assert block == a.payload and headers["WARC-Date"] == "1997-01-02T03:04:05Z" and headers["WARC-Type"] == "resource" and headers["Content-Type"] == "text/html"
    with pytest.raises(arc_warc.ArchiveError):
        list(arc_warc.parse_warc(raw.replace(b"hi", b"ho")))
    assert arc_warc.iso_date("1997") == "1997-01-01T00:00:00Z"


def test_types_of_records():
    """HTTP responses with their head, revisits without a payload, and records of other schemes."""
    body = b"<p>\r\n\r\nhi"
    head = b"HTTP/1.0 404 Not Found\r\nServer: x\r\n\r\n"
    page = arc_warc.ArcRecord("http://x/", "1.2.3.4", "19970102030405", "text/html", head + body)
    dns = arc_warc.ArcRecord("dns:x", "1.2.3.4", "19970102030405", "text/dns", b"19970102030405\nx. 100 IN A 1.2.3.4\n")
    info = arc_warc.ArcRecord("filedesc://a.arc", "0.0.0.0", "19970102030405", "text/plain", b"1 0 Alexa Internet\nURL IP-address\n\n")
    made = [arc_warc.warc_record(page, "1"), arc_warc.warc_record(page, "2", "1"), arc_warc.warc_record(dns, "3"), arc_warc.warc_record(info, "0")]
    (a, x), (b, y), (c, z), (d, w) = arc_warc.parse_warc("".encode().join(m + arc_warc.BREAK.encode() for m in made))
    assert [h["WARC-Type"] for h in (a, b, c, d)] == ["response", "revisit", "resource", "warcinfo"]
    assert a["Content-Type"] == b["Content-Type"] == "application/http;msgtype=response" and c["Content-Type"] == "text/dns" and d["Content-Type"] == "application/warc-fields"
    digest = "sha1:" + arc_warc.sha1_base32(body)
    assert a["WARC-Payload-Digest"] == b["WARC-Payload-Digest"] == digest and a["WARC-Block-Digest"] == "sha1:" + arc_warc.sha1_base32(head + body)
    assert (x, y, z) == (head + body, head, dns.payload) and b"arc-version-block: 1 0 Alexa Internet\r\n" in w
    assert b["WARC-Refers-To"] == a["WARC-Record-ID"]


def test_archives_come_in_any_parts():
    """However a file is cut, records that end like a separator or hold one come back."""
    rng = random.Random(6)
    bodies = [b"", b"\r\n", b"a\r\n\r\n", b"\r\n\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x\r"]
    made = [arc_warc.warc_record(arc_warc.ArcRecord("http://x/", "0.0.0.0", "1997", "text/plain", x), str(i)) for i, x in enumerate(bodies)]
    file = b"".join(m + arc_warc.BREAK.encode() for m in made)
    for _ in range(50):
        cuts = sorted({0, len(file), *(rng.randrange(len(file)) for _ in range(30))})
        assert [x for _, x in arc_warc.parse_warc(file[i:j] for i, j in zip(cuts, cuts[1:]))] == bodies
    assert list(arc_warc.parse_warc(iter([]))) == []
    # as the text source hands it over: cut at separators, which are put back, also after the last part
    parts = file.split(arc_warc.BREAK.encode())
    parts = parts[:-1] if parts[-1] == b"" else parts
    assert [x for _, x in arc_warc.parse_warc(p + arc_warc.BREAK.encode() for p in parts)] == bodies


def test_convert_arc_files(spark, tmp_path):
    a = arc_warc.ArcRecord("http://x/", "1.2.3.4", "19970102030405", "text/html", b"WARC/1.1\r\n\r\n\r\n trap")
    h = a._replace(payload=b"HTTP/1.1 200 OK\r\n\r\n\xff\xfe\r\n")
    (tmp_path / "in").mkdir()
    data = arc_warc.version_block(2) + arc_warc.arc_record(a, 2) * 3 + arc_warc.arc_record(h, 2)
    (tmp_path / "in" / "one.arc").write_bytes(data)
    (tmp_path / "in" / "two.arc.gz").write_bytes(gzip.compress(data[:400]) + gzip.compress(data[400:]))
    (tmp_path / "in" / "none.arc").write_bytes(b"")
    arc_warc.convert_arc(spark.read.format("binaryFile").load(str(tmp_path / "in")), str(tmp_path / "out"))
    got = arc_warc.read_warc(spark, str(tmp_path / "out")).collect()
    assert collections.Counter((r["record_type"], bytes(r["payload"])) for r in got if r["record_type"] != "warcinfo") == {("resource", a.payload): 6, ("response", b"\xff\xfe\r\n"): 2}
    assert sum(r["record_type"] == "warcinfo" for r in got) == 2 and len(got) == 10


def test_archives_sql(spark, sf_dir):
    agree(queries.op8_arc_to_warc(spark, sf_dir), sf_dir, queries.ORACLE_SQL["op8_arc_to_warc"])


def test_archives_read_back(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").limit(40)
    more = spark.createDataFrame([(9001, "a b\n", None), (9002, None, ""), (9003, "u", "é" * 70_000), (9003, "u", "é" * 70_000), (None, "u", "lone")], "page_id long, url string, html string")
    pages = pages.union(pages.withColumn("page_id", F.col("page_id") + 5000)).union(more).withColumn("refers_to", F.lit(1)).cache()
    by = collections.defaultdict(list)
    for r in pages.collect():
        by[(r["html"] or "").encode()].append(r["page_id"])
    want = []
    for body, ids in by.items():
        least = min((i for i in ids if i is not None), default=None)
        want += [(i, len(body), arc_warc.sha1_base32(body), "response" if i == least or len(ids) == 1 else "revisit", None if i == least or len(ids) == 1 else least) for i in ids]
    got = arc_warc.archive_report(pages)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert arc_warc.archive_report(empty(pages)).count() == 0
    small = arc_warc.with_revisits(pages, least=10).where("refers_to is not null and length(html) < 10")
    assert small.count() == 0


# 9


@pytest.mark.parametrize("path", [VOCAB, MODEL])
def test_token_counts_equal_the_library(docs, odd, path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    else:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(sp.encode(x))
    strange = [x.replace("\x00", "́").replace("<s>", "<|endoftext|>") for x in texts(6, 300)] + ["a\x1cb\x85c　d", "it's 'S I'LL", "<|startoftext|>x<|endoftext|> y", "x ́y", "́ x"]
    memo = token_count.Memo(50)
    assert token_count.lengths(strange, path, memo) == [count(x) for x in strange]
    for df in (odd, docs.limit(60)):
        want = sorted(((r["doc_id"], len((r["text"] or "").encode()), count(r["text"] or "")) for r in df.collect()), key=str)
        assert rows_of(token_count.count_tokens(df, path), "doc_id", "n_bytes", "n_tokens") == want
    assert token_count.count_tokens(empty(odd), path).count() == 0


# 10


def brute_fingerprint(text: str | None) -> int:
    words = [w.encode() for w in WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    shingles = [a + b" " + b for a, b in zip(words, words[1:])] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_groups(fps: list[int], ids: list) -> list[tuple]:
    n = len(fps)
    near = [[j for j in range(n) if j != i and (fps[i] ^ fps[j]).bit_count() <= 6] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], f"{fps[i]:016x}", len(near[i]), min((ids[j] for j in seen if ids[j] is not None), default=None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "odd"])
def test_simhash_equals_brute_force(request, which):
    df = request.getfixturevalue(which)
    rows = df.collect()
    want = brute_groups([brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    assert rows_of(simhash.report(df), "doc_id", "fingerprint", "n_near", "component_id") == want


def test_segments_lose_no_pair(spark):
    """Random clusters around few centres, at several table sizes and with split buckets."""
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for c in centres for _ in range(40)} | {0, 2**64 - 1})
    want = {f: sum((f ^ g).bit_count() <= 6 for g in fps) - 1 for f in fps}
    arr = np.array(fps, np.uint64)
    for entries in (8, 1 << 14, 1 << 20, 1 << 26, 1 << 40):
        scheme = simhash.Scheme(entries)
        links = simhash._Links()
        for s in range(len(scheme.segments)):
            value = scheme.value(arr, s)
            cells, right, own = [value << np.uint64(30)], [np.zeros(len(arr), bool)], [arr]
            masks = scheme.ball(s)[1:]
            for mask in masks if len(masks) < 400 else ():
                other = value ^ mask
                up = other > value
                cells.append(other[up] << np.uint64(30))
                right.append(np.ones(int(up.sum()), bool))
                own.append(arr[up])
            if len(masks) >= 400:
                break
            cat = np.concatenate(own)
            simhash.match(links, scheme, s, np.concatenate(cells), np.concatenate(right), cat, np.ones(len(cat), np.int64))
        else:
            assert {f: links.near.get(f, 0) for f in fps} == want


@pytest.mark.parametrize("few", [True, False])
def test_large_buckets_are_split(spark, monkeypatch, few):
    """Also those far below a thousandth of all entries; grids broadcast or joined; blocks and links flushed."""
    for name, value in (("ROWS", 50), ("HELD_LINKS", 5), ("BLOCK", 64)):
        monkeypatch.setattr(simhash, name, value)
    if not few:
        plain = simhash._with_grid
        monkeypatch.setattr(simhash, "_with_grid", lambda each, grids: plain(each, grids, -1))
    rng = random.Random(3)
    base_ = rng.getrandbits(64)
    fps = list({base_ ^ sum(1 << b for b in rng.sample(range(40, 64), rng.randrange(6))) for _ in range(150)} | {rng.getrandbits(64) for _ in range(3000)})
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, 1) for f in fps], "fp long, n long")
    links = simhash.links_of(df, chunk=8)
    got = {r["fp"] % 2**64: r["near"] for r in links.groupBy("fp").agg(F.sum("near").alias("near")).collect()}
    arr = np.array(fps, np.uint64)
    want = {f: int((np.bitwise_count(arr ^ np.uint64(f)) <= 6).sum()) - 1 for f in fps}
    assert got == {f: n for f, n in want.items() if n}


def test_blocks_hold_whole_cells():
    """However rows are batched, a cell is never cut, and what stays behind is at most one cell."""
    rng = random.Random(4)
    cells = sorted((rng.randrange(2), rng.randrange(30)) for _ in range(400))
    batch = pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int64()), pa.array([False] * 400), pa.array(range(400), pa.int64()), pa.array([1] * 400, pa.int64())], names=["seg", "cell", "right", "fp", "n"])
    held, seen, at = simhash._Held(), [], 0
    while at < 400:
        size = rng.randrange(1, 60)
        held.add(batch.slice(at, size))
        at += size
        if (got := held.take(False)) is not None:
            seen.append(set(zip(got[0].tolist(), got[1].tolist())))
        assert held.rows <= max(collections.Counter(cells).values())
    seen.append(set(zip(*(x.tolist() for x in held.take(True)[:2]))))
    assert sum(map(len, seen)) == len(set(cells)) == len(set().union(*seen))


def test_dedup_carries_columns_without_an_order(odd):
    """A map column, and columns named like helper columns."""
    more = odd.withColumn("tags", F.create_map(F.lit("a"), F.lit(1))).withColumn("__k", F.lit(1)).withColumn("__fp", F.lit(2)).withColumn("row", F.lit(3)).withColumn("c0", F.lit(4))
    for kept in (simhash.dedup(more), exact_dedup.dedup(more), mixing.resample(more, share=1.0)):
        assert kept.columns == more.columns
        assert all(r["tags"] == {"a": 1} and (r["__k"], r["__fp"], r["row"], r["c0"]) == (1, 2, 3, 4) for r in kept.collect())
    assert simhash.dedup(more).count() == simhash.dedup(odd).count() and exact_dedup.dedup(more).count() == exact_dedup.dedup(odd).count()


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30)] + [(100, 101), (7, 7)], "fp long, root long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 101: 100}


def test_one_of_each_group_stays(odd, docs):
    rows = odd.collect()
    groups = brute_groups([brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
    kept = simhash.dedup(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({g[3] for g in groups})
    assert simhash.dedup(empty(odd)).count() == 0 and simhash.report(empty(odd)).count() == 0


def test_components_with_the_same_least_id_stay_apart(spark):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abcd")
    rows = [(None, a), (None, a), (None, b), (None, b), (1, c), (2, c), (1, d), (3, d)]
    fps = [brute_fingerprint(x) for x in (a, b, c, d)]
    assert min((x ^ y).bit_count() for i, x in enumerate(fps) for y in fps[:i]) > simhash.RADIUS
    kept = simhash.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(kept, "doc_id", "text") == sorted([(None, a), (None, b), (1, c), (1, d)], key=str)


# pipeline


def test_pipeline_on_odd_tables(odd, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows, extra and clashing columns, and an empty table, stage by stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
    spark = odd.sparkSession
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    more = odd.withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    for docs in (more, empty(more)):
        names, before = docs.columns, docs.count()
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialise(stage(spark, docs, str(tmp_path)))
            if i + 1 < len(corpus_pipeline.STAGES):
                assert docs.columns == names, name
            if i < 3:
                assert docs.count() <= before, name
            before = docs.count()
        assert docs.columns == ["doc_id", "source", "ids", "n_pieces", "n_bytes_fallback", "round_trip"]
        assert all(r["round_trip"] for r in docs.collect())


def test_pipeline(spark, sf_dir):
    corpus_pipeline = pytest.importorskip("corpus_pipeline", exc_type=ModuleNotFoundError)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = materialise(stage(spark, before, sf_dir))
        sizes.append(docs.count())
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
        if i == 1:
            assert sizes[2] == len({(r["text"] or "").encode().lower() for r in before.select("text").collect()})
        if i == 2:
            rows = before.collect()
            groups = brute_groups([brute_fingerprint(r["text"]) for r in rows], [r["doc_id"] for r in rows])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted({g[3] for g in groups})
        if i == 3:
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
            assert collections.Counter(r["doc_id"] for r in docs.collect()) == +collections.Counter(copies)
    assert sizes[5] == sizes[4] and docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, sf_dir).count() == sizes[5]
