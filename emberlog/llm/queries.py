"""The registered queries of the ten operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arc_warc, chat_format, exact_dedup, line_crf, mixing, quality_fm, simhash, sp_wfst, token_count, toxicity

PIECES = "piece_bpe_32k.model"
WORD_PIECES = "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: ids, their number, byte pieces and whether the text came back."""
    return sp_wfst.encode(_table(spark, sf_dir, "documents"), vocabulary(PIECES))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = line_crf.judge(docs, line_crf.train(docs, _table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))
    return chat_format.digest(own.unionByName(more))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc_warc.archive_report(_table(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), vocabulary(WORD_PIECES))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_mix_sources, op3_quality_fm, op4_line_crf, op5_exact_dedup,
        op6_chat_format, op7_toxicity, op8_arc_to_warc, op9_token_counts, op10_simhash,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  (CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13)) AS UBIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
           FROM documents),
     s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
           FROM d GROUP BY source),
     t AS (SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / w AS turn FROM s),
     a AS (SELECT 1.5::DOUBLE * sum(source_size) AS wanted, sum(w) AS weights FROM t),
     f AS (SELECT row_number() OVER o AS n, sum(most) OVER o AS full_words, sum(w) OVER o AS full_weight, lead(turn) OVER (ORDER BY turn, source NULLS LAST) AS after FROM t
           WINDOW o AS (ORDER BY turn, source NULLS LAST ROWS UNBOUNDED PRECEDING)
           UNION ALL SELECT 0, 0.0, 0.0, min(turn) FROM t),
     l AS (SELECT (wanted - full_words) / (weights - full_weight) AS level FROM f, a
           WHERE full_weight < weights AND (wanted - full_words) / (weights - full_weight) < after ORDER BY n LIMIT 1),
     g AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM l), most / w) * w) AS target FROM t),
     h AS (SELECT *, CAST(floor(target / greatest(source_size, 1)) AS BIGINT) AS sure, target - floor(target / greatest(source_size, 1)) * source_size AS goal FROM g),
     b AS (SELECT d.*, source_size, target, sure, goal, length(bin(size)) AS digits FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source),
     i AS (SELECT source, digits, any_value(goal) AS goal, CAST(sum(size) AS BIGINT) AS words FROM b GROUP BY source, digits),
     j AS (SELECT source, digits, (goal - coalesce(sum(words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / nullif(sum(digits * words) OVER (PARTITION BY source ORDER BY digits DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS factor FROM i),
     m AS (SELECT source, max_by(factor, digits) AS factor FROM j WHERE factor * digits < 1 GROUP BY source),
     n AS (SELECT b.*, coalesce(least(greatest(m.factor * digits, 1e-9::DOUBLE), 1.0::DOUBLE), 1.0::DOUBLE) AS p FROM b LEFT JOIN m ON b.source IS NOT DISTINCT FROM m.source),
     q AS (SELECT *, CASE WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM n),
     r AS (SELECT q.*, row_number() OVER o AS k, sum(size) OVER o AS through FROM q WINDOW o AS (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING)),
     e AS (SELECT source, min(k) AS edge, min_by(goal - through + size, k) AS room FROM r WHERE through > goal GROUP BY source),
     x AS (SELECT r.*, edge, room, edge IS NOT NULL AND k > edge AND size <= room AND size > 0 AS later FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source),
     y AS (SELECT *, CASE WHEN later THEN sum(CASE WHEN later THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) END AS filled FROM x),
     z AS (SELECT *, min(CASE WHEN filled > room THEN k END) OVER (PARTITION BY source) AS edge2 FROM y)
SELECT doc_id, size, source_size, target, CASE WHEN goal > 0 THEN p ELSE 0.0::DOUBLE END AS p,
       sure + CAST(goal > 0 AND (edge IS NULL OR k < edge OR later AND (edge2 IS NULL OR k < edge2 OR k = edge2 AND filled - room < room - filled + size)) AS BIGINT) AS copies,
       size * (sure + CAST(goal > 0 AND (edge IS NULL OR k < edge OR later AND (edge2 IS NULL OR k < edge2 OR k = edge2 AND filled - room < room - filled + size)) AS BIGINT)) AS taken
FROM z
"""

_OP5 = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
     g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""

_OP6 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
     e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS et,
                  replace(replace(replace(role, '\', '\\'), '<|', '<\|'), '|>', '|\>') AS er,
                  row_number() OVER w AS k, lag(role) OVER w AS before, lead(role) OVER w AS after
           FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(length(et) + CASE WHEN before IS NOT DISTINCT FROM role THEN 8 ELSE 10 + length(er) END
                + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 ELSE 8 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     k AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
     v AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS w FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((w[j // 4 + 1] >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM v
"""

ORACLE_SQL: dict[str, str] = {"op2_mix_sources": _OP2, "op5_exact_dedup": _OP5, "op6_chat_format": _OP6, "op8_arc_to_warc": _OP8}
