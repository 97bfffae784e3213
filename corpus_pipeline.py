"""A corpus from raw documents in five stages, each over all that the one before it kept.

Any column may be null, texts may be empty or of any length, rows may repeat, tables may be empty, and
columns beyond those of ``documents`` are carried along up to the last stage.  What each stage makes of
such rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import exact_dedup, mixing, quality_fm, simhash, sp_wfst
from emberlog.llm.common import remove, shared_path
from emberlog.llm.queries import PIECES, vocabulary
from emberlog.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at least 0.5.

    Null and empty texts are scored by their structure like any other; equal rows stay or go together.
    Without both labels every score is 0.5, and all stay.
    """
    ship(spark)
    return quality_fm.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each content: the one with the largest id.

    Null and empty texts are one content; a null id is smaller than any other; of rows equal in text and id one stays.
    """
    ship(spark)
    return exact_dedup.dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    Null, empty and blank texts are one group; a group of null ids only keeps one of its rows; ties in id go by
    the other columns.
    """
    ship(spark)
    return simhash.dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them.

    A null source is a source of its own; texts without words count no words and are taken by the same odds;
    rows that differ in any column are decided one by one.
    """
    ship(spark)
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_pieces, n_bytes_fallback and round_trip.

    Null and empty texts have no pieces; a null text doesn't come back as null but as empty.
    """
    ship(spark)
    return sp_wfst.encode(docs, vocabulary(PIECES), keep=["doc_id", "source"])


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("mixing sources", mix), ("sentencepiece", encode)]

#: SentencePiece paths and the trained classifier have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What a stage keeps is written in the shared folder and read again; it goes when the next stage has
    been written.
    """
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        before, path = path, shared_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
    return STAGES[-1][1](spark, docs, sf_dir)
