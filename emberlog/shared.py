"""Tables in the folder that all executors share: materialising, fresh paths, removal."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: With it a query's shuffle files go when it ends; lost ones are computed again where something still reads them.
CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named, a temporary one, but only if driver and executors are one machine."""
    found = spark.conf.get(CHECKPOINT_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found


def shared_path(spark: SparkSession, stem: str) -> str:
    """A fresh path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint in the shared folder.

    The shuffle files that went into it are dropped at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    with dropping_shuffles(spark):
        return df.select("*").checkpoint(eager=True)


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Results of plans made within drop their shuffle files when they are there."""
    before = spark.conf.get(CLEANUP_CONF, None)
    spark.conf.set(CLEANUP_CONF, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_CONF) if before is None else spark.conf.set(CLEANUP_CONF, before)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
