"""Session helpers of the text operators."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


#: Files of a table that `cut` writes where there are fewer cores than this.
MIN_FILES = 8

_kept: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist on the executors' disks, with lineage: what a lost executor held is computed again.

    For tables that come straight from the input by much work and that several steps read;
    what is derived further cuts its lineage with `cut`, so that plans stay small.  `release` or
    spark.catalog.clearCache() gives the space back.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    _kept.append(df)
    return df


def release() -> None:
    """Drop what operators have kept so far; results that were not written yet are computed again."""
    while _kept:
        _kept.pop().unpersist()


#: Rows of texts, shingle sets or encoded blocks in one Arrow batch: bounds what a Python worker holds.
ARROW_ROWS = 1000


def bound_batches(df: DataFrame, rows: int = ARROW_ROWS) -> DataFrame:
    """df, with the session's Arrow batches held to so many rows (a smaller setting stays)."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share.

    Only where the setting is missing (tests on one machine) is a local folder used.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None:
            if not sc.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(where)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared folder, so that a lost executor loses nothing.

    Written as an eighth of the session's shuffle partitions, or as many files as there are cores
    (MIN_FILES at least): these tables are far smaller than the input, and each file costs file
    system calls of its own.
    """
    spark = df.sparkSession
    shared_folder(spark)
    files = max(MIN_FILES, spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)
    return df.coalesce(files).checkpoint(eager=True)
