"""Frames that several passes read are written once to the cluster's checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.functions import files

SETTING = "spark.checkpoint.dir"


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where it is unset, a local master
    (tests, one machine) gets a folder of its own; a cluster has to name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get(SETTING, None)
        if shared is None and not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise RuntimeError(f"set {SETTING} to a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="barloom-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """The frame behind a reliable checkpoint. Spark removes the files with the frame if
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


_SCRATCH: list[str] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, for tables that a job writes and reads back."""
    _SCRATCH.append(f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _SCRATCH[-1]


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def little_disk(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside, the shuffle files of a query go when it ends, not when the driver next collects its garbage. Yields a
    function that gives a frame's copy in compressed files; the copies go at the end, so let no result read them."""
    before, folders = spark.conf.get(SHUFFLES_GO, None), []

    def copied(df: DataFrame) -> DataFrame:
        folders.append(scratch_folder(spark, "copy"))
        df.write.option("compression", "zstd").parquet(folders[-1])
        return spark.read.schema(df.schema).parquet(folders[-1])

    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield copied
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
        for path in folders:
            files.delete(spark, path)
            _SCRATCH.remove(path)


def slices(df: DataFrame, rows: int, most: int, key: str = "order_book_id") -> list[DataFrame]:
    """The frame, of `rows` rows, cut by a hash of its key into parts of about `most`, so that what a query shuffles at
    once is bounded. Each part reads the frame."""
    n = max(1, -(-rows // most))
    return [df] if n == 1 else [df.where(F.pmod(F.xxhash64(key), F.lit(n)) == k) for k in range(n)]


def drop_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has made, once nothing reads frames made from them any more;
    how many there were."""
    gone = list(_SCRATCH)
    for path in gone:
        files.delete(spark, path)
    _SCRATCH.clear()
    return len(gone)
