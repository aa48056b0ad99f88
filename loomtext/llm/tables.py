"""Reading the input tables and placing intermediate ones."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomtext.functions.batches import BATCH_BYTES, small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only where that is unset, as in
    tests on one machine, a folder of this machine is set instead."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomtext-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Folders of `materialized` and others that this process has written and not removed.
_written: set[str] = set()


def remember(path: str) -> str:
    _written.add(path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(conf).delete(where, True)
    _written.discard(path)


def discard(df: DataFrame) -> None:
    """Removes what `materialized` wrote for `df`, which must not be used any more."""
    path = getattr(df, "_loomtext_path", None)
    if path in _written:
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Removes all intermediate tables of this process, once the results that read them are no longer
    needed; returns how many there were."""
    n = len(_written)
    for path in list(_written):
        _remove(spark, path)
    return n


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` as Parquet in the shared folder and reads it again: the lineage ends there, and
    the files survive the loss of any executor. They stay until `discard` or `release`."""
    spark = df.sparkSession
    path = remember(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomtext_path = path
    return out
