"""What the corpus operators share: intermediate tables, batch sizes, column order."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch_path

# where paths of stored tables are noted, inside ``noted``
_notes: list[list[str]] = []
# rows of one Arrow batch: texts may be very long, so batches are kept short
BATCH_ROWS = 512


def short_batches(spark: SparkSession) -> None:
    """What operators with Python need: short Arrow batches, so that very long texts fit a worker, and this package on its path.

    A cluster installs the package on its workers; where driver and workers
    share a machine, workers find it beside the driver's.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([*known, root])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    for paths in _notes:
        paths.append(path)
    return table


@contextmanager
def noted(paths: list[str]) -> Iterator[None]:
    """Note the tables stored meanwhile, for a caller that knows when their results have been written."""
    _notes.append(paths)
    try:
        yield
    finally:
        _notes.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove noted tables; those that are gone already don't matter."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    paths.clear()


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Remove stored tables that no later step reads, and the shuffle files of finished steps.

    Spark removes shuffle files when the driver's JVM finds their data frames
    unused; between the large steps of one operator that is worth asking for.
    """
    remove(spark, [table.stored_at for table in tables])
    gc.collect()
    spark._jvm.System.gc()


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def spark_hash_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
