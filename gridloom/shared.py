"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders written by this process, for :func:`clear`.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests, a laptop) a temporary folder is set instead.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def temporary(spark: SparkSession, name: str) -> str:
    """A new folder's path under the shared one. It is deleted by :func:`clear` or :func:`scratch`, at the latest when the driver ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    _written.append(path)
    return path


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors.

    Every task writes one file, so a file's row order is its partition's order.
    """
    spark = df.sparkSession
    path = temporary(spark, name)
    out = df.write.mode("overwrite").option("maxRecordsPerFile", 0).option("compression", "zstd")
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, keep: int = 0) -> int:
    """Delete this process's intermediate tables but the first ``keep``, once the results that read them are stored; gives their number."""
    done = 0
    while len(_written) > keep:
        fs, p = file_system(spark, _written.pop())
        done += fs.delete(p, True)
    return done


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """``with scratch(spark): result.write...``: the intermediate tables made inside are deleted at its end, and no others."""
    before = len(_written)
    try:
        yield
    finally:
        clear(spark, before)
