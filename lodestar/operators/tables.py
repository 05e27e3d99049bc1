"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and all runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-lodestar-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def kept(df: DataFrame, under: str = "lodestar") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it: later jobs start from the files, and lost executors lose nothing."""
    at = f"{shared_dir(df.sparkSession)}/{under}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)  # identifiers are half the size that they have otherwise
    return df.sparkSession.read.schema(df.schema).parquet(at)


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``kept`` for tables that nothing reads after the block, at whose end they are deleted."""
    under = f"lodestar/{uuid.uuid4().hex}"
    yield lambda df: kept(df, under)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{under}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
