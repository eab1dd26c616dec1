"""Paths in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below spark.checkpoint.dir; a temporary folder is set where
    none is configured, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{tag}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back; what its stages shuffled goes when it is written."""
    spark, name = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, True)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def materialized(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back."""
    return _written(df, scratch_path(df.sparkSession, tag))


@contextmanager
def passing(spark: SparkSession, tag: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Like materialized, for tables that nothing reads after the block: they are deleted then."""
    folder = scratch_path(spark, tag)
    try:
        yield lambda df, name: _written(df, f"{folder}/{name}-{uuid.uuid4().hex}")
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
