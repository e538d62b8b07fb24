"""Bars kept as Parquet under a key of what was asked for, and results written as JSON lines."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def cache_key(**request) -> str:
    """The same digest for the same request, whatever the order of its parts."""
    return hashlib.sha256(json.dumps(request, sort_keys=True, default=str).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, ttl_seconds: float, load: Callable[[], DataFrame], **request) -> DataFrame:
    """Rows of a request from its table, if that was completed at most ttl_seconds ago; else loads and writes it.

    The folder may be in any file system that Spark reads. A table counts as complete once its success mark is there.
    """
    path = f"{folder.rstrip('/')}/{cache_key(**request)}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(mark) or time.time() - fs.getFileStatus(mark).getModificationTime() / 1000 > ttl_seconds:
        load().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, with nulls, columns in alphabetical order."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
