"""Rows that several branches of a plan read are written once beside the checkpoints, which all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Masters whose executors share the driver's folders.
LOCAL = re.compile(r"local(\[.*\])?")


def scratch(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; in local mode a temporary one where it names none."""
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not LOCAL.fullmatch(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="candlemill-"))
    return sc._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, read from a table of their own: its size is known to the plans that read it."""
    path = f"{scratch(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
