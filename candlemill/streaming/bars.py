"""Bars from a stream of events: windows with a watermark, each bar written once, when no more events can change it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reuse import scratch
from ..sources.bars import bars_from_events

DELAY = "10 minutes"


def bars_from_stream(ticks: DataFrame, interval: str = "1h", delay: str = DELAY, ts: str = "ts", **names) -> DataFrame:
    """Bars of a streaming table. Events later than ``delay`` behind the newest one are dropped; the state holds one
    row for each symbol and open window."""
    timed = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return bars_from_events(timed, interval, ts=ts, **names).withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


def closed_bars(spark: SparkSession, pattern: str, interval: str = "1h", delay: str = DELAY) -> DataFrame:
    """The bars that a stream over all files there are has closed, from a table in the shared folder."""
    schema = spark.read.parquet(pattern).schema
    bars = bars_from_stream(spark.readStream.schema(schema).parquet(pattern), interval, delay)
    folder = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    query = bars.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/bars")
    query.awaitTermination()
    return spark.read.schema(bars.schema).parquet(f"{folder}/bars")
