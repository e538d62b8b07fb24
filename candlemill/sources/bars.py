"""Bars from event tables and files."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INTERVAL_SECONDS

CANONICAL = ("bar_start", "open", "high", "low", "close", "volume")
ALIASES = {"datetime": "bar_start", "date": "bar_start", "timestamp": "bar_start", "time": "bar_start"} | {c: c for c in CANONICAL[1:]}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def bars_from_events(ticks: DataFrame, interval: str = "1h", symbol: str = "event_type", ts: str = "ts", value: str = "value", order: str = "event_id") -> DataFrame:
    """One bar for each symbol and interval with events. Partial sums meet in one shuffle on (symbol, start).

    The window itself is the key, so that a stream's watermark closes it."""
    first = F.struct(ts, order)
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), F.window(ts, f"{INTERVAL_SECONDS[interval]} seconds").alias("_window"))
        .agg(
            F.min_by(value, first).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, first).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("symbol", F.col("_window.start").alias("bar_start"), *CANONICAL[1:])
    )


def canonical_columns(df: DataFrame) -> DataFrame:
    """Renames known column spellings; two columns for one name, or none, are errors. Others are dropped."""
    found: dict[str, str] = {}
    for c in df.columns:
        name = ALIASES.get(re.sub(r"[^a-z0-9]", "", c.lower()))
        if name in found:
            raise ValueError(f"{found[name]} and {c} both name {name}")
        if name:
            found[name] = c
    if missing := [c for c in CANONICAL if c not in found]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    extra = ["symbol"] if "symbol" in df.columns else []
    return df.select(*extra, *[F.col(f"`{found[c]}`").alias(c) for c in CANONICAL])


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a .csv or .parquet file, from start (included) to end (not included)."""
    if path.lower().endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    elif path.lower().endswith(".parquet"):
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"neither .csv nor .parquet: {path}")
    df = canonical_columns(raw)
    df = df.withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))
    for c in CANONICAL[1:]:
        df = df.withColumn(c, F.col(c).try_cast("double"))
    if start:
        df = df.filter(F.col("bar_start") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.filter(F.col("bar_start") < F.lit(end).cast("timestamp_ntz"))
    return df
