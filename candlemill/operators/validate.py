"""Cleaning and counting of raw bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import INTERVAL_SECONDS, SESSION_MODES

PRICES = ("open", "high", "low", "close")


def segment(ts: Column, start: str = "09:30:00", end: str = "16:00:00") -> Column:
    """Session segment of a local wall-clock time; the end does not belong to the session."""
    clock = F.date_format(ts, "HH:mm:ss")
    return F.when(clock < start, "premarket").when(clock < end, "regular").otherwise("afterhours")


def in_session(df: DataFrame, mode: str = "regular") -> DataFrame:
    return df.filter(segment(F.col("bar_start")).isin(*SESSION_MODES[mode]))


def invalid_ohlc() -> Column:
    o, h, low, c, v = (F.col(x) for x in (*PRICES, "volume"))
    return F.coalesce((h < o) | (h < c) | (h < low) | (low > o) | (low > c) | (v < 0) | (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), F.lit(False))


def keep_last(df: DataFrame, order: str = "input_id") -> DataFrame:
    """The last row, in input order, of each symbol and time."""
    w = Window.partitionBy("symbol", "bar_start").orderBy(F.col(order).desc())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def completed(df: DataFrame, interval: str, as_of: str) -> DataFrame:
    """Bars that had ended at a moment."""
    step = F.make_dt_interval(secs=F.lit(INTERVAL_SECONDS[interval]))
    return df.filter(F.col("bar_start") + step <= F.lit(as_of).cast("timestamp_ntz"))


def gaps(df: DataFrame, interval: str) -> DataFrame:
    """Adds gap: whether the distance to the bar before, in the same session date, is not one interval."""
    w = Window.partitionBy("symbol").orderBy("bar_start")
    before = F.lag("bar_start").over(w)
    step = F.make_dt_interval(secs=F.lit(INTERVAL_SECONDS[interval]))
    return df.withColumn("gap", F.coalesce((F.to_date(before) == F.to_date("bar_start")) & (before + step != F.col("bar_start")), F.lit(False)))


def report(df: DataFrame, interval: str, as_of: str, order: str = "input_id") -> DataFrame:
    """One row of counters for each symbol, counted in the order of cleaning: duplicates, nulls, prices, gaps."""
    total = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("bar_start").alias("times"))
    single = keep_last(df, order)
    cells = sum(F.col(c).isNull().cast("int") for c in (*PRICES, "volume"))
    missing = single.groupBy("symbol").agg(F.sum(cells).alias("missing_value_count"))
    whole = single.dropna(subset=[*PRICES, "volume"])
    step = F.make_dt_interval(secs=F.lit(INTERVAL_SECONDS[interval]))
    good = whole.withColumn("bad", invalid_ohlc())
    clean = gaps(good.filter("NOT bad"), interval)
    bad = good.groupBy("symbol").agg(F.sum(F.col("bad").cast("int")).alias("invalid_ohlc_count"))
    last = clean.groupBy("symbol").agg(
        F.sum(F.col("gap").cast("int")).alias("irregular_gap_count"),
        F.sum((F.col("bar_start") + step <= F.lit(as_of).cast("timestamp_ntz")).cast("int")).alias("completed_row_count"),
    )
    return (
        total.join(missing, "symbol", "left").join(bad, "symbol", "left").join(last, "symbol", "left")
        .select("symbol", "row_count", (F.col("row_count") - F.col("times")).alias("duplicate_count"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("missing_value_count", "invalid_ohlc_count", "irregular_gap_count", "completed_row_count")])
    )


#: The warnings of a validation, with the counter that each tells; all but the last are errors in strict mode.
WARNINGS = (
    ("unsorted", "Input timestamps were unsorted."),
    ("duplicate_count", "Found %d duplicate timestamps."),
    ("missing_value_count", "Found %d missing OHLCV values."),
    ("invalid_ohlc_count", "Found %d rows with invalid OHLCV values."),
    ("irregular_gap_count", "Detected %d irregular or mixed same-session interval(s) relative to interval %s."),
)


def unsorted(df: DataFrame, order: str = "input_id") -> DataFrame:
    """(symbol, unsorted): the rows of each symbol that come before the one ahead of them in input order."""
    earlier = F.lag("bar_start").over(Window.partitionBy("symbol").orderBy(order)) > F.col("bar_start")
    return df.withColumn("_early", F.coalesce(earlier, F.lit(False))).groupBy("symbol").agg(F.sum(F.col("_early").cast("int")).alias("unsorted"))


def warnings(df: DataFrame, interval: str, as_of: str, order: str = "input_id") -> DataFrame:
    """(symbol, warnings, strict_error): texts in order, and the first of them that strict mode stops at."""
    counts = report(df, interval, as_of, order).join(unsorted(df, order), "symbol")
    texts = {}
    for c, text in WARNINGS:
        args = [F.col(c)] * text.count("%d") + [F.lit(interval)] * text.count("%s")
        texts[c] = F.when(F.col(c) > 0, F.format_string(text, *args) if args else F.lit(text))
    return counts.select("symbol", F.array_compact(F.array(*texts.values())).alias("warnings"), F.coalesce(*[texts[c] for c, _ in WARNINGS[:-1]]).alias("strict_error"))


def strict(df: DataFrame, interval: str, as_of: str, order: str = "input_id") -> DataFrame:
    """The same rows; the first symbol with an error in strict mode, by name, raises ValueError."""
    bad = warnings(df, interval, as_of, order).filter("strict_error IS NOT NULL").orderBy("symbol").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].symbol}: {bad[0].strict_error}")
    return df


def latest_sessions(features: DataFrame, segments: tuple[str, ...] = SESSION_MODES["regular"]) -> DataFrame:
    """The last session date of each symbol with a bar in the segments, the one before, and its bars of all segments."""
    dates = features.filter(F.col("session_segment").isin(*segments)).groupBy("symbol", "session_date").agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.lead("session_date").over(Window.partitionBy("symbol").orderBy(F.col("session_date").desc()))
    newest = dates.withColumn("previous_date", earlier).groupBy("symbol").agg(F.max("session_date").alias("session_date"), F.max_by("previous_date", "session_date").alias("previous_date"))
    bars = features.groupBy("symbol", "session_date").agg(F.min("bar_start").alias("session_start"), F.max("bar_start").alias("last_bar"), F.count(F.lit(1)).alias("bars"))
    return newest.join(bars, ["symbol", "session_date"])
