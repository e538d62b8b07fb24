"""Causal features of bars. All windows share one partitioning by symbol, so one shuffle serves them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PatternConfig
from .validate import segment

def by_time():
    return Window.partitionBy("symbol").orderBy("bar_start")


def by_session():
    return Window.partitionBy("symbol", "session_date").orderBy("bar_start")


def by_clock():
    return Window.partitionBy("symbol", "time_of_day").orderBy("bar_start")


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles divide: infinite, or no number, where b is zero."""
    return F.when(b == 0, F.signum(a) * F.lit(float("inf"))).otherwise(a / b)


def full(value: str, agg, n: int, w=None) -> Column:
    """An aggregate over the last n rows, null until there are n."""
    frame = (w or by_time()).rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def add_features(bars: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    n = cfg.window
    past = by_time().rowsBetween(-n, -1)
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    df = bars.select(
        "*",
        (F.row_number().over(by_time()) - 1).alias("bar_index"),
        F.abs(c - o).alias("body"),
        (h - low).alias("bar_range"),
        (h - F.greatest(o, c)).alias("upper_wick"),
        (F.least(o, c) - low).alias("lower_wick"),
        (c > o).alias("bullish"),
        (c < o).alias("bearish"),
        (F.try_divide(c, F.lag("close").over(by_time())) - 1).alias("bar_return"),
        F.date_format("bar_start", "yyyy-MM-dd").alias("session_date"),
        segment(F.col("bar_start")).alias("session_segment"),
        F.date_format("bar_start", "HH:mm").alias("time_of_day"),
    )
    df = df.select(
        "*",
        *[F.try_divide(x, F.col("bar_range")).alias(f"{x}_ratio") for x in ("body", "upper_wick", "lower_wick")],
        F.concat_ws(":", "session_date", "session_segment").alias("session_key"),
        full("close", F.avg, 20).alias("ma_20"),
        full("close", F.avg, 50).alias("ma_50"),
        F.avg("bar_range").over(past).alias("atr"),
        F.avg("volume").over(past).alias("rolling_volume"),
        full("bar_return", F.stddev_samp, n).alias("volatility"),
        F.when(F.count("high").over(past) == n, F.max("high").over(past)).alias("rolling_high"),
        F.when(F.count("low").over(past) == n, F.min("low").over(past)).alias("rolling_low"),
        F.max("high").over(by_time().rowsBetween(-cfg.level_window, -1)).alias("resistance"),
        F.min("low").over(by_time().rowsBetween(-cfg.level_window, -1)).alias("support"),
    )
    same_clock = by_clock().rowsBetween(-5, -1)
    so_far = by_session().rowsBetween(Window.unboundedPreceding, 0)
    df = df.select(
        "*",
        F.avg("close").over(by_session().rowsBetween(-19, 0)).alias("session_ma_20"),
        F.max("high").over(so_far).alias("session_high"),
        F.min("low").over(so_far).alias("session_low"),
        F.first("open").over(so_far).alias("session_open"),
        (F.row_number().over(by_session()) - 1).alias("session_position"),
        F.when(F.count("volume").over(same_clock) >= 3, F.avg("volume").over(same_clock)).alias("clock_volume"),
    )
    base = F.coalesce("clock_volume", "rolling_volume")
    return df.select(
        "*",
        F.try_divide(F.col("close") - F.col("session_high"), F.col("session_high")).alias("from_session_high"),
        F.try_divide(F.col("close") - F.col("session_low"), F.col("session_low")).alias("from_session_low"),
        F.when(F.col("clock_volume").isNotNull(), "time_of_day").otherwise("rolling_20").alias("volume_baseline_source"),
        base.alias("volume_baseline"),
        F.when(F.col("atr") > 0, F.try_divide("bar_range", "atr")).alias("range_strength"),
        F.when(base > 0, F.try_divide(v, base)).alias("volume_strength"),
        (flag(F.col("bar_range") >= cfg.range_floor * F.col("atr")) | flag(v >= F.col("rolling_volume"))).alias("significant"),
        flag(F.col("bar_range") > cfg.strong_ratio * F.col("atr") + 1e-9).alias("strong_range"),
        flag(v > cfg.strong_ratio * base + 1e-9).alias("strong_volume"),
    )


def swing_flags(df: DataFrame) -> DataFrame:
    """swing_*: strictly beyond both neighbours on each side; pivot_*: strictly on the left only."""
    side = lambda c, k: (F.lag(c, -k) if k < 0 else F.lag(c, k)).over(by_time())
    out = {}
    for name, c, beyond, reach in (("high", "high", lambda a, b: a > b, lambda a, b: a >= b), ("low", "low", lambda a, b: a < b, lambda a, b: a <= b)):
        left = [beyond(F.col(c), side(c, k)) for k in (1, 2)]
        right = [(F.lead(c, k).over(by_time())) for k in (1, 2)]
        out[f"swing_{name}"] = flag(left[0] & left[1] & beyond(F.col(c), right[0]) & beyond(F.col(c), right[1]))
        out[f"pivot_{name}"] = flag(left[0] & left[1] & reach(F.col(c), right[0]) & reach(F.col(c), right[1]))
    return df.withColumns(out)


def regression_slope(df: DataFrame, n: int = 20) -> DataFrame:
    frame = by_time().rowsBetween(1 - n, 0)
    return df.withColumn("slope", F.when(F.count("close").over(frame) == n, F.regr_slope("close", "bar_index").over(frame)))


def break_structure(df: DataFrame) -> DataFrame:
    """Crossings of the rolling levels within a session, with their base score."""
    same = F.col("session_key") == F.lag("session_key").over(by_time())
    before = F.lag("close").over(by_time())
    up_ref = F.coalesce(F.lag("rolling_high").over(by_time()), F.col("rolling_high"))
    down_ref = F.coalesce(F.lag("rolling_low").over(by_time()), F.col("rolling_low"))
    up = flag(same & (F.col("close") > F.col("rolling_high")) & (before <= up_ref))
    down = flag(same & (F.col("close") < F.col("rolling_low")) & (before >= down_ref))
    out = df.withColumns({"break_up": up, "break_down": down})
    return out.withColumn("break_base", F.when(F.col("break_up") | F.col("break_down"), 11.0 + F.when(F.col("strong_volume"), 2.0).otherwise(0.0) + F.when(F.col("strong_range"), 1.5).otherwise(0.0)))


def candle_direction(df: DataFrame) -> DataFrame:
    """Score of a single candle from -1 to 1, and its label."""
    rng = F.col("bar_range")
    signed = F.try_divide(F.col("close") - F.col("open"), rng)
    place = F.try_divide(F.col("close") - F.col("low"), rng)
    raw = 0.5 * signed + 0.3 * 2 * (place - 0.5) + 0.2 * (F.col("lower_wick_ratio") - F.col("upper_wick_ratio"))
    # a bar without range has no direction; greatest() and least() skip nulls, so it is asked first
    s = F.when(raw.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    df = df.withColumn("direction_score", s)
    d = F.col("direction_score")
    return df.withColumn("direction", F.when(d >= 0.6, "Strong Bullish").when(d >= 0.2, "Bullish").when(d <= -0.6, "Strong Bearish").when(d <= -0.2, "Bearish").otherwise("Neutral"))
