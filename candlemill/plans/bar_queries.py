"""Queries over bars built from the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detectors, evaluate, features, signals, trend, validate
from ..operators.reuse import settled
from ..sources.bars import bars_from_events, events

AS_OF = "2024-01-20 12:30:00"
INTERVAL = "1h"


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_from_events(events(spark, sf_dir), INTERVAL)


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.add_features(bars(spark, sf_dir))


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw bars with every kind of fault: each event is one, made uneven by its id."""
    e, i = events(spark, sf_dir), F.col("event_id")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.window("ts", "900 seconds").start.alias("bar_start"),
        F.when(i % 23 != 0, F.col("value")).alias("open"),
        (F.col("value") + (i % 11 - 1) * 0.5).alias("high"),
        (F.col("value") - (i % 13 - 1) * 0.5).alias("low"),
        (F.col("value") + (i % 5 - 2) * 0.25).alias("close"),
        (i % 17 - 1).cast("double").alias("volume"),
        i.alias("input_id"),
    )


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Means and deviations are compared to nine digits: engines add up in different orders."""
    return df.withColumns({c: F.round(F.col(c), 9) for c in columns})


def pick(*columns: str, digits: tuple[str, ...] = ()):
    return lambda spark, sf: rounded(feats(spark, sf).select("symbol", "bar_start", *columns), *digits)


def bars_hourly(spark, sf):
    return bars(spark, sf)


def completed_bars_asof(spark, sf):
    return validate.completed(bars(spark, sf), INTERVAL, AS_OF)


def validation_counters(spark, sf):
    return validate.report(quotes(spark, sf), "15m", AS_OF)


def dedup_keep_last(spark, sf):
    return validate.keep_last(quotes(spark, sf))


def invalid_ohlc(spark, sf):
    return quotes(spark, sf).filter(validate.invalid_ohlc())


def irregular_gaps(spark, sf):
    return validate.gaps(bars(spark, sf), INTERVAL).filter("gap").select("symbol", "bar_start")


def session_filter(spark, sf):
    return validate.in_session(bars(spark, sf), "regular-and-afterhours")


def swing_points(spark, sf):
    return features.swing_flags(feats(spark, sf)).select("symbol", "bar_start", "swing_high", "swing_low").filter("swing_high OR swing_low")


def pivots(spark, sf):
    return features.swing_flags(feats(spark, sf)).select("symbol", "bar_start", "pivot_high", "pivot_low").filter("pivot_high OR pivot_low")


def regression_slope(spark, sf):
    return rounded(features.regression_slope(feats(spark, sf)).select("symbol", "bar_start", "slope"), "slope")


def break_structure_events(spark, sf):
    return features.break_structure(feats(spark, sf)).filter("break_up OR break_down").select("symbol", "bar_start", "break_up", "break_down", "break_base")


def candle_direction(spark, sf):
    return rounded(features.candle_direction(feats(spark, sf)).select("symbol", "bar_start", "direction_score", "direction"), "direction_score")


def raw_breaks(spark, sf):
    return detectors.raw_breaks(feats(spark, sf))


def pattern(*ids: str):
    return lambda spark, sf: detectors.bar_patterns(feats(spark, sf)).filter(F.col("pattern_id").isin(*ids))


def pattern_counts(spark, sf):
    return detectors.bar_patterns(feats(spark, sf)).groupBy("symbol", "pattern_id", "bias").agg(F.count(F.lit(1)).alias("n"))


def double_top_setups(spark, sf):
    return rounded(detectors.double_setups(feats(spark, sf), True), "depth").drop("second_start", "valley")


def double_bottom_setups(spark, sf):
    return rounded(detectors.double_setups(feats(spark, sf), False), "depth").drop("second_start", "valley")


def _outcomes(spark, sf):
    """Outcomes of the confirmed events of all detectors that have a direction."""
    f = settled(feats(spark, sf))
    return evaluate.outcomes(f, signals.all_events(f).filter("status = 'confirmed'"))


def forward_outcomes(spark, sf):
    return rounded(_outcomes(spark, sf).drop("touch"), "directional_return", "mfe", "mae")


def target_stop_first_touch(spark, sf):
    return _outcomes(spark, sf).select("symbol", "bar_start", "pattern_id", "horizon", "touch")


MEANS = ("precision", "mean_return", "median_return", "mean_mfe", "mean_mae", "target_first_rate", "stop_first_rate")


def backtest_summary(spark, sf):
    return rounded(evaluate.summaries(_outcomes(spark, sf)), *MEANS)


def backtest_summary_by_pattern(spark, sf):
    return rounded(evaluate.summaries(_outcomes(spark, sf), "pattern_id"), *MEANS)


def backtest_summary_by_session(spark, sf):
    r = _outcomes(spark, sf).withColumn("session_segment", validate.segment(F.col("bar_start")))
    return rounded(evaluate.summaries(r, "session_segment"), *MEANS)


def backtest_summary_by_context(spark, sf):
    """By the broad trend at the signal's bar."""
    contexts = trend.broad(feats(spark, sf)).select("symbol", "bar_start", F.col("trend").alias("market_context"))
    return rounded(evaluate.summaries(_outcomes(spark, sf).join(contexts, ["symbol", "bar_start"]), "market_context"), *MEANS)


RATES = ("precision", "false_positive_rate", "win_rate", *[f"{a}_{m}" for a in ("mean", "median") for m in evaluate.MEASURES], "expectancy", "target_first_rate", "stop_first_rate", "neither_rate", "same_bar_rate")


def backtest_all_groups(spark, sf):
    """Outcomes of all signals, by pattern, by session and hour, and by trend, in one pass."""
    f = settled(feats(spark, sf))
    rows = evaluate.outcomes(f, signals.all_events(f).filter("status = 'confirmed'"))
    rows = rows.join(trend.broad(f).select("symbol", "bar_index", "trend"), ["symbol", "bar_index"])
    session = F.concat_ws(" | ", validate.segment(F.col("bar_start")), F.date_format("bar_start", "HH:mm"))
    return rounded(evaluate.grouped_summaries(rows, {"overall": None, "pattern": F.col("pattern_id"), "session": session, "trend": F.col("trend")}), *RATES)


def confidence_bucket(spark, sf):
    e = events(spark, sf).select((F.col("event_id") % 101).alias("confidence"))
    return e.groupBy(evaluate.confidence_bucket(F.col("confidence")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (bars_hourly, completed_bars_asof, validation_counters, dedup_keep_last, invalid_ohlc, irregular_gaps, session_filter, swing_points, pivots, regression_slope, break_structure_events, candle_direction, raw_breaks, pattern_counts, double_top_setups, double_bottom_setups, forward_outcomes, target_stop_first_touch, backtest_summary, backtest_summary_by_pattern, backtest_summary_by_session, backtest_summary_by_context, backtest_all_groups, confidence_bucket)
}
QUERIES |= {
    "session_segments": pick("session_date", "session_segment", "session_key"),
    "candle_geometry": pick("body", "bar_range", "upper_wick", "lower_wick", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "bullish", "bearish", "bar_return", digits=("body", "bar_range", "upper_wick", "lower_wick", "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "bar_return")),
    "moving_averages": pick("ma_20", "ma_50", digits=("ma_20", "ma_50")),
    "range_and_volume_baselines": pick("atr", "rolling_volume", "range_strength", digits=("atr", "rolling_volume", "range_strength")),
    "volatility20": pick("volatility", digits=("volatility",)),
    "rolling_levels": pick("rolling_high", "rolling_low"),
    "support_resistance": pick("resistance", "support"),
    "session_running": pick("session_ma_20", "session_high", "session_low", "session_open", "session_position", "from_session_high", "from_session_low", digits=("session_ma_20", "from_session_high", "from_session_low")),
    "time_of_day_volume": pick("clock_volume", "volume_baseline_source", "volume_baseline", digits=("clock_volume", "volume_baseline")),
    "strength_flags": pick("volume_strength", "significant", "strong_range", "strong_volume", digits=("volume_strength",)),
    "bullish_engulfing": pattern("bullish_engulfing"),
    "bearish_engulfing": pattern("bearish_engulfing"),
    "morning_star": pattern("morning_star"),
    "evening_star": pattern("evening_star"),
    "inside_bar": pattern("inside_bar"),
    "inside_bar_failure": pattern("inside_bar_failure"),
    "doji": pattern("doji"),
    "long_rejection_geometry": pattern("lower_rejection", "upper_rejection"),
}
