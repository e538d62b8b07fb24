"""Order of events at a symbol's last bar, their families, their strength, and what kind of evidence they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of statuses and of states, smaller first; a state or status that is not named comes last.
STATUS_RANK = {"confirmed": 0, "candidate": 1, "tentative": 2, "failed": 3, "expired": 4}
STATE_RANK = {
    "new": 0, "retest_pending": 1, "retest_rejected": 2, "reclaimed": 3, "awaiting_confirmation": 4, "active": 5, "directionally_confirmed": 5,
    "retested": 6, "invalidated": 7, "failed_breakout": 8, "failed_breakdown": 9, "failed": 10, "expired": 11,
}
#: Patterns of each analytical family.
FAMILIES = {
    "structure": ("breakout", "breakdown", "double_top", "double_bottom"),
    "candlestick_reversal": ("bullish_pin_bar", "hammer", "shooting_star", "bullish_engulfing", "bearish_engulfing", "morning_star", "evening_star", "doji"),
    "consolidation": ("inside_bar", "inside_bar_failure"),
}
#: States of events that matter no longer, states of events that may still count, bars after which others are history.
PAST, RECENT, RECENT_BARS = ("expired", "invalidated", "failed", "failed_breakout", "failed_breakdown"), ("new", "active", "retested", "retest_pending", "retest_rejected", "reclaimed"), 4
TOP = 3


def ranked_by(column: str, ranks: dict[str, int]) -> Column:
    out = F.lit(len(ranks))
    for name, rank in ranks.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank (from 1) of each symbol's events: status, state, size of the contribution, bars since the event,
    priority, name. Equal ones follow their bar and bias, so that the order is whole."""
    order = [ranked_by("status", STATUS_RANK), ranked_by("state", STATE_RANK), F.abs("contribution").desc(), F.col("last") - F.col("bar_index"), "priority", "name", "bar_index", "kind", "bias"]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("symbol").orderBy(*order)))


def top(rows: DataFrame, k: int = TOP) -> DataFrame:
    return ranked(rows).filter(F.col("rank") <= k)


def family(pattern_id: str = "pattern_id") -> Column:
    out = F.lit("other")
    for name, those in FAMILIES.items():
        out = F.when(F.col(pattern_id).isin(*those), name).otherwise(out)
    return out


def strength() -> Column:
    """The larger of a bar's range and volume strength in hundredths, halves up; null where both are."""
    return F.floor(F.greatest("range_strength", "volume_strength") * 100 + 0.5) / 100


def evidence(rows: DataFrame) -> DataFrame:
    """Adds category, one of five that exclude each other."""
    counted = F.col("reason").isNull()
    since = F.col("last") - F.col("since")
    relevant = ~F.col("state").isin(*PAST) & F.when(counted, F.col("age") <= F.col("max_age")).otherwise(since <= RECENT_BARS)
    worth = F.abs(F.col("contribution") + F.col("volume")) > 0
    category = (
        F.when(~relevant, "historical_lifecycle")
        .when(counted & worth, "current_contributing")
        .when(F.col("state") == "awaiting_confirmation", "awaiting_confirmation")
        .when((F.col("bias") == "Neutral") | (F.col("status") == "candidate"), "current_neutral")
        .when(F.col("state").isin(*RECENT), "recent_non_contributing")
        .otherwise("historical_lifecycle")
    )
    return rows.withColumn("category", category)


def history(rows: DataFrame, limit: int) -> DataFrame:
    """Each symbol's latest events, the newest change of state first."""
    w = Window.partitionBy("symbol").orderBy(F.col("since").desc(), "name", "bar_index", "kind", "bias")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)
