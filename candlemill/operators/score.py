"""Which events count at a symbol's last bar, what each is worth, and what they say together.

Rows with a star (related.py) are held against those linked to them. The confidence is not part of the bias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import INTERVAL_SECONDS
from .related import without_linked
from .signals import bounded_worth, chained
from .signals import DECAY, STRONG, TENTATIVE, TREND_POINTS, VOLUME_BONUS

#: Why events of a state do not count; states in which an unconfirmed rejection counts a little;
#: states of live events; ranks of states and of statuses.
LEFT_OUT = {"expired": "expired", "invalidated": "invalidated", "failed_breakout": "failed breakout", "failed_breakdown": "failed breakdown", "reclaimed": "level reclaimed", "failed": "failed pattern", "awaiting_confirmation": "awaiting neckline confirmation"}
#: States whose age counts from the bar since which they hold.
MOVED = ("retest_rejected", "retest_pending", "invalidated", "failed_breakout", "failed_breakdown", "failed", "reclaimed")
PENDING = ("new", "active", "retested")
LIVE = ("new", "active", "retested", "retest_pending", "retest_rejected", "directionally_confirmed")
CLUSTERED = "clustered correlated evidence"
PENDING_POINTS, CONFLICT, LEAST_NET, FRESH_BREAK = 1.5, 0.65, 12.0, 3
UPWARD, DOWNWARD = ("bullish_pin_bar", "hammer", "double_bottom"), ("shooting_star", "double_top")


def signed(value: Column) -> Column:
    return F.when(F.col("bias") == "Bullish", value).when(F.col("bias") == "Bearish", -value).otherwise(0.0)


def judged(bars: DataFrame, first: DataFrame, states: DataFrame, interval: str = "1h") -> DataFrame:
    """Each first event with state, anchor (the bar its age counts from), age, reason (null where it counts),
    contribution and volume. Volume of one bar and bias counts once, for the event worth most."""
    keys = ["symbol", "bar_start", "kind"]
    e = first.join(states.select(*keys, "state", "since", "last"), keys)
    own = F.coalesce("anchored", "bar_index") if "anchored" in e.columns else F.col("bar_index")
    e = e.withColumn("anchor", F.when(F.col("state").isin(*MOVED), F.col("since")).when(F.col("state") == "expired", F.col("last")).otherwise(own))
    step = F.make_dt_interval(secs=F.lit(INTERVAL_SECONDS[interval]))
    day = F.to_date(F.col("bar_start") + step)
    dates = bars.select("symbol", F.col("bar_index").alias("anchor"), day.alias("anchor_day"))
    ends = bars.groupBy("symbol").agg(F.max(day).alias("last_day"))
    e = e.join(dates, ["symbol", "anchor"]).join(ends, "symbol").withColumn("age", F.col("last") - F.col("anchor"))
    return weighed(e, interval)


def weighed(e: DataFrame, interval: str = "1h") -> DataFrame:
    """Adds reason, pending, contribution and volume to events with state, age, anchor_day and last_day."""
    pending = (F.col("status") == "tentative") & F.col("state").isin(*PENDING)
    late = F.col("age") > F.col("max_age")
    reason = F.when(F.col("anchor_day") != F.col("last_day"), "outside current trading session") if INTERVAL_SECONDS[interval] < 86400 else F.when(F.lit(False), "")
    reason = reason.when(F.col("bias") == "Neutral", "informational only").when(pending | (F.col("state") == "directionally_confirmed"), F.when(late, "outside scoring horizon"))
    for state, why in LEFT_OUT.items():
        reason = reason.when(F.col("state") == state, why)
    reason = reason.when(F.col("status") == "tentative", "unconfirmed structural pattern").when(late, "outside scoring horizon")
    fresh = F.pow(F.lit(DECAY), F.col("age").cast("double"))
    whole = F.col("base") * fresh * F.when(F.col("strong"), STRONG).otherwise(1.0) * F.when(F.col("status") == "tentative", TENTATIVE).otherwise(1.0)
    e = e.withColumns({"reason": reason, "pending": pending}).withColumns({"contribution": F.when(F.col("reason").isNull(), signed(F.when(F.col("pending"), F.lit(PENDING_POINTS) * fresh).otherwise(whole))).otherwise(0.0), "_volume": F.when(F.col("reason").isNull() & F.col("loud") & ~F.col("pending"), signed(F.lit(VOLUME_BONUS) * fresh)).otherwise(0.0)})
    if "star" in e.columns:
        e = without_linked(e)
    once = Window.partitionBy("symbol", "bar_index", "bias").orderBy((F.col("_volume") == 0), F.abs("contribution").desc(), "priority", "pattern_id")
    return bounded(e.withColumn("volume", F.when(F.row_number().over(once) == 1, F.col("_volume")).otherwise(0.0)).drop("_volume", "anchor_day", "last_day"))


def bounded(rows: DataFrame) -> DataFrame:
    """Of a chain of counted events in one zone only the one worth most counts, for a little more; the others are left out."""
    keys = ["symbol", "bar_start", "kind"]
    chain = Window.partitionBy("symbol", "family", "bias", "cluster")
    c = chained(rows.filter("reason IS NULL"))
    best = F.row_number().over(chain.orderBy(F.abs("contribution").desc(), "bar_index", "pattern_id")) == 1
    c = c.select(*keys, F.count(F.lit(1)).over(chain).alias("members"), best.alias("best"), signed(bounded_worth(F.max(F.abs("contribution")).over(chain), F.count(F.lit(1)).over(chain).cast("double"))).alias("bound")).filter("members > 1")
    out = rows.join(c, keys, "left")
    lost = F.coalesce(~F.col("best"), F.lit(False))
    new = {"reason": F.when(lost, CLUSTERED).otherwise(F.col("reason")), "contribution": F.when(lost, 0.0).otherwise(F.coalesce("bound", "contribution")), "volume": F.when(lost, 0.0).otherwise(F.col("volume"))}
    return out.withColumns(new).drop("members", "best", "bound", "zone")


def assess(rows: DataFrame, broad: DataFrame) -> DataFrame:
    """One row for each symbol: sums, conflict, market state and bias."""
    last = broad.groupBy("symbol").agg(F.max_by("trend", "bar_index").alias("trend"))
    live = F.col("reason").isNull() & F.col("state").isin(*LIVE)
    c = F.col("contribution")
    order = F.struct("age", "priority", "bar_index", "pattern_id", "bias")
    sums = rows.groupBy("symbol").agg(
        F.sum(F.greatest(c, F.lit(0.0))).alias("bullish"),
        F.sum(-F.least(c, F.lit(0.0))).alias("bearish"),
        F.sum("volume").alias("volume"),
        F.sum((F.col("reason").isNull() & (F.col("status") == "confirmed")).cast("int")).alias("confirmed"),
        F.min_by(F.when(live, F.struct("pattern_id", "state", "age")), F.when(live, order)).alias("latest"),
        F.coalesce(F.bool_or(live & F.col("pattern_id").isin(*UPWARD)), F.lit(False)).alias("turns_up"),
        F.coalesce(F.bool_or(live & F.col("pattern_id").isin(*DOWNWARD)), F.lit(False)).alias("turns_down"),
    )
    t = last.join(sums, "symbol", "left").fillna(0.0, ["bullish", "bearish", "volume"]).fillna(0, ["confirmed"]).fillna(False, ["turns_up", "turns_down"])
    up, down, p = F.col("trend") == "Uptrend", F.col("trend") == "Downtrend", F.col("bullish") - F.col("bearish")
    t = t.withColumns({"conflict": F.when((F.col("bullish") > 0) & (F.col("bearish") > 0), F.least("bullish", "bearish") / F.greatest("bullish", "bearish")).otherwise(0.0), "net": p + F.col("volume") + F.when(up, TREND_POINTS).when(down, -TREND_POINTS).otherwise(0.0)})
    newest = lambda name: (F.col("latest.pattern_id") == name) & (F.col("latest.age") <= FRESH_BREAK)
    state = (
        F.when(F.col("latest").isNull(), F.when(up | down, "Trend Only").otherwise("Neutral"))
        .when(F.col("conflict") >= CONFLICT, "Conflicted")
        .when(newest("breakout"), "Breakout Attempt")
        .when(newest("breakdown") & (F.col("latest.state") == "retest_pending"), "Bearish Continuation Under Retest")
        .when(newest("breakdown") & down, "Breakdown Attempt")
        .when(down & F.col("turns_up"), "Bearish Trend with Bullish Reversal Attempt")
        .when(up & F.col("turns_down"), "Bullish Trend with Bearish Reversal Attempt")
        .when(up & (p > 0), "Bullish Continuation")
        .when(down & (p < 0), "Bearish Continuation")
        .when((up & (p < 0)) | (down & (p > 0)), "Reversal Watch")
        .when(p > 0, "Bullish Setup")
        .when(p < 0, "Bearish Setup")
        .otherwise("Neutral")
    )
    neutral = (F.col("confirmed") == 0) | (F.abs("net") < LEAST_NET) | (F.col("conflict") >= CONFLICT)
    bias = F.when(neutral, "Neutral").when(F.col("net") > 0, "Bullish").otherwise("Bearish")
    return t.select("symbol", "trend", "bullish", "bearish", "volume", "net", "conflict", state.alias("market_state"), bias.alias("bias"))
