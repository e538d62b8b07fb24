"""How far the counted events of a symbol can be trusted, and what that makes of its bias.

Group mates of a counted event are taken to be as eligible as it is. The confidence has one digit, as the gate sees it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import family
from .related import DOUBLES, LINKED
from .score import CLUSTERED, DECAY, LEFT_OUT

#: Least confidence of a bias, of the levels HIGH and MEDIUM, and of a symbol without counted events (with and without a trend).
LEAST_CONFIDENCE, HIGH, MEDIUM, TREND_ALONE, NOTHING = 28.0, 60.0, 30.0, 12.0, 5.0
KEYS = ["symbol", "bar_start", "kind"]


def confidence(judged: DataFrame, events: DataFrame, assessed: DataFrame, strengths: DataFrame, warnings: int = 0) -> DataFrame:
    """Adds rule_confidence (5 to 100), evidence (confirmed events that count), families, volume_ratio and suppressed to
    the assessed symbols. strengths: (symbol, bar_index, strength); warnings: those of the data's validation."""
    named = (F.col("bias") != "Neutral") & (F.col("status") != "candidate")
    mates = events.filter(named).groupBy(*KEYS).agg((F.count(F.lit(1)) - 1).alias("mates"))
    lost = F.col("reason").isin(CLUSTERED, LINKED)
    eligible = judged.filter(F.col("reason").isNull() | lost).join(mates, KEYS)
    suppressed = eligible.groupBy("symbol").agg(F.sum(F.col("mates") + F.coalesce(lost, F.lit(False)).cast("int")).alias("suppressed"))
    counted = judged.filter("reason IS NULL AND status = 'confirmed'").join(strengths, ["symbol", "bar_index"], "left").withColumn("family", family())
    if "own_strength" in counted.columns:
        counted = counted.withColumn("strength", F.coalesce("own_strength", "strength"))
    by = counted.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("evidence"),
        F.countDistinct("bar_start", "kind").alias("groups"),
        F.countDistinct("family", "bias").alias("families"),
        F.avg(F.pow(F.lit(DECAY), F.col("age").cast("double"))).alias("recency"),
        F.avg(F.least(F.coalesce("strength", F.lit(0.0)), F.lit(3.0)) / 3).alias("strength"),
        (F.countDistinct(F.when(F.col("loud"), F.col("bar_index"))) / F.countDistinct("bar_index")).alias("volume_ratio"),
    )
    t = assessed.join(by, "symbol", "left").join(suppressed, "symbol", "left").fillna(0, ["evidence", "groups", "families", "suppressed"]).fillna(0.0, ["recency", "strength", "volume_ratio"])
    k, families, groups, zero = F.col("evidence"), F.col("families"), F.col("groups"), F.lit(0)
    p = F.col("bullish") - F.col("bearish")
    agrees = ((F.col("trend") == "Uptrend") & (p > 0)) | ((F.col("trend") == "Downtrend") & (p < 0))
    raised = 18.0 + F.least(groups, families + 1) * 7.0 + F.least(k, F.lit(4)) * 6.0 + F.col("recency") * 18.0 + F.col("strength") * 14.0 + F.col("volume_ratio") * 8.0 + F.when(agrees, 8.0).otherwise(0.0)
    lowered = F.col("conflict") * 20.0 + min(5.0 * warnings, 25.0) + F.col("suppressed") * 4.0 + F.greatest(zero, k - families) * 3.0 + F.greatest(zero, groups - families) * 4.0 + (1.0 - F.col("recency")) * 10.0 + F.when(F.col("market_state") == "Trend Only", 12.0).otherwise(0.0)
    worth = F.greatest(F.lit(5.0), F.least(F.lit(100.0), raised - lowered))
    alone = F.when(F.col("trend") != "Neutral", TREND_ALONE).otherwise(NOTHING)
    # sums differ in their last bits with the order of their rows, which must not decide a half
    return t.withColumn("rule_confidence", F.when(k > 0, F.round(F.round(worth, 9), 1)).otherwise(alone)).drop("groups", "recency", "strength")


def gated(rows: DataFrame) -> DataFrame:
    """A bias of too little confidence is none."""
    return rows.withColumn("bias", F.when(F.col("rule_confidence") >= LEAST_CONFIDENCE, F.col("bias")).otherwise("Neutral"))


def final(rows: DataFrame, local: DataFrame) -> DataFrame:
    """What the gated bias recommends, unless sides conflict or a trend stands against it, with the reasons for that.
    local: (symbol, local_trend) at each symbol's last bar."""
    t = gated(rows).join(local, "symbol", "left")
    trend, near, bias = F.col("trend"), F.col("local_trend"), F.col("bias")
    asked = bias != "Neutral"
    either = lambda c: c.isin("Uptrend", "Downtrend")
    against = F.when((bias == "Bullish") & (trend == "Downtrend") | (bias == "Bearish") & (trend == "Uptrend"), F.concat(F.lit("the broader trend is "), trend, F.lit(", opposing the bias")))
    both = F.when((F.col("bullish") > 0) & (F.col("bearish") > 0), F.lit("bullish and bearish evidence are both currently contributing to the score"))
    apart = F.when(either(trend) & either(near) & (trend != near), F.concat(F.lit("the broad trend ("), trend, F.lit(") and local session trend ("), near, F.lit(") disagree")))
    reasons = F.when(asked, F.concat_ws("; ", both, against, apart)).otherwise("")
    t = t.withColumn("reasons", reasons)
    plain = F.col("reasons") == ""
    said = F.when(plain & (bias == "Bullish"), "RECOMMEND TO BUY").when(plain & (bias == "Bearish"), "NOT RECOMMENDED").otherwise("NEUTRAL")
    sure = F.col("rule_confidence")
    level = F.when((sure >= HIGH) & plain, "HIGH").when(sure >= MEDIUM, "MEDIUM").otherwise("LOW")
    return t.select("symbol", "trend", "local_trend", "bias", "rule_confidence", said.alias("recommendation"), level.alias("confidence_level"), "reasons")


def violations(judged: DataFrame, assessed: DataFrame) -> DataFrame:
    """For each symbol how often its events contradict its sums: counted in a state that cannot count, left out but worth
    something, and whether both sums are those of the counted events (to a hundredth)."""
    counted, worth = F.col("reason").isNull(), F.abs("contribution") + F.abs("volume") > 0
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    spent = [s for s in LEFT_OUT if s != "reclaimed"]
    by = judged.groupBy("symbol").agg(number(counted & F.col("state").isin(*spent)).alias("counted_wrongly"), number(~counted & worth).alias("left_out_wrongly"), F.sum(F.when(counted, F.col("contribution"))).alias("_sum"), F.sum(F.when(counted, F.col("volume"))).alias("_volume"))
    same = lambda a, b: F.abs(a - F.coalesce(b, F.lit(0.0))) < 0.01
    t = assessed.join(by, "symbol", "left").fillna(0, ["counted_wrongly", "left_out_wrongly"])
    return t.select("symbol", "counted_wrongly", "left_out_wrongly", same(F.col("bullish") - F.col("bearish"), F.col("_sum")).alias("sums_agree"), same(F.col("volume"), F.col("_volume")).alias("volumes_agree"))


def confirmation(rows: DataFrame) -> DataFrame:
    """Adds context_status, directional_confirmation and follow_through: four questions that one status cannot answer; the shape of an event is always valid."""
    staged, broke = F.col("pattern_id").isin("bullish_pin_bar", "hammer", "shooting_star"), F.col("pattern_id").isin("breakout", "breakdown")
    state, status, pending = F.col("state"), F.col("status"), F.col("status") == "tentative"
    double = F.col("pattern_id").isin(*DOUBLES)
    decided = lambda done: F.when(double & (status == "confirmed"), done).when(double & (status == "failed"), "Failed").when(double & (state == "awaiting_confirmation"), "Pending")
    context = F.when(staged & (F.col("status") == "candidate"), "Rejected").when(staged, "Validated").otherwise("Not Applicable")
    turned: Column = decided("Confirmed").when(~staged, "Not Required").when(state == "directionally_confirmed", "Confirmed").when(state == "invalidated", "Failed").when(pending, "Pending").otherwise("Not Required")
    after = decided("Present").when(staged, F.when(state == "directionally_confirmed", "Present").when(state == "invalidated", "Failed").when(pending, "Pending"))
    after = after.when(broke, F.when(state == "retest_rejected", "Present").when(state.isin("reclaimed", "failed_breakout", "failed_breakdown"), "Failed").when(state.isin("new", "active", "retest_pending"), "Pending"))
    return rows.withColumns({"context_status": context, "directional_confirmation": turned, "follow_through": F.coalesce(after, F.lit("Not Applicable"))})
