"""Events of the candle, rejection and break detectors (not of doubles) as one relation: evidence groups, clusters of repeated rejections, scores.

States that later bars give an event are in lifecycle.py. The linking of doubles to breaks, and the quality of a
context as a rank key, are not part of this relation yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import detectors, trend
from .features import by_time
from .ranking import family

#: Base score, priority, specificity and greatest age in bars of each pattern.
WEIGHTS = {
    "breakout": (18, 2, 26, 12),
    "breakdown": (18, 2, 26, 12),
    "bullish_engulfing": (15, 3, 28, 6),
    "bearish_engulfing": (15, 3, 28, 6),
    "morning_star": (16, 3, 32, 6),
    "evening_star": (16, 3, 32, 6),
    "inside_bar_failure": (11, 4, 16, 8),
    "bullish_pin_bar": (10, 5, 18, 6),
    "shooting_star": (10, 5, 35, 6),
    "hammer": (10, 6, 40, 6),
    "inside_bar": (0, 6, 12, 8),
    "doji": (4, 7, 8, 6),
}
#: Base score of a strong break.
STRONG_BREAK = 26
DECAY, VOLUME_BONUS, STRONG, TENTATIVE, TREND_POINTS = 0.85, 2.5, 1.15, 0.5, 12.0
CLUSTER_BARS, CLUSTER_ZONE, CLUSTER_BONUS, CLUSTER_CAP = 5, 0.006, 1.5, 1.35


def _of(which: int) -> Column:
    out = None
    for name, values in WEIGHTS.items():
        hit, value = F.col("pattern_id") == name, F.lit(values[which])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def all_events(features: DataFrame) -> DataFrame:
    """One row for each event, with its weights, its evidence group, its bar's extreme as zone and its volume."""
    cols = ("symbol", "bar_start", "bar_index", "pattern_id", "name", "bias", "status", "strong", "level")
    no_level = F.lit(None).cast("double")
    candles = detectors.bar_patterns(features).filter("pattern_id NOT LIKE '%rejection'")
    candles = candles.withColumns({"name": F.col("pattern_id"), "status": F.when(F.col("pattern_id") == "doji", "candidate").otherwise("confirmed"), "strong": F.lit(False), "level": no_level})
    wicks = trend.rejections(features).withColumns({"strong": F.lit(False), "level": no_level})
    breaks = detectors.breaks(features).withColumns({"name": F.col("pattern_id"), "status": F.lit("confirmed")})
    rows = candles.select(*cols).unionByName(wicks.select(*cols)).unionByName(breaks.select(*cols))
    weights = {"base": F.when(F.col("strong"), STRONG_BREAK).otherwise(_of(0)), "priority": _of(1), "specificity": _of(2), "max_age": _of(3)}
    p = F.col("pattern_id")
    kind = F.when(p.isin("breakout", "breakdown"), p).when(p.like("inside%"), F.concat(F.lit("inside:"), "bias")).when(p.like("%engulfing"), F.concat(F.lit("engulfing:"), "bias")).otherwise("candlestick")
    past = lambda c: F.lag(c).over(by_time()).alias(f"star_{c}")
    at = features.select("symbol", "bar_index", "high", "low", past("high"), past("low"), F.coalesce(F.col("volume_strength") >= 1, F.lit(False)).alias("loud"))
    # the price that was tested: a rejection's extreme, that of a star's middle candle, the level that broke
    wick = p.isin("bullish_pin_bar", "hammer", "shooting_star")
    zone = F.when(wick & (F.col("bias") == "Bearish"), F.col("high")).when(wick & (F.col("bias") == "Bullish"), F.col("low"))
    zone = zone.when(p == "morning_star", F.col("star_low")).when(p == "evening_star", F.col("star_high")).when(p.isin("breakout", "breakdown"), F.col("level"))
    return rows.withColumns({**weights, "kind": kind}).join(at, ["symbol", "bar_index"]).withColumn("zone", zone).drop("high", "low", "star_high", "star_low", "level")


def distinct_events(events: DataFrame, *more: str) -> DataFrame:
    """Events that agree in pattern, status, bar, bias and the columns named come once, with copies: how many there were."""
    keys = ["symbol", "bar_index", "pattern_id", "status", "bias", *more]
    rest = [c for c in events.columns if c not in keys]
    one = F.min(F.struct(*rest)).alias("_one")
    return events.groupBy(*keys).agg(one, F.count(F.lit(1)).alias("copies")).select(*keys, "_one.*", "copies")


def primaries(events: DataFrame) -> DataFrame:
    """The first event of each evidence group (symbol, bar, kind)."""
    status = F.when(F.col("status") == "confirmed", 0).when(F.col("status") == "tentative", 1).otherwise(2)
    order = [status, F.col("bias") == "Neutral", -F.col("specificity"), F.col("name").like("%Rejection"), F.col("priority"), -F.col("base"), F.col("name"), F.col("pattern_id")]
    w = Window.partitionBy("symbol", "bar_start", "kind").orderBy(*order)
    return events.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def chained(rows: DataFrame, zone_tolerance: float = CLUSTER_ZONE) -> DataFrame:
    """Events with a zone, with family and cluster: the number of its chain. In a chain events of one family and bias
    follow within a few bars in one price zone, without a confirmed event of the other bias between."""
    w = Window.partitionBy("symbol").orderBy("bar_index")
    past, through = w.rangeBetween(Window.unboundedPreceding, -1), w.rangeBetween(Window.unboundedPreceding, 0)
    df = rows.withColumn("family", family())
    for bias, other in (("Bullish", "Bearish"), ("Bearish", "Bullish")):
        counted = ((F.col("bias") == other) & (F.col("status") == "confirmed")).cast("int")
        df = df.withColumns({f"_past_{bias}": F.coalesce(F.sum(counted).over(past), F.lit(0)), f"_through_{bias}": F.sum(counted).over(through)})
    pick = lambda x: F.when(F.col("bias") == "Bullish", F.col(f"_{x}_Bullish")).otherwise(F.col(f"_{x}_Bearish"))
    df = df.filter("zone IS NOT NULL AND bias <> 'Neutral'").withColumns({"_past": pick("past"), "_through": pick("through")})
    side = Window.partitionBy("symbol", "family", "bias").orderBy("bar_index", "pattern_id")
    before = lambda c: F.lag(c).over(side)
    near = F.abs(F.col("zone") - before("zone")) / F.greatest(F.abs(before("zone")), F.abs("zone"), F.lit(1e-6)) <= zone_tolerance
    # events of one bar have none between them
    joined = (F.col("bar_index") - before("bar_index") <= CLUSTER_BARS) & near & ((F.col("_past") == before("_through")) | (F.col("bar_index") == before("bar_index")))
    df = df.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).withColumn("cluster", F.sum("_new").over(side))
    return df.drop(*[c for c in df.columns if c.startswith(("_past", "_through"))], "_new")


def clusters(first: DataFrame, zone_tolerance: float = CLUSTER_ZONE) -> DataFrame:
    """One row for each chain of two or more events, with what the base scores are worth together."""
    out = chained(first, zone_tolerance).groupBy("symbol", "family", "bias", "cluster").agg(F.min("bar_index").alias("first_bar"), F.max("bar_index").alias("last_bar"), F.count(F.lit(1)).alias("members"), F.max("base").cast("double").alias("_best"))
    bounded = bounded_worth(F.col("_best"), F.col("members"))
    return out.filter("members > 1").withColumn("bounded", F.when(F.col("bias") == "Bullish", bounded).otherwise(-bounded)).drop("cluster", "_best")


def bounded_worth(best: Column, members: Column) -> Column:
    """What a chain counts: its best event and a little for each repetition, up to a cap."""
    return F.least(best + CLUSTER_BONUS * (members - 1), best * CLUSTER_CAP)


def scores(first: DataFrame, broad: DataFrame) -> DataFrame:
    """Sums of what each symbol's recent directional events are worth at its last bar, with its trend's points."""
    last = broad.groupBy("symbol").agg(F.max("bar_index").alias("last"), F.max_by("trend", "bar_index").alias("trend"))
    age = F.col("last") - F.col("bar_index")
    sign = F.when(F.col("bias") == "Bullish", 1.0).when(F.col("bias") == "Bearish", -1.0).otherwise(0.0)
    fresh = F.when(age <= F.col("max_age"), F.pow(F.lit(DECAY), age.cast("double"))).otherwise(0.0)
    # strength is in a break's base already and multiplies once more
    worth = sign * F.col("base") * fresh * F.when(F.col("strong"), STRONG).otherwise(1.0)
    counted = first.filter("status = 'confirmed'").join(last.select("symbol", "last"), "symbol").filter(age <= F.col("max_age"))
    sums = counted.withColumns({"_p": worth, "_v": F.when(F.col("loud"), sign * VOLUME_BONUS * fresh).otherwise(0.0)}).groupBy("symbol").agg(F.sum(F.greatest("_p", F.lit(0.0))).alias("bullish"), F.sum(-F.least("_p", F.lit(0.0))).alias("bearish"), F.sum("_v").alias("volume"))
    points = F.when(F.col("trend") == "Uptrend", TREND_POINTS).when(F.col("trend") == "Downtrend", -TREND_POINTS).otherwise(0.0)
    out = last.join(sums, "symbol", "left").fillna(0.0, ["bullish", "bearish", "volume"]).withColumn("trend_points", points)
    return out.select("symbol", "bullish", "bearish", "volume", "trend_points", (F.col("bullish") - F.col("bearish") + F.col("volume") + F.col("trend_points")).alias("net"))
