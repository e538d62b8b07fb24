"""Pattern detectors over feature rows. The single-, two- and three-bar ones come from one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PatternConfig
from .features import by_time, flag, ratio

NEEDED = ("open", "high", "low", "close", "bullish", "bearish", "body_ratio", "significant", "session_key", "bar_range")


def tolerance(level: Column, cfg: PatternConfig = PatternConfig()) -> Column:
    """What counts as touching a price level."""
    return F.greatest(F.coalesce("atr", "bar_range") * cfg.tolerance_range, F.abs(level) * cfg.tolerance_price, F.lit(cfg.tolerance_floor))


def with_neighbours(df: DataFrame) -> DataFrame:
    return df.withColumns({f"{c}_{k}": F.lag(c, k).over(by_time()) for k in (1, 2) for c in NEEDED})


def bar_patterns(df: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """(symbol, bar_start, bar_index, pattern_id, bias) of every candle pattern that ends at a bar."""
    d = with_neighbours(df)
    c = F.col
    two = c("session_key") == c("session_key_1")
    three = two & (c("session_key") == c("session_key_2"))
    either = c("significant") | c("significant_1")
    gap = (c("bar_range") + c("bar_range_1") + c("bar_range_2")) / 3 * cfg.gap_ratio
    middle = (c("open_2") + c("close_2")) / 2
    mother = c("high_1").__lt__(c("high_2")) & (c("low_1") > c("low_2"))
    within = (c("close") > c("low_2")) & (c("close") < c("high_2"))
    place = F.try_divide(c("close") - c("low"), c("bar_range"))
    found = {
        ("bullish_engulfing", "Bullish"): two & c("bearish_1") & c("bullish") & (c("open") <= c("close_1")) & (c("close") >= c("open_1")) & either,
        ("bearish_engulfing", "Bearish"): two & c("bullish_1") & c("bearish") & (c("open") >= c("close_1")) & (c("close") <= c("open_1")) & either,
        ("morning_star", "Bullish"): three & c("bearish_2") & (c("body_ratio_2") >= cfg.star_body) & (c("body_ratio_1") <= cfg.small_body)
        & (F.greatest("open_1", "close_1") <= c("close_2") + gap) & (F.least("open_1", "close_1") <= c("close_2") + gap) & c("bullish") & (c("close") >= middle),
        ("evening_star", "Bearish"): three & c("bullish_2") & (c("body_ratio_2") >= cfg.star_body) & (c("body_ratio_1") <= cfg.small_body)
        & (F.greatest("open_1", "close_1") >= c("close_2") - gap) & (F.least("open_1", "close_1") >= c("close_2") - gap) & c("bearish") & (c("close") <= middle),
        ("inside_bar", "Neutral"): two & (c("high") < c("high_1")) & (c("low") > c("low_1")) & either,
        ("inside_bar_failure", "Bearish"): three & mother & c("significant") & (c("high") > c("high_2")) & (c("low") >= c("low_2")) & within & c("bearish"),
        ("inside_bar_failure", "Bullish"): three & mother & c("significant") & (c("low") < c("low_2")) & (c("high") <= c("high_2")) & within & c("bullish"),
        ("doji", "Neutral"): (c("bar_range") > 0) & (c("body_ratio") <= cfg.doji_body),
        ("lower_rejection", "Neutral"): (c("lower_wick_ratio") >= cfg.wick_ratio) & (c("body_ratio") <= cfg.small_body) & (place >= 0.60) & c("significant"),
        ("upper_rejection", "Neutral"): (c("upper_wick_ratio") >= cfg.wick_ratio) & (c("body_ratio") <= cfg.small_body) & (place <= 0.40) & c("significant"),
    }
    events = F.array_compact(F.array(*[F.when(flag(p), F.struct(F.lit(k).alias("pattern_id"), F.lit(b).alias("bias"))) for (k, b), p in found.items()]))
    return d.select("symbol", "bar_start", "bar_index", F.inline(events))


def raw_breaks(df: DataFrame) -> DataFrame:
    """Level crossings with enough volume, before cooldown and suppression."""
    same = F.col("session_key") == F.lag("session_key").over(by_time())
    before, loud = F.lag("close").over(by_time()), F.col("volume_strength") >= 1
    up_ref = F.coalesce(F.lag("rolling_high").over(by_time()), F.col("rolling_high"))
    down_ref = F.coalesce(F.lag("rolling_low").over(by_time()), F.col("rolling_low"))
    kinds = F.array_compact(
        F.array(
            F.when(flag(same & loud & (F.col("close") > F.col("rolling_high")) & (before <= up_ref)), F.struct(F.lit("breakout").alias("pattern_id"), F.lit("Bullish").alias("bias"), F.col("rolling_high").alias("level"))),
            F.when(flag(same & loud & (F.col("close") < F.col("rolling_low")) & (before >= down_ref)), F.struct(F.lit("breakdown").alias("pattern_id"), F.lit("Bearish").alias("bias"), F.col("rolling_low").alias("level"))),
        )
    )
    d = df.withColumn("kinds", kinds)
    return d.select("symbol", "bar_start", "bar_index", F.inline("kinds"))


def double_setups(df: DataFrame, top: bool = True, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Double tops (or bottoms): for each first pivot the first second one that qualifies, with the neckline and its bar (valley).

    Pairs are at most double_max_gap bars apart, so pivots join on blocks of that many bars and the next block.
    """
    from .features import swing_flags

    price, other = ("high", "low") if top else ("low", "high")
    flagged = swing_flags(df)
    pivots = flagged.filter(f"pivot_{price}").select("symbol", F.col("bar_index").alias("i"), F.col(price).alias("p"), "bar_start")
    between = flagged.filter(f"pivot_{other}").select("symbol", F.col("bar_index").alias("k"), F.col(other).alias("q"))
    size = cfg.double_max_gap
    first = pivots.select("symbol", F.col("i").alias("i1"), F.col("p").alias("p1"), F.explode(F.array(F.floor(F.col("i") / size), F.floor(F.col("i") / size) + 1)).alias("block"))
    second = pivots.select("symbol", F.col("i").alias("i2"), F.col("p").alias("p2"), F.col("bar_start").alias("second_start"), F.floor(F.col("i") / size).alias("block"))
    gap = F.col("i2") - F.col("i1")
    pairs = first.join(second, ["symbol", "block"]).filter(gap.between(cfg.double_min_gap, size) & (ratio(F.abs(F.col("p1") - F.col("p2")), F.greatest("p1", "p2")) <= cfg.double_price_ratio)).drop("block")
    necks = between.select("symbol", "k", "q", F.floor(F.col("k") / size).alias("block"))
    wide = pairs.withColumn("block", F.explode(F.array_distinct(F.array(F.floor(F.col("i1") / size), F.floor(F.col("i2") / size)))))
    inside = wide.join(necks, ["symbol", "block"]).filter("k > i1 AND k < i2")
    pick = lambda c: F.min_by(c, F.struct("q", "k")) if top else F.max_by(c, F.struct("q", -F.col("k")))
    neck = inside.groupBy("symbol", "i1", "i2", "p1", "p2", "second_start").agg(pick("q").alias("neckline"), pick("k").alias("valley"))
    edge = F.least("p1", "p2") if top else F.greatest("p1", "p2")
    depth = ratio(edge - F.col("neckline"), edge) if top else ratio(F.col("neckline") - edge, F.col("neckline"))
    order = Window.partitionBy("symbol", "i1").orderBy("i2")
    return neck.withColumn("depth", depth).filter(F.col("depth") >= cfg.double_depth).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


COOLDOWN = 3


def breaks(df: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Breakouts and breakdowns that remain after the cooldown and while no earlier level is still broken.

    Only crossings and changes of the session matter to the state, so only those rows are shuffled; they
    stream through each partition in order with one small state for each symbol and side.
    """
    past = lambda c, k=1: F.lag(c, k).over(by_time())
    changed = ~flag(F.col("session_key") == past("session_key"))
    loud, sides = F.col("volume_strength") >= 1, []
    for name, bias, level, sign in (("breakout", "Bullish", "rolling_high", 1), ("breakdown", "Bearish", "rolling_low", -1)):
        ref = F.col(level)
        before = F.coalesce(past(level), ref)
        crossed = flag(loud & ((F.col("close") - ref) * sign > 0) & ((past("close") - before) * sign <= 0)) & ~changed
        tol = tolerance(ref, cfg)
        strong = F.col("strong_volume") | F.col("strong_range") | flag(F.abs(F.col("close") - ref) / tol >= 2.5)
        sides.append(F.when(ref.isNotNull() & (crossed | changed), F.struct(F.lit(name).alias("pattern_id"), F.lit(bias).alias("bias"), ref.alias("level"), (ref + tol * sign).alias("edge"), F.lit(sign).alias("sign"), past("close").alias("before"), crossed.alias("crossed"), strong.alias("strong"))))
    d = df.withColumn("_sides", F.array_compact(F.array(*sides)))
    sparse = d.select("symbol", "bar_start", "bar_index", F.inline("_sides")).repartition("symbol", "pattern_id").sortWithinPartitions("symbol", "pattern_id", "bar_index")

    def fold(batches):
        key, wait, edge = None, 0, None
        for batch in batches:
            keep = []
            for r in batch.itertuples(index=False):
                if (r.symbol, r.pattern_id) != key:
                    key, wait, edge = (r.symbol, r.pattern_id), 0, None
                fires = False
                if r.bar_index >= wait:
                    if not r.crossed:
                        edge = None
                    elif edge is None or (r.before - edge) * r.sign < 0:
                        fires, edge, wait = True, r.edge, r.bar_index + COOLDOWN + 1
                keep.append(fires)
            yield batch[keep][["symbol", "bar_start", "bar_index", "pattern_id", "bias", "level", "strong"]]

    return sparse.mapInPandas(fold, "symbol string, bar_start timestamp_ntz, bar_index int, pattern_id string, bias string, level double, strong boolean")


WATCH = 24


def double_outcomes(df: DataFrame, top: bool = True, cfg: PatternConfig = PatternConfig(), more: tuple[str, ...] = ()) -> DataFrame:
    """Each double setup with its status (tentative, confirmed, failed, expired) and the bar that decided it.

    A setup is known pivot_bars after its second pivot. The bars watched are listed by index, so they
    join on (symbol, bar_index) and a setup meets at most WATCH rows. more: further columns of the setups to return.
    """
    setups = double_setups(df, top, cfg)
    at_second = df.select("symbol", F.col("bar_index").alias("i2"), "atr", "bar_range", (F.count(F.lit(1)).over(Window.partitionBy("symbol")) - 1).alias("last"))
    s = setups.join(at_second, ["symbol", "i2"]).withColumn("known", F.col("i2") + cfg.pivot_bars).filter("known <= last")
    s = s.withColumns({"outer": F.greatest("p1", "p2") if top else F.least("p1", "p2"), "tol": tolerance(F.col("neckline"), cfg)}).withColumn("outer_tol", tolerance(F.col("outer"), cfg))
    watched = s.select("symbol", "i1", "i2", "neckline", "outer", "tol", "outer_tol", F.explode(F.sequence(F.col("known") + 1, F.col("known") + WATCH)).alias("bar_index"))
    sign = 1 if top else -1
    there = (F.col("neckline") - F.col("close")) * sign > F.col("tol")
    gone = (F.col("close") - F.col("outer")) * sign > F.col("outer_tol")
    hits = watched.join(df.select("symbol", "bar_index", "close"), ["symbol", "bar_index"]).filter(there | gone)
    first = hits.groupBy("symbol", "i1", "i2").agg(F.min_by(F.when(there, "confirmed").otherwise("failed"), "bar_index").alias("met"), F.min("bar_index").alias("at"))
    out = s.join(first, ["symbol", "i1", "i2"], "left")
    over = F.col("known") + WATCH
    status = F.coalesce("met", F.when(over <= F.col("last"), "expired").otherwise("tentative"))
    return out.select("symbol", "i1", "i2", "neckline", "known", status.alias("status"), F.coalesce("at", F.when(over <= F.col("last"), over)).alias("decided"), *more)
