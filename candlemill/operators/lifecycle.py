"""What later bars make of an event: its state, the bar since which it holds, and the bar of a retest.

Breaks: failed (two closes in a row beyond the other edge of the zone around the level), reclaimed (one such close),
retest_rejected, retest_pending, expired, new, active. Others: invalidated, directionally_confirmed, expired, new,
retested, active. A group's state is that of its first event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PatternConfig
from .crossings import first_beyond
from .detectors import tolerance
from .features import by_time
from .reuse import settled

BREAKS, WICKS = ("breakout", "breakdown"), ("bullish_pin_bar", "hammer", "shooting_star")
#: Part of a rejection candle, from its tip, that a retest must reach.
RETEST_PART = 0.35
#: Bars that an event is made of, its own included.
SPAN = {"bullish_engulfing": 2, "bearish_engulfing": 2, "inside_bar": 2, "morning_star": 3, "evening_star": 3, "inside_bar_failure": 3}
KEY = ["symbol", "ask"]


def _ask(what: str, after: Column, field: str, over: Column | bool, x: Column, closed: bool = False) -> Column:
    return F.struct(F.lit(what).alias("what"), after.cast("int").alias("after"), F.lit(field).alias("field"), (F.lit(over) if isinstance(over, bool) else over).alias("over"), x.alias("x"), F.lit(closed).alias("closed"))


def _answers(bars: DataFrame, events: DataFrame, questions: list[Column]) -> DataFrame:
    """One row for each event with a map from question to bar."""
    asks = events.select(*KEY, F.inline(F.array_compact(F.array(*questions))))
    return first_beyond(bars, asks).groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("what", "at"))).alias("met"))


def _at(what: str, column: str = "met") -> Column:
    return F.try_element_at(column, F.lit(what))


def _expiry(reference: Column) -> Column:
    """The bar at which an event expires that nothing happened to since a bar, or null."""
    return F.when(F.col("last") - reference > F.col("max_age"), F.least("last", reference + F.col("max_age") + 1))


def _prepared(bars: DataFrame, first: DataFrame, cfg: PatternConfig) -> DataFrame:
    """Events with what the rules need of their own bars."""
    low, high = ({1: F.col(c), 2: F.least(c, F.lag(c).over(by_time())) if c == "low" else F.greatest(c, F.lag(c).over(by_time())), 3: (F.min if c == "low" else F.max)(c).over(by_time().rowsBetween(-2, 0))} for c in ("low", "high"))
    at = bars.select("symbol", "bar_index", "low", "high", "atr", "bar_range", "rolling_high", "rolling_low", *[x[k].alias(f"{n}{k}") for n, x in (("l", low), ("h", high)) for k in (2, 3)])
    ends = bars.groupBy("symbol").agg(F.max("bar_index").alias("last"))
    e = first.select("symbol", "bar_start", "bar_index", "kind", "pattern_id", "bias", "max_age").join(at, ["symbol", "bar_index"]).join(ends, "symbol")
    # of a break and its mirror image, one set of rules: prices change sign
    span = F.coalesce(*[F.when(F.col("pattern_id") == k, n) for k, n in SPAN.items()], F.lit(1))
    pick = lambda n, one: F.when(span == 3, F.col(f"{n}3")).when(span == 2, F.col(f"{n}2")).otherwise(F.col(one))
    level = F.when(F.col("pattern_id") == "breakout", F.col("rolling_high")).when(F.col("pattern_id") == "breakdown", F.col("rolling_low"))
    return e.withColumns({"level": level, "least": pick("l", "low"), "most": pick("h", "high"), "ask": F.concat_ws("|", "bar_index", "kind", "pattern_id", "bias")}).drop("l2", "l3", "h2", "h3")


def _mirrored(bars: DataFrame) -> DataFrame:
    """Bars from the last to the first."""
    return bars.withColumn("bar_index", -F.col("bar_index"))


def break_states(bars: DataFrame, events: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, ask, state, since, retest of prepared breaks. retest is given where no close was beyond the zone."""
    up = F.col("pattern_id") == "breakout"
    tol = tolerance(F.col("level"), cfg)
    e = events.filter(F.col("pattern_id").isin(*BREAKS)).withColumns({"up": up, "near": F.when(up, F.col("level") + tol).otherwise(F.col("level") - tol), "far": F.when(up, F.col("level") - tol).otherwise(F.col("level") + tol)})
    i = F.col("bar_index")
    one = _answers(bars, e, [_ask("lost", i, "close", ~up, F.col("far")), F.when(up, _ask("failed", i + 1, "pair_high", False, F.col("far"))).otherwise(_ask("failed", i + 1, "pair_low", True, F.col("far"))), F.when(up, _ask("back", i, "low", False, F.col("near"), True)).otherwise(_ask("back", i, "high", True, F.col("near"), True))])
    e = e.join(one, KEY, "left").withColumns({"lost": _at("lost"), "failed": _at("failed"), "back": _at("back")}).drop("met")
    # the last close beyond the zone is the first one from the end
    lost = e.filter("lost IS NOT NULL AND failed IS NULL")
    held = e.filter("lost IS NULL AND back IS NOT NULL")
    latest = first_beyond(_mirrored(bars), lost.select(*KEY, F.lit("latest").alias("what"), (-F.col("last") - 1).alias("after"), F.lit("close").alias("field"), (~up).alias("over"), F.col("far").alias("x"), F.lit(False).alias("closed")))
    away = first_beyond(bars, held.select(*KEY, F.lit("away").alias("what"), (F.col("back") - 1).alias("after"), F.lit("close").alias("field"), up.alias("over"), F.col("near").alias("x"), F.lit(False).alias("closed")))
    # until then closes stay inside the zone, so few bars are looked at one by one
    span = held.join(away.select(*KEY, F.col("at").alias("away")), KEY, "left")
    inside = span.filter(F.coalesce("away", F.col("last") + 1) > F.col("back")).select(*KEY, "level", "up", F.explode(F.sequence("back", F.coalesce("away", F.col("last") + 1) - 1)).alias("bar_index"))
    c, o, v = F.col("close"), F.col("open"), F.col("level")
    turned = inside.join(bars.select("symbol", "bar_index", "open", "high", "low", "close"), ["symbol", "bar_index"]).filter((F.col("up") & (c >= v) & (c > o) & (F.col("low") <= v)) | (~F.col("up") & (c <= v) & (c < o) & (F.col("high") >= v)))
    turned = turned.groupBy(*KEY).agg(F.min("bar_index").alias("turned"))
    out = e.join(latest.select(*KEY, (-F.col("at")).alias("latest")), KEY, "left").join(away.select(*KEY, F.col("at").alias("away")), KEY, "left").join(turned, KEY, "left")
    out = out.withColumns({"rejected": F.least("away", "turned"), "retest": F.when(F.col("lost").isNull(), F.col("back")), "over": _expiry(i)})
    state = F.when(F.col("failed").isNotNull(), F.when(F.col("up"), "failed_breakout").otherwise("failed_breakdown")).when(F.col("lost").isNotNull(), "reclaimed").when(F.col("rejected").isNotNull(), "retest_rejected").when(F.col("retest").isNotNull(), "retest_pending").when(F.col("over").isNotNull(), "expired").when(i == F.col("last"), "new").otherwise("active")
    since = F.coalesce("failed", "latest", "rejected", "retest", "over", "bar_index")
    return out.select(*KEY, state.alias("state"), since.cast("int").alias("since"), F.col("retest").cast("int").alias("retest"))


def candle_questions(cfg: PatternConfig) -> list[Column]:
    """What ends or confirms an event that is no break."""
    p, i = F.col("pattern_id"), F.col("bar_index")
    under = F.when(p == "bullish_pin_bar", F.col("least")).when(p == "shooting_star", None).when(F.col("bias") == "Bullish", F.col("least") - tolerance(F.col("least"), cfg))
    over = F.when(p == "shooting_star", F.col("most")).when(p == "bullish_pin_bar", None).when(F.col("bias") == "Bearish", F.col("most") + tolerance(F.col("most"), cfg))
    done_over = F.when(p.isin("bullish_pin_bar", "hammer"), F.col("high") + tolerance(F.col("high"), cfg))
    done_under = F.when(p == "shooting_star", F.col("low") - tolerance(F.col("low"), cfg))
    return [_ask(w, i, "close", o, x) for w, o, x in (("bad_under", False, under), ("bad_over", True, over), ("good_over", True, done_over), ("good_under", False, done_under))]


def candle_states(bars: DataFrame, events: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, ask, state, since, retest of prepared events other than breaks. retest is given where nothing else happened."""
    p, i = F.col("pattern_id"), F.col("bar_index")
    e = events.filter(~p.isin(*BREAKS))
    lower = p.isin("bullish_pin_bar", "hammer")
    one = _answers(bars, e, candle_questions(cfg))
    e = e.join(one, KEY, "left").withColumns({"bad": F.least(_at("bad_under"), _at("bad_over")), "good": F.least(_at("good_over"), _at("good_under"))}).drop("met")
    # rejection candles that nothing ended: closes stay within the candle, whose retest is looked for bar by bar
    zone = F.when(lower, F.col("low") + (F.col("high") - F.col("low")) * RETEST_PART).otherwise(F.col("high") - (F.col("high") - F.col("low")) * RETEST_PART)
    open_ones = e.filter(p.isin(*WICKS) & F.col("bad").isNull() & F.col("good").isNull() & (F.col("last") > i)).select(*KEY, lower.alias("lower"), zone.alias("zone"), F.explode(F.sequence(i + 1, "last")).alias("bar_index"))
    z = F.col("zone")
    met = open_ones.join(bars.select("symbol", "bar_index", "high", "low", "close"), ["symbol", "bar_index"]).filter((F.col("lower") & (F.col("low") <= z) & (F.col("close") > z)) | (~F.col("lower") & (F.col("high") >= z) & (F.col("close") < z)))
    out = e.join(met.groupBy(*KEY).agg(F.min("bar_index").alias("retest")), KEY, "left")
    out = out.withColumn("over", _expiry(F.coalesce("retest", "bar_index")))
    invalid, confirmed = F.col("bad") <= F.coalesce("good", "bad"), F.col("good").isNotNull()
    state = F.when(invalid, "invalidated").when(confirmed, "directionally_confirmed").when(F.col("over").isNotNull(), "expired").when(i == F.col("last"), "new").when(F.col("retest").isNotNull(), "retested").otherwise("active")
    since = F.when(invalid, F.col("bad")).otherwise(F.coalesce("good", "over", "retest", "bar_index"))
    return out.select(*KEY, state.alias("state"), since.cast("int").alias("since"), F.col("retest").cast("int").alias("retest"))


def states(bars: DataFrame, first: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """The first event of each evidence group with state, since and retest."""
    e = settled(_prepared(bars, first, cfg))
    bars = settled(bars.select("symbol", "bar_start", "bar_index", "open", "high", "low", "close"))
    rows = break_states(bars, e, cfg).unionByName(candle_states(bars, e, cfg))
    return e.select(*KEY, "bar_start", "bar_index", "kind", "pattern_id", "bias", "max_age", "last").join(rows, KEY).drop("ask")
