"""Symbols as they stood at each of their bars, without running any prefix anew.

An event's later life is a few spans of bars, each with one state and one anchor, the bar its age counts from: a live
one, and where price came back to a broken level, one of the retest and one of its rejection. The first crossings of
prices that part them don't depend on when one looks; a span ends where a crossing ends it, or where the event's
greatest age is reached. So an event meets at most three times its greatest age of bars. What counts at a bar is weighed
by the rules of score.py for each (symbol, bar), as if the history ended there.

A confirmed double has one span, from its confirmation to a close beyond its rim; undecided ones cannot count.

Events in states that cannot count (failed, reclaimed, invalidated, expired) have no span, as they add nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import INTERVAL_SECONDS, PatternConfig
from . import assessment, lifecycle, score, structure
from .related import Gathered
from .crossings import first_beyond
from .detectors import tolerance
from .reuse import settled

EVENT = ["symbol", "bar_start", "kind"]


def _span(state: str, begin: Column, end: Column, anchor: Column) -> Column:
    """Bars from ``begin`` to ``end`` or to the anchor's greatest age; none where a bound is missing or crossed."""
    end = F.least(end, anchor + F.col("max_age"), F.col("last"))
    return F.when(begin <= end, F.struct(F.lit(state).alias("state"), begin.cast("int").alias("valid_from"), end.cast("int").alias("valid_to"), anchor.cast("int").alias("anchor")))


def _spans(rows: DataFrame, *spans: Column) -> DataFrame:
    return rows.select(*EVENT, F.inline(F.array_compact(F.array(*spans))))


def _before(*bars: Column) -> Column:
    """The bar before the first of some, which may be missing."""
    return F.least(*[F.coalesce(b, F.col("last") + 1) for b in bars], F.col("last") + 1) - 1


def break_spans(bars: DataFrame, events: DataFrame, cfg: PatternConfig) -> DataFrame:
    """Spans of prepared breaks."""
    key, i, up, last = lifecycle.KEY, F.col("bar_index"), F.col("pattern_id") == "breakout", F.col("last")
    tol = tolerance(F.col("level"), cfg)
    e = events.filter(F.col("pattern_id").isin(*lifecycle.BREAKS)).withColumns({"up": up, "near": F.when(up, F.col("level") + tol).otherwise(F.col("level") - tol), "far": F.when(up, F.col("level") - tol).otherwise(F.col("level") + tol)})
    back = F.when(up, lifecycle._ask("back", i, "low", False, F.col("near"), True)).otherwise(lifecycle._ask("back", i, "high", True, F.col("near"), True))
    met = lifecycle._answers(bars, e, [lifecycle._ask("lost", i, "close", ~up, F.col("far")), back])
    e = settled(e.join(met, key, "left").withColumns({"lost": lifecycle._at("lost"), "back": lifecycle._at("back")}).drop("met"))
    held = e.filter("back < coalesce(lost, last + 1)")
    away = first_beyond(bars, held.select(*key, F.lit("away").alias("what"), (F.col("back") - 1).alias("after"), F.lit("close").alias("field"), F.col("up").alias("over"), F.col("near").alias("x"), F.lit(False).alias("closed")))
    held = held.join(away.select(*key, F.col("at").alias("away")), key, "left")
    # closes stay inside the zone until then
    inside = held.withColumn("_end", _before(F.col("away"), F.col("lost"))).filter("_end >= back").select(*key, "level", "up", F.explode(F.sequence("back", "_end")).alias("bar_index"))
    c, o, v = F.col("close"), F.col("open"), F.col("level")
    turned = inside.join(bars.select("symbol", "bar_index", "open", "high", "low", "close"), ["symbol", "bar_index"]).filter((F.col("up") & (c >= v) & (c > o) & (F.col("low") <= v)) | (~F.col("up") & (c <= v) & (c < o) & (F.col("high") >= v)))
    out = e.join(held.select(*key, "away"), key, "left").join(turned.groupBy(*key).agg(F.min("bar_index").alias("turned")), key, "left")
    out = out.withColumn("rejected", F.least("away", "turned"))
    lost, back, rejected = (F.col(c) for c in ("lost", "back", "rejected"))
    return _spans(out, _span("active", i, _before(lost, back), i), _span("retest_pending", back, _before(rejected, lost), back), _span("retest_rejected", rejected, _before(lost), rejected))


def candle_spans(bars: DataFrame, events: DataFrame, cfg: PatternConfig) -> DataFrame:
    """Spans of prepared events other than breaks. A retest changes neither anchor nor worth."""
    p, i = F.col("pattern_id"), F.col("bar_index")
    e = events.filter(~p.isin(*lifecycle.BREAKS))
    met = lifecycle._answers(bars, e, lifecycle.candle_questions(cfg))
    e = e.join(met, lifecycle.KEY, "left").withColumns({"bad": F.least(lifecycle._at("bad_under"), lifecycle._at("bad_over")), "good": F.least(lifecycle._at("good_over"), lifecycle._at("good_under"))})
    good = F.when(F.col("bad").isNull() | (F.col("bad") > F.col("good")), F.col("good"))
    return _spans(e, _span("active", i, _before(F.col("bad"), F.col("good")), i), _span("directionally_confirmed", good, F.col("last"), i))


def state_spans(bars: DataFrame, first: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, bar_start, kind, state, valid_from, valid_to, anchor: a bitemporal table of the states that can count."""
    e = settled(lifecycle._prepared(bars, first, cfg))
    bars = settled(bars.select("symbol", "bar_start", "bar_index", "open", "high", "low", "close"))
    return break_spans(bars, e, cfg).unionByName(candle_spans(bars, e, cfg))


def double_spans(bars: DataFrame, doubles: DataFrame, cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """Spans of first confirmed doubles."""
    c = structure.broken_rims(doubles, bars, cfg).join(bars.groupBy("symbol").agg(F.max("bar_index").alias("last")), "symbol")
    return _spans(c, _span("active", F.col("bar_index"), _before(F.col("bad")), F.col("bar_index")))


def judged_at(bars: DataFrame, found: Gathered, at: DataFrame, interval: str = "1h", cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """The rows of score.judged that count, or whose cluster counts, at each of some bars. at: symbol, as_of. The
    symbol of a result is the pair of both."""
    step = F.make_dt_interval(secs=F.lit(INTERVAL_SECONDS[interval]))
    days = bars.select("symbol", "bar_index", F.to_date(F.col("bar_start") + step).alias("day"))
    spans = state_spans(bars, found.plain, cfg).unionByName(double_spans(bars, found.doubles, cfg))
    held = spans.join(days.select("symbol", F.col("bar_index").alias("anchor"), F.col("day").alias("anchor_day")), ["symbol", "anchor"])
    met = held.withColumn("as_of", F.explode(F.sequence("valid_from", "valid_to"))).drop("valid_from", "valid_to")
    met = met.join(at.join(days.select("symbol", F.col("bar_index").alias("as_of"), F.col("day").alias("last_day")), ["symbol", "as_of"]), ["symbol", "as_of"])
    e = found.first.join(met, EVENT).withColumns({"last": F.col("as_of"), "age": F.col("as_of") - F.col("anchor"), "since": F.col("anchor")})
    return score.weighed(e.withColumn("symbol", F.struct("symbol", "as_of")).drop("as_of"), interval)


def assessed_at(features: DataFrame, found: Gathered, broad: DataFrame, strengths: DataFrame, at: DataFrame, interval: str = "1h", cfg: PatternConfig = PatternConfig()) -> DataFrame:
    """symbol, as_of, and what assessment.confidence says of the symbol had its bars ended there, with the gated bias."""
    at = settled(at.select("symbol", F.col("as_of").cast("int").alias("as_of")).distinct())
    judged = settled(judged_at(features, found, at, interval, cfg))
    pair = F.struct("symbol", "as_of").alias("symbol")
    trends = at.join(broad.select("symbol", F.col("bar_index").alias("as_of"), "trend"), ["symbol", "as_of"]).select(pair, F.col("as_of").alias("bar_index"), "trend")
    met = judged.select(F.col("symbol").alias("_pair"), F.col("symbol.symbol").alias("symbol"), "bar_start", "kind", "bar_index")
    mates = found.events.join(met.drop("bar_index"), EVENT).withColumn("symbol", F.col("_pair")).drop("_pair")
    near = strengths.join(met.select("_pair", "symbol", "bar_index").distinct(), ["symbol", "bar_index"]).withColumn("symbol", F.col("_pair")).drop("_pair")
    rows = assessment.gated(assessment.confidence(judged, mates, settled(score.assess(judged, trends)), near))
    return rows.select(F.col("symbol.symbol").alias("symbol"), F.col("symbol.as_of").alias("as_of"), *[c for c in rows.columns if c != "symbol"])
