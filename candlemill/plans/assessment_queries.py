"""Queries over double events, evidence groups, confidence and assessments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, assessment, detectors, evaluate, features, ranking, related, score, signals, structure, trend
from ..operators.reuse import settled
from ..sources.bars import bars_from_events, events
from .bar_queries import INTERVAL, RATES, feats, rounded
from .signal_queries import _judged

FEWEST_BARS = 20


def double_events(spark, sf):
    return structure.events(settled(feats(spark, sf))).drop("tol", "rim")


def structural_dedup(spark, sf):
    return structure.deduplicated(structure.events(settled(feats(spark, sf)))).drop("tol", "rim")


def linked_breaks(spark, sf):
    f = settled(feats(spark, sf))
    return structure.links(settled(structure.deduplicated(structure.events(f))), settled(detectors.breaks(f)))


def structural_states(spark, sf):
    f = settled(feats(spark, sf))
    return structure.states(settled(structure.deduplicated(structure.events(f))), f)


def _walked(spark, sf):
    """Features of prices that walk: each event moves its symbol's price by a step of its value, in whole two-hundredths
    of a point. Events of one price range rarely form doubles, and none that meets a break; a walk has them all."""
    path = Window.partitionBy("event_type").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.floor(F.col("value") * 100).cast("long") % 201 - 100
    moved = events(spark, sf).withColumn("value", F.lit(100.0) + F.sum(step).over(path).cast("double") / F.lit(200.0))
    return settled(features.add_features(bars_from_events(moved, INTERVAL)))


def walked_dedup(spark, sf):
    return structure.deduplicated(structure.events(_walked(spark, sf))).drop("tol", "rim")


def walked_links(spark, sf):
    f = _walked(spark, sf)
    return structure.links(settled(structure.deduplicated(structure.events(f))), settled(detectors.breaks(f)))


def walked_states(spark, sf):
    f = _walked(spark, sf)
    return structure.states(settled(structure.deduplicated(structure.events(f))), f)


def walked_eligibility(spark, sf):
    """What counts of a walk's events, doubles among them, and what the reasons are of those that do not."""
    rows = _judged(_walked(spark, sf)).select("symbol", "bar_start", "kind", "pattern_id", "state", "anchor", "age", "reason", "contribution", "volume")
    return rounded(rows, "contribution", "volume")


def canonical_groups(spark, sf):
    """One row for each evidence group: its first event, and the names of all."""
    events = settled(signals.all_events(feats(spark, sf)))
    names = events.groupBy(*assessment.KEYS).agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"), F.count(F.lit(1)).alias("events"))
    return signals.primaries(events).select(*assessment.KEYS, "pattern_id", "bias", "status").join(names, assessment.KEYS)


def _strengths(f):
    return f.select("symbol", "bar_index", ranking.strength().alias("strength"))


def _assessed(f):
    """(judged events, assessed symbols with confidence) of settled features."""
    found = related.gathered(f)
    judged = settled(score.judged(f, found.first, settled(related.states(f, found))))
    assessed = settled(score.assess(judged, trend.broad(f)))
    return judged, assessment.confidence(judged, found.events, assessed, _strengths(f))


def rule_confidence(spark, sf):
    rows = assessment.gated(_assessed(settled(feats(spark, sf)))[1])
    return rounded(rows.select("symbol", "evidence", "families", "suppressed", "volume_ratio", "rule_confidence", "bias"), "volume_ratio", "rule_confidence")


def final_assessment(spark, sf):
    f = settled(feats(spark, sf))
    near = trend.local(trend.with_breaks(f)).groupBy("symbol").agg(F.max_by("local_trend", "bar_index").alias("local_trend"))
    return rounded(assessment.final(_assessed(f)[1], near), "rule_confidence")


def score_reconciliation(spark, sf):
    return assessment.violations(*_assessed(settled(feats(spark, sf))))


def confirmation_fields(spark, sf):
    f = settled(feats(spark, sf))
    found = related.gathered(f)
    rows = found.first.join(related.states(f, found).select(*assessment.KEYS, "state"), assessment.KEYS)
    return assessment.confirmation(rows).groupBy("pattern_id", "state", "context_status", "directional_confirmation", "follow_through").agg(F.count(F.lit(1)).alias("n"))


def candle_summaries(spark, sf):
    """The bar that completes each event, with its shape."""
    f = settled(feats(spark, sf))
    shape = F.col("bar_range") > 1e-9
    place = F.when(shape, (F.col("close") - F.col("low")) / F.col("bar_range")).otherwise(0.5)
    ratios = [F.when(shape, F.col(c)).otherwise(0.0).alias(c) for c in ("body_ratio", "upper_wick_ratio", "lower_wick_ratio")]
    bars = f.select("symbol", "bar_index", "open", "high", "low", "close", *ratios, place.alias("close_location"))
    rows = signals.all_events(f).select("symbol", "bar_index", "pattern_id", "bias").join(bars, ["symbol", "bar_index"])
    return rounded(rows, "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "close_location")


def break_evidence(spark, sf):
    """What a break score of four or more says."""
    text = F.when(F.col("break_score") >= 4, "Price confirmed an upside break above the prior 30-bar high.").when(F.col("break_score") <= -4, "Price confirmed a downside break below the prior 30-bar low.")
    return trend.with_breaks(feats(spark, sf)).select("symbol", "bar_start", text.alias("evidence")).filter("evidence IS NOT NULL")


def historical_signals(spark, sf):
    """Directional first events as they stood at their own bar, from the twentieth bar on. Features, detectors and trends
    look back only, so one pass gives what a run over each prefix of the bars would."""
    f = settled(feats(spark, sf))
    at = f.select("symbol", "bar_index", F.col("close").alias("entry_price"), "session_segment", ranking.strength().alias("strength"))
    first = signals.primaries(signals.all_events(f)).filter(f"bias <> 'Neutral' AND status <> 'candidate' AND bar_index >= {FEWEST_BARS - 1}")
    trends = trend.broad(f).select("symbol", "bar_index", "trend")
    return first.select(*assessment.KEYS, "bar_index", "pattern_id", "bias", "status").join(at, ["symbol", "bar_index"]).join(trends, ["symbol", "bar_index"])


def _signals_asof(f):
    """Directional first events with the assessment of their symbol at their own bar."""
    found = related.gathered(f)
    own = found.plain.filter(f"bias <> 'Neutral' AND status <> 'candidate' AND bar_index >= {FEWEST_BARS - 1}")
    at = own.select("symbol", F.col("bar_index").alias("as_of"))
    then = asof.assessed_at(f, found, trend.broad(f).select("symbol", "bar_index", "trend"), _strengths(f), at)
    then = then.select("symbol", F.col("as_of").alias("bar_index"), "trend", "bullish", "bearish", "volume", "conflict", "market_state", F.col("bias").alias("overall_bias"), "evidence", "rule_confidence", evaluate.confidence_bucket(F.col("rule_confidence")).alias("bucket"))
    return own.select(*assessment.KEYS, "bar_index", "pattern_id", "bias", "status").join(then, ["symbol", "bar_index"])


def signals_asof(spark, sf):
    """Directional first events with trend, market state, bias and confidence as of their own bar, from the twentieth bar on."""
    return rounded(_signals_asof(settled(feats(spark, sf))), "bullish", "bearish", "volume", "conflict", "rule_confidence")


def backtest_by_bucket(spark, sf):
    """Outcomes of the signals that counted at their own bar, by the confidence their symbol had there, and by what it said."""
    f = settled(feats(spark, sf))
    then = _signals_asof(f).filter("status = 'confirmed'")
    rows = evaluate.outcomes(f, then.select(*assessment.KEYS, "bar_index", "pattern_id", "bias"))
    rows = rows.join(then.select("symbol", "bar_index", "pattern_id", "bucket", F.concat_ws(" | ", "trend", "market_state", "overall_bias").alias("context")), ["symbol", "bar_index", "pattern_id"])
    return rounded(evaluate.grouped_summaries(rows, {"bucket": F.col("bucket"), "context": F.col("context")}), *RATES)


QUERIES = {
    f.__name__: f
    for f in (walked_dedup, walked_links, walked_states, walked_eligibility, double_events, structural_dedup, linked_breaks, structural_states, canonical_groups, rule_confidence, final_assessment, score_reconciliation, confirmation_fields, candle_summaries, break_evidence, historical_signals, signals_asof, backtest_by_bucket)
}
