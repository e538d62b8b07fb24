"""Queries over events: of the candle, rejection and break detectors, and, where events are judged, of doubles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, lifecycle, related, score, signals, trend
from ..operators.reuse import settled
from ..sources.bars import bars_from_events, events
from .bar_queries import INTERVAL, feats, rounded


def market_context_counts(spark, sf):
    return signals.all_events(feats(spark, sf)).groupBy("symbol", "pattern_id", "bias", "status").agg(F.count(F.lit(1)).alias("n"))


def group_primary_top1(spark, sf):
    return signals.primaries(signals.all_events(feats(spark, sf))).select("symbol", "bar_start", "kind", "pattern_id", "name", "bias", "status", "base")


def cluster_islands(spark, sf):
    """Prices of the table drawn together, so that zones meet as those of one instrument do."""
    near = events(spark, sf).withColumn("value", F.lit(100.0) + F.col("value") / F.lit(1000.0))
    f = settled(features.add_features(bars_from_events(near, INTERVAL)))
    return signals.clusters(signals.primaries(signals.all_events(f)))


def signal_scores(spark, sf):
    f = feats(spark, sf)
    return rounded(signals.scores(signals.primaries(signals.all_events(f)), trend.broad(f)), "bullish", "bearish", "volume", "net")


def lifecycle_states(spark, sf):
    f = settled(feats(spark, sf))
    return lifecycle.states(f, settled(signals.primaries(signals.all_events(f)))).drop("max_age", "last")


def lifecycle_counts(spark, sf):
    return lifecycle_states(spark, sf).groupBy("pattern_id", "bias", "state").agg(F.count(F.lit(1)).alias("n"))


def _judged(f):
    """f: settled features, which every branch reads."""
    found = related.gathered(f)
    return score.judged(f, found.first, settled(related.states(f, found)))


def eligibility(spark, sf):
    rows = _judged(settled(feats(spark, sf))).select("symbol", "bar_start", "kind", "pattern_id", "state", "anchor", "age", "reason", "contribution", "volume")
    return rounded(rows, "contribution", "volume")


def market_assessment(spark, sf):
    f = settled(feats(spark, sf))
    return rounded(score.assess(_judged(f), trend.broad(f)), "bullish", "bearish", "volume", "net", "conflict")


def exclusion_reasons(spark, sf):
    return _judged(settled(feats(spark, sf))).groupBy("symbol", F.coalesce("reason", F.lit("counted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (market_context_counts, group_primary_top1, cluster_islands, signal_scores, lifecycle_states, lifecycle_counts, eligibility, market_assessment, exclusion_reasons)}
