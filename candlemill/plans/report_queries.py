"""Queries over ranked events, their families and evidence, and sessions in the exchange's zone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking, sessions, signals
from ..operators.reuse import settled
from ..functions import zones
from ..operators import validate
from .bar_queries import AS_OF, bars, feats, quotes
from .signal_queries import _judged

ZONES = ("America/New_York", "Asia/Jerusalem")


def top_patterns(spark, sf):
    return ranking.top(_judged(settled(feats(spark, sf)))).select("symbol", "rank", "bar_start", "kind", "pattern_id", "name", "bias", "status", "state")


def analytical_families(spark, sf):
    first = signals.primaries(signals.all_events(feats(spark, sf)))
    return first.groupBy("symbol", ranking.family().alias("family"), "bias").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pattern_id").alias("patterns"))


def signal_strength(spark, sf):
    return feats(spark, sf).select("symbol", "bar_start", ranking.strength().alias("strength"))


def evidence_categories(spark, sf):
    return ranking.evidence(_judged(settled(feats(spark, sf)))).groupBy("symbol", "category", "state").agg(F.count(F.lit(1)).alias("n"))


def zoned_sessions(spark, sf):
    zoned = bars(spark, sf).withColumn("zone", F.explode(F.array(*[F.lit(z) for z in ZONES])))
    return sessions.in_zone(zoned, "zone").select("symbol", "bar_start", "zone", "local_start", "trading_date", "session_date", "session_segment")


def validation_warnings(spark, sf):
    out = validate.warnings(quotes(spark, sf), "15m", AS_OF)
    return out.select("symbol", F.concat_ws(" ", "warnings").alias("warnings"), "strict_error")


def exact_duplicates(spark, sf):
    """Events of two overlapping runs: all bars, and those of the first half of January."""
    events = signals.all_events(feats(spark, sf))
    both = events.unionByName(events.filter("bar_start < TIMESTAMP_NTZ '2024-01-15 00:00:00'"))
    return signals.distinct_events(both, "bar_start").groupBy("symbol", "pattern_id", "copies").agg(F.count(F.lit(1)).alias("n"))


def event_history(spark, sf):
    rows = ranking.history(_judged(settled(feats(spark, sf))), 10)
    return rows.select("symbol", "place", "bar_start", "kind", "pattern_id", "name", "state", "since")


def bar_labels(spark, sf):
    """Texts of bar times in a zone whose offset changes over the year."""
    at, zone = F.col("bar_start"), F.lit(ZONES[0])
    return bars(spark, sf).select("symbol", "bar_start", zones.iso_text(at, zone).alias("iso"), zones.display_text(at, zone).alias("display"), zones.compact_text(at, zone).alias("compact"))


QUERIES = {f.__name__: f for f in (top_patterns, analytical_families, signal_strength, evidence_categories, zoned_sessions, validation_warnings, exact_duplicates, event_history, bar_labels)}
