"""Queries over trends, breaks and double patterns of the bars."""

from __future__ import annotations

from ..operators import detectors, trend
from .bar_queries import feats

KEY = ("symbol", "bar_start")


def break_structure_score(spark, sf):
    return trend.with_breaks(feats(spark, sf)).filter("break_score <> 0").select(*KEY, "break_score")


def trend_broad(spark, sf):
    each = [f"{k}_{c}" for k in trend.HORIZONS for c in ("label", "score")]
    return trend.broad(feats(spark, sf)).select(*KEY, *each, "trend_score", "trend")


def trend_local(spark, sf):
    return trend.local(trend.with_breaks(feats(spark, sf))).select(*KEY, "local_trend", "local_score")


def prior_context(spark, sf):
    return trend.entry_context(trend.with_breaks(feats(spark, sf))).select(*KEY, "entry_direction", "entry_score", "entry_move", "entry_quality")


def rejection_patterns(spark, sf):
    return trend.rejections(feats(spark, sf))


def breakout_final(spark, sf):
    return detectors.breaks(feats(spark, sf))


def double_top(spark, sf):
    return detectors.double_outcomes(feats(spark, sf), True)


def double_bottom(spark, sf):
    return detectors.double_outcomes(feats(spark, sf), False)


QUERIES = {f.__name__: f for f in (break_structure_score, trend_broad, trend_local, prior_context, rejection_patterns, breakout_final, double_top, double_bottom)}
