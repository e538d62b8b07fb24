"""Assessments as of each bar against a plain run of the whole engine over every prefix."""

import pytest
from pyspark.sql import functions as F

from candlemill.operators import asof, assessment, related, trend
from candlemill.operators.reuse import settled
from candlemill.plans import assessment_queries as plans

SF, FIRST, LAST = "/root/testdata/sf0.01", 19, 130


@pytest.fixture(scope="module")
def features(spark):
    # walking prices: six confirmed doubles of these bars meet a break, two of them the same one
    f = plans._walked(spark, SF)
    few = [r.symbol for r in f.select("symbol").distinct().orderBy("symbol").limit(2).collect()]
    # longer histories are cut, as a plain run over prefixes grows with their square
    return settled(f.filter(F.col("symbol").isin(*few) & (F.col("bar_index") <= LAST)))


def test_every_bar_equals_its_prefix(spark, features):
    ends = spark.range(FIRST, LAST + 1, 3).select(F.col("id").cast("int").alias("end"))
    prefixes = settled(features.join(ends, F.col("bar_index") <= F.col("end")).withColumn("symbol", F.concat_ws("|", "symbol", "end")).drop("end"))
    wanted = assessment.gated(plans._assessed(prefixes)[1])
    names = [c for c in wanted.columns if c != "symbol"]
    plain = {r.symbol: r for r in wanted.collect()}

    at = features.select("symbol").distinct().crossJoin(ends.withColumnRenamed("end", "as_of")).join(features.select("symbol", F.col("bar_index").alias("as_of")), ["symbol", "as_of"])
    got = asof.assessed_at(features, related.gathered(features), trend.broad(features).select("symbol", "bar_index", "trend"), plans._strengths(features), at).collect()
    both = [(f"{r.symbol}|{r.as_of}", r) for r in got]
    assert {k for k, _ in both} == {k for k in plain if int(k.split("|")[1]) <= LAST and k in dict(both)} and len(both) >= 2 * 30
    told = 0
    for k, r in both:
        for c in names:
            x, y = r[c], plain[k][c]
            assert x == y or isinstance(x, float) and abs(x - y) < 1e-9, (k, c, x, y)
        told += r.evidence > 0
    assert told >= 5


def test_a_span_ends_with_age_or_crossing(spark):
    bars = [("S", i, 100.0 + (i == 5) * 5 - (i >= 20) * 8) for i in range(40)]
    frame = spark.createDataFrame(bars, "symbol string, bar_index int, close double").selectExpr("symbol", "bar_index", "timestamp_ntz '2026-07-10 00:00:00' + make_dt_interval(0, bar_index) AS bar_start", "close AS open", "close + 1 AS high", "close - 1 AS low", "close", "1.0D AS atr", "2.0D AS bar_range", "100.5D AS rolling_high", "95.0D AS rolling_low")
    first = frame.filter("bar_index IN (5, 12)").selectExpr("symbol", "bar_start", "bar_index", "CASE WHEN bar_index = 5 THEN 'breakout' ELSE 'bullish_engulfing' END AS kind", "CASE WHEN bar_index = 5 THEN 'breakout' ELSE 'bullish_engulfing' END AS pattern_id", "'Bullish' AS bias", "12 AS max_age")
    got = sorted((r.kind, r.state, r.valid_from, r.valid_to, r.anchor) for r in asof.state_spans(frame, first).collect())
    # the break is lost on the bar after it; the engulfing lives to its greatest age, before the fall at 20 would end it
    assert [g for g in got if g[0] == "breakout"][0][1:] == ("active", 5, 5, 5)
    assert [g for g in got if g[0] == "bullish_engulfing"] == [("bullish_engulfing", "active", 12, 19, 12)]
