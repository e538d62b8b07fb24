"""Doubles as events, their links, and assessments, on literal rows."""

import datetime as dt

from candlemill.operators import assessment, related, structure

DOUBLE = "symbol string, pattern_id string, bias string, i1 int, i2 int, p1 double, p2 double, neckline double, tol double, strength double, status string, bar_index int, price double, confirmation int, rim double"


def double(i1=2, p1=105.0, status="confirmed", bar=13, price=97.2, i2=10, neckline=97.8, strength=6.6, name="double_top", rim=105.0):
    bias = "Bearish" if name == "double_top" else "Bullish"
    return ("S", name, bias, i1, i2, p1, 104.9, neckline, 0.2, strength, status, bar, price, bar if status == "confirmed" else None, rim)


def test_setups_of_one_second_pivot_are_one_event(spark):
    rows = [double(), double(i1=4, p1=105.1, strength=6.9), double(i1=6, p1=104.95, strength=6.9), double(i1=3, neckline=95.0, strength=9.0), double(status="tentative", bar=12, price=97.8), double(i2=11)]
    got = structure.deduplicated(spark.createDataFrame(rows, DOUBLE)).collect()
    # the strongest stands for its kin, the earlier one of two; another neckline, stage or second pivot stays apart
    assert sorted((r.i2, r.status, r.i1, r.members) for r in got) == [(10, "confirmed", 3, 1), (10, "confirmed", 4, 3), (10, "tentative", 2, 1), (11, "confirmed", 2, 1)]
    again = structure.deduplicated(spark.createDataFrame(rows[::-1], DOUBLE)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_later_rows_are_held_against_the_leader(spark):
    # each price is within 0.5 % of the one before, but the third is not of the first
    rows = [double(i1=2, p1=100.0, strength=5.0), double(i1=3, p1=100.4, strength=6.0), double(i1=4, p1=100.8, strength=7.0)]
    got = structure.deduplicated(spark.createDataFrame(rows, DOUBLE)).collect()
    assert sorted((r.i1, r.members) for r in got) == [(3, 2), (4, 1)]


def test_links(spark):
    rows = [double(), double(status="tentative", bar=12, price=97.8), double(i2=20, bar=30, i1=15)]
    breaks = [("S", "breakdown", 14, 97.9), ("S", "breakdown", 12, 98.5), ("S", "breakout", 13, 97.8), ("S", "breakdown", 30, 98.6), ("T", "breakdown", 13, 97.8)]
    got = structure.links(spark.createDataFrame(rows, DOUBLE), spark.createDataFrame(breaks, "symbol string, pattern_id string, bar_index int, level double")).collect()
    # a break one bar after, at the neckline; others by price alone, at the event's own bar
    assert sorted((r.i2, r.status, r.break_bar, r.relation) for r in got) == [(10, "confirmed", 14, "linked"), (10, "tentative", 12, "inferred"), (20, "confirmed", 30, "inferred")]


def test_waiting_setups_expire(spark):
    rows = [double(status="tentative", bar=12), double(status="failed", bar=14), double(i2=11, status="tentative", bar=13), double(i2=12, i1=7)]
    got = structure.states(spark.createDataFrame(rows, DOUBLE), closes(spark, [97.0] * 20)).collect()
    assert sorted((r.i2, r.state, r.since) for r in got) == [(10, "expired", 19), (11, "awaiting_confirmation", 13), (12, "active", 13)]


def closes(spark, prices):
    """Bars whose tolerance at prices about 100 is 0.15."""
    return spark.createDataFrame([("S", i, float(p)) for i, p in enumerate(prices)], "symbol string, bar_index int, close double").selectExpr("*", "timestamp_ntz '2026-07-10 00:00:00' + make_dt_interval(0, bar_index) AS bar_start", "close AS open", "close + 0.1 AS high", "close - 0.1 AS low", "1.0D AS atr", "0.2D AS bar_range")


def test_confirmed_doubles_end(spark):
    flat = [97.0] * 30
    told = lambda rows, prices: sorted((r.i2, r.state, r.since) for r in structure.states(spark.createDataFrame(rows, DOUBLE), closes(spark, prices)).collect())
    # a close has to pass the rim by more than the tolerance; the first such close counts
    assert told([double(rim=105.2)], flat[:20] + [105.34, 106.0, 107.0]) == [(10, "invalidated", 21)]
    assert told([double(rim=105.2)], flat[:20] + [105.34]) == [(10, "active", 13)]
    # age 16 still lives, 17 is expired at that bar, also when it is passed long since
    assert told([double()], flat) == [(10, "active", 13)] and told([double()], flat + [97.0]) == [(10, "expired", 30)] and told([double()], flat * 2) == [(10, "expired", 30)]
    assert told([double(bar=29)], flat) == [(10, "new", 29)]
    bottom = double(name="double_bottom", rim=96.5)
    assert told([bottom], flat[:20] + [96.36]) == [(10, "active", 13)] and told([bottom], flat[:20] + [96.0]) == [(10, "invalidated", 20)]
    # the confirmation stands for its group, and other events of the group have no state of their own
    assert told([double(), double(status="tentative", bar=12)], flat) == [(10, "active", 13)]


def test_rim_of_merged_setups(spark):
    rows = [double(rim=105.0), double(i1=4, p1=105.1, strength=6.9, rim=105.4), double(i1=6, p1=104.95, strength=6.9, rim=104.95)]
    (got,) = structure.deduplicated(spark.createDataFrame(rows, DOUBLE)).collect()
    assert (got.i1, got.rim, got.members) == (4, 105.4, 3)
    low = [double(name="double_bottom", rim=95.0), double(i1=4, name="double_bottom", rim=94.5, strength=6.9)]
    (got,) = structure.deduplicated(spark.createDataFrame(low, DOUBLE)).collect()
    assert (got.i1, got.rim) == (4, 94.5)


def test_what_is_linked_counts_once(spark):
    """Doubles d and breaks b in the star of one break; kind names the row."""
    row = lambda kind, pattern, at, star, worth, age=1, reason=None, strong=False, bias="Bearish", symbol="S": (symbol, kind, pattern, bias, at, star, float(worth), age, reason, strong, 2.5)
    schema = "symbol string, kind string, pattern_id string, bias string, bar_index int, star int, contribution double, age int, reason string, strong boolean, _volume double"

    def left_out(*rows):
        got = related.without_linked(spark.createDataFrame(list(rows), schema)).collect()
        assert all(r.contribution == 0 and r._volume == 0 for r in got if r.reason == related.LINKED) and len(got) == len(rows)
        return sorted(r.kind for r in got if r.reason == related.LINKED)

    d = lambda kind, worth, **more: row(kind, "double_top", 12, 13, worth, **more)
    b = lambda worth, **more: row("b", "breakdown", 13, None, worth, **more)
    # the double stands for its break; beside a break that outweighs them all, the best double alone
    assert left_out(d("d1", -20), b(-18)) == ["b"]
    assert left_out(d("d1", -20), d("d2", -17), b(-18)) == ["b"]
    assert left_out(d("d1", -20), d("d2", -17), b(-29.9, strong=True)) == ["b", "d2"]
    # equal ones: the younger, then a plain break, doubles, a strong break, then the kind
    assert left_out(d("d1", -17, age=3), d("d2", -17, age=2), b(-29.9)) == ["b", "d1"]
    assert left_out(d("d1", -17), d("d2", -17), b(-17)) == ["b", "d2"] and left_out(d("d1", -17), d("d2", -17), b(-17, strong=True)) == ["b"]
    # what cannot count silences nobody and keeps its reason
    assert left_out(d("d1", 0, reason="invalidated"), b(-18)) == [] and left_out(d("d1", -20), d("d2", -17), b(0, reason="expired")) == []
    # another side, symbol or bar, an unlinked double at the bar of its own, candles
    assert left_out(d("d1", -20), row("up", "breakout", 13, None, 18, bias="Bullish"), b(-18, symbol="T"), row("far", "breakdown", 19, None, -18), row("star", "shooting_star", 13, None, -10)) == []
    assert left_out(row("alone", "double_top", 13, None, -20), row("candle", "evening_star", 13, None, -16)) == []


def assessed(spark, rows):
    return spark.createDataFrame(rows, "symbol string, trend string, bullish double, bearish double, volume double, net double, conflict double, market_state string, bias string")


def test_confidence(spark):
    day = dt.datetime(2026, 7, 10, 9, 30)
    judged = [("S", day, "engulfing:Bullish", 7, "bullish_engulfing", "Bullish", "confirmed", 0, None, True), ("S", day, "candlestick", 7, "morning_star", "Bullish", "confirmed", 0, None, False), ("S", day, "breakout", 5, "breakout", "Bullish", "confirmed", 2, None, False)]
    judged.append(("S", day, "inside:Bullish", 3, "hammer", "Bullish", "confirmed", 4, assessment.CLUSTERED, False))
    j = spark.createDataFrame(judged, "symbol string, bar_start timestamp_ntz, kind string, bar_index int, pattern_id string, bias string, status string, age int, reason string, loud boolean")
    mate = spark.createDataFrame([("S", day, "candlestick", 7, "doji", "Neutral", "candidate", 0, None, False), ("S", day, "candlestick", 7, "hammer", "Bullish", "tentative", 0, None, False)], j.schema)
    a = assessed(spark, [("S", "Uptrend", 30.0, 0.0, 2.5, 44.5, 0.0, "Bullish Continuation", "Bullish"), ("T", "Downtrend", 0.0, 0.0, 0.0, -12.0, 0.0, "Trend Only", "Neutral"), ("U", "Neutral", 0.0, 0.0, 0.0, 0.0, 0.0, "Neutral", "Neutral")])
    strengths = spark.createDataFrame([("S", 7, 1.5), ("S", 5, 4.5)], "symbol string, bar_index int, strength double")
    got = {r.symbol: r for r in assessment.confidence(j, j.unionByName(mate), a, strengths).collect()}
    recency = (1 + 1 + 0.85**2) / 3
    # 3 events of 2 families, one of two bars loud, one mate and one clustered event
    want = 18 + 3 * 7 + 3 * 6 + 18 * recency + 14 * (0.5 + 0.5 + 1) / 3 + 8 * 0.5 + 8 - 2 * 4 - 3 - 4 - 10 * (1 - recency)
    assert (got["S"].evidence, got["S"].families, got["S"].suppressed, got["S"].volume_ratio) == (3, 2, 2, 0.5)
    assert got["S"].rule_confidence == round(want, 1) and (got["T"].rule_confidence, got["U"].rule_confidence) == (12.0, 5.0)
    warned = {r.symbol: r.rule_confidence for r in assessment.confidence(j, j, a, strengths, warnings=9).collect()}
    assert warned["S"] == round(want + 4 - 25, 1)


def test_the_gate_sees_one_digit(spark):
    """27.96 is 28.0 and passes, 27.94 does not."""
    day = dt.datetime(2026, 7, 10, 9, 30)
    one = spark.createDataFrame([("S", day, "k", 7, "bullish_engulfing", "Bullish", "confirmed", 0, None, False, 0.0)], "symbol string, bar_start timestamp_ntz, kind string, bar_index int, pattern_id string, bias string, status string, age int, reason string, loud boolean, own_strength double")
    none = spark.createDataFrame([], "symbol string, bar_index int, strength double")
    # 18 + 7 + 6 + 18 = 49 and what the conflict takes
    for taken, shown, bias in ((21.04, 28.0, "Bullish"), (21.06, 27.9, "Neutral")):
        a = assessed(spark, [("S", "Neutral", 30.0, 0.0, 0.0, 30.0, taken / 20, "Bullish Setup", "Bullish")])
        (got,) = assessment.gated(assessment.confidence(one, one, a, none)).collect()
        assert (got.rule_confidence, got.bias) == (shown, bias)


def test_linked_events_lower_the_confidence(spark):
    day = dt.datetime(2026, 7, 10, 9, 30)
    rows = [("S", day, "structural:double_top:10:9780", 13, "double_top", "Bearish", "confirmed", 0, None, False, 6.0), ("S", day, "breakdown", 13, "breakdown", "Bearish", "confirmed", 0, related.LINKED, False, None)]
    j = spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, kind string, bar_index int, pattern_id string, bias string, status string, age int, reason string, loud boolean, own_strength double")
    a = assessed(spark, [("S", "Downtrend", 0.0, 20.0, 0.0, -32.0, 0.0, "Bearish Continuation", "Bearish")])
    (got,) = assessment.confidence(j, j, a, spark.createDataFrame([("S", 13, 1.5)], "symbol string, bar_index int, strength double")).collect()
    # the double's own depth counts as strength, not that of its bar
    assert (got.evidence, got.suppressed, got.rule_confidence) == (1, 1, 18.0 + 7 + 6 + 18 + 14 + 8 - 4)


def test_confirmation_of_doubles(spark):
    rows = [("double_top", "confirmed", "invalidated"), ("double_top", "failed", "failed"), ("double_bottom", "tentative", "awaiting_confirmation"), ("double_bottom", "tentative", "expired")]
    got = assessment.confirmation(spark.createDataFrame(rows, "pattern_id string, status string, state string")).collect()
    assert [(r.directional_confirmation, r.follow_through) for r in got] == [("Confirmed", "Present"), ("Failed", "Failed"), ("Pending", "Pending"), ("Not Required", "Not Applicable")]
    assert {r.context_status for r in got} == {"Not Applicable"}


def test_final_assessment(spark):
    from pyspark.sql import functions as F

    state = ("Bullish Setup", "Bullish")
    rows = [("A", "Uptrend", 30.0, 0.0, 0.0, 42.0, 0.0, *state), ("B", "Downtrend", 30.0, 0.0, 0.0, 18.0, 0.0, *state), ("C", "Uptrend", 30.0, 5.0, 0.0, 37.0, 0.16, *state), ("D", "Uptrend", 30.0, 0.0, 0.0, 42.0, 0.0, "Bearish Setup", "Bearish"), ("E", "Uptrend", 30.0, 0.0, 0.0, 42.0, 0.0, *state)]
    sure = F.when(F.col("symbol") == "E", 20.0).when(F.col("symbol") == "D", 35.0).otherwise(70.0)
    local = spark.createDataFrame([("A", "Uptrend"), ("B", "Downtrend"), ("C", "Downtrend"), ("D", "Neutral")], "symbol string, local_trend string")
    got = {r.symbol: r for r in assessment.final(assessed(spark, rows).withColumn("rule_confidence", sure), local).collect()}
    assert {k: (r.recommendation, r.confidence_level) for k, r in got.items()} == {"A": ("RECOMMEND TO BUY", "HIGH"), "B": ("NEUTRAL", "MEDIUM"), "C": ("NEUTRAL", "MEDIUM"), "D": ("NEUTRAL", "MEDIUM"), "E": ("NEUTRAL", "LOW")}
    assert got["B"].reasons == "the broader trend is Downtrend, opposing the bias" and got["E"].bias == "Neutral" and got["E"].reasons == ""
    assert got["C"].reasons.count(";") == 1 and "disagree" in got["C"].reasons
