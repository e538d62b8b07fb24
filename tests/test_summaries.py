"""Grouped summaries and exact medians against plain Python."""

import random
import statistics

from pyspark.sql import functions as F

from candlemill.operators import evaluate


def test_medians_over_partitions(spark):
    draw = random.Random(2)
    rows = [(draw.choice("abc"), float(draw.choice([1, 2, 2, 2, 7, draw.random()]))) for _ in range(999)] + [("one", 3.0), ("two", 1.0), ("two", 2.0)] + [("hot", 5.0)] * 2000
    got = {r.k: r.median for r in evaluate.medians(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert got == {k: statistics.median(x for j, x in rows if j == k) for k in {j for j, _ in rows}}
    assert evaluate.medians(spark.createDataFrame([], "k string, x double"), ["k"], "x").count() == 0


def test_groups(spark):
    draw = random.Random(4)
    touches = ("target_first", "stop_first", "neither_hit", "both_same_bar")
    rows = [(draw.choice(["Bullish", "Bearish"]), h, round(draw.uniform(-1, 1), 3) if i % 7 else 0.0, draw.random(), -draw.random(), draw.choice(touches), draw.choice(["x", "y", None])) for i in range(60) for h in (1, 3)]
    rows += [("Bullish", 6, None, None, None, "insufficient_future_bars", "x"), ("Bullish", 6, None, None, None, "insufficient_future_bars", "z")]
    frame = spark.createDataFrame(rows, "bias string, horizon int, directional_return double, mfe double, mae double, touch string, g string")
    got = {(r.kind, r.value, r.horizon): r for r in evaluate.grouped_summaries(frame, {"overall": None, "g": F.col("g")}).collect()}
    assert set(got) == {(k, v, h) for k, v in (("overall", "all"), ("g", "x"), ("g", "y")) for h in (1, 3, 6)}
    for (kind, value, h), r in got.items():
        own = [x for x in rows if x[1] == h and x[2] is not None and (kind == "overall" or x[6] == value)]
        assert r.signals == len(own) and r.wins == sum(x[2] > 0 for x in own) and r.flat == sum(x[2] == 0 for x in own)
        if not own:
            assert r.mean_return is None and r.median_raw is None and r.expectancy is None
            continue
        trades = [0.01 if x[5] == "target_first" else -0.005 if x[5] == "stop_first" else x[2] for x in own]
        raws = [x[2] if x[0] == "Bullish" else -x[2] for x in own]
        for a, b in ((r.expectancy, statistics.mean(trades)), (r.win_rate, sum(t > 0 for t in trades) / len(own)), (r.median_raw, statistics.median(raws)), (r.mean_raw, statistics.mean(raws)), (r.median_mae, statistics.median(x[4] for x in own)), (r.neither_rate, sum(x[5] == "neither_hit" for x in own) / len(own))):
            assert abs(a - b) < 1e-9
