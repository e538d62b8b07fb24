"""Registry, retries, zones, ranking and the command line on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from candlemill import api
from candlemill.functions import zones
from candlemill.operators import features, ranking, sessions

from test_bars import FLAT, bars, series


def test_registry(spark):
    mine = api.Detector("tall_bar", lambda rows, cfg: rows.filter("bar_range > 3").select("symbol", "bar_start", "bar_index", F.lit("tall_bar").alias("pattern_id"), F.lit("Neutral").alias("bias")), base=3)
    before = api.built_in()
    after = before.register(mine)
    assert len(after.detectors) == len(before.detectors) + 1 == 13 and after.details()[-1] == {"pattern_id": "tall_bar", "label": "Tall Bar", "priority": 9, "base": 3}
    with pytest.raises(ValueError):
        after.register(mine)
    rows = features.add_features(bars(spark, series(6, {3: (100.0, 104.0, 99.0, 100.2, 900.0)})))
    assert [(r.bar_index, r.pattern_id) for r in api.Registry().register(mine).detect(rows).collect()] == [(3, "tall_bar")]


def test_retry():
    pauses, tries = [], []

    def load():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("away")
        return "bars"

    assert api.with_retry(load, sleep=pauses.append) == "bars" and pauses == [0.5, 1.0]
    with pytest.raises(OSError):
        api.with_retry(lambda: (_ for _ in ()).throw(OSError("away")), attempts=2, sleep=pauses.append)


def test_zones_over_a_change_of_clocks(spark):
    zone = F.lit("America/New_York")
    instants = [dt.datetime(2026, 3, 8, 6, 59), dt.datetime(2026, 3, 8, 7, 0), dt.datetime(2026, 7, 10, 13, 30), dt.datetime(2026, 1, 5, 21, 0)]
    df = spark.createDataFrame([(x,) for x in instants], "bar_start timestamp_ntz")
    at = F.col("bar_start")
    got = df.select(zones.to_local(at, zone).alias("local"), zones.iso_text(at, zone).alias("iso"), zones.display_text(at, zone).alias("display"), zones.compact_text(at, zone).alias("compact"), zones.to_utc(zones.to_local(at, zone), zone).alias("back"), at).collect()
    assert [r.iso for r in got] == ["2026-03-08T01:59-05:00", "2026-03-08T03:00-04:00", "2026-07-10T09:30-04:00", "2026-01-05T16:00-05:00"]
    assert got[2].display == "2026-07-10 09:30:00-0400 America/New_York" and got[3].compact == "2026-01-05 16:00 America/New_York"
    assert all(r.back == r.bar_start for r in got)
    segments = sessions.in_zone(df.withColumn("exchange_timezone", zone)).orderBy("bar_start").collect()
    assert [r.session_segment for r in segments] == ["afterhours", "premarket", "premarket", "regular"]


def test_ranks(spark):
    row = lambda name, status, state, worth, at, priority=3: ("S", name, status, state, float(worth), at, 20, priority, "k", "Bullish")
    rows = [row("e", "expired", "new", 9, 20), row("t", "tentative", "new", 9, 20), row("old", "confirmed", "new", 5, 10), row("a", "confirmed", "new", -5, 20), row("b", "confirmed", "active", 50, 20), row("z", "confirmed", "new", 5, 20, 2)]
    df = spark.createDataFrame(rows, "symbol string, name string, status string, state string, contribution double, bar_index int, last int, priority int, kind string, bias string")
    assert [r.name for r in ranking.ranked(df).orderBy("rank").collect()] == ["z", "a", "old", "b", "t", "e"]
    assert ranking.top(df).count() == 3


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "bars.csv")
    bars(spark, [FLAT, (100.0, 101.0, 99.0, 100.02, 1500)] * 15).withColumnRenamed("bar_start", "Datetime").drop("symbol").toPandas().to_csv(path, index=False)
    assert api.main(["analyze", "ABC", "--data-file", path, "--interval", "15m"]) == 0
    assert capsys.readouterr().out.startswith("ABC: ")
    assert api.main(["analyze", "ABC", "--data-file", path, "--preset", "1_DAY", "--format", "json", "--output", str(tmp_path / "a.json")]) == 0
    assert '"market_state"' in (tmp_path / "a.json").read_text()
    assert api.main(["analyze", "ABC", "--data-file", str(tmp_path / "none.csv")]) == 3
    assert api.main(["analyze", "ABC", "--data-file", path, "--output", str(tmp_path / "no" / "a.json")]) == 8


def test_warnings_and_strict_mode(spark):
    from candlemill.operators import validate

    rows = bars(spark, [FLAT, (100.0, 99.0, 98.0, 98.5, 10.0), FLAT]).withColumn("input_id", -features.F.monotonically_increasing_id())
    r = validate.warnings(rows, "15m", "2026-07-10 10:00:00").first()
    assert r.warnings[0] == r.strict_error == "Input timestamps were unsorted." and r.warnings[-1].endswith("relative to interval 15m.")
    with pytest.raises(ValueError, match="unsorted"):
        validate.strict(rows, "15m", "2026-07-10 10:00:00")
    fine = bars(spark, [FLAT] * 3).withColumn("input_id", features.F.monotonically_increasing_id())
    assert validate.strict(fine, "15m", "2026-07-10 10:00:00").count() == 3


def test_chain_of_rejections_counts_once(spark):
    """Three upper rejections in one zone and, far above, another: the best of the three counts, for two repetitions more."""
    from candlemill.operators import score, signals

    row = lambda i, zone, worth, pattern="shooting_star", bias="Bearish": ("S", START_DAY + dt.timedelta(hours=i), "candlestick", i, pattern, bias, "confirmed", 10, zone, worth, -2.5, None)
    rows = [row(1, 100.0, -8.0), row(3, 100.2, -10.0), row(8, 100.1, -7.0), row(9, 103.0, -6.0), row(2, 100.0, 15.0, "bullish_engulfing", "Bullish")]
    rows[4] = (*rows[4][:6], "tentative", *rows[4][7:8], None, *rows[4][9:])
    df = spark.createDataFrame(rows, "symbol string, bar_start timestamp_ntz, kind string, bar_index int, pattern_id string, bias string, status string, base int, zone double, contribution double, volume double, reason string")
    got = {r.bar_index: (r.contribution, r.volume, r.reason) for r in score.bounded(df).collect()}
    left = (0.0, 0.0, "clustered correlated evidence")
    assert got == {1: left, 3: (-13.0, -2.5, None), 8: left, 9: (-6.0, -2.5, None), 2: (15.0, -2.5, None)}
    (chain,) = signals.clusters(df.drop("reason")).collect()
    assert (chain.first_bar, chain.last_bar, chain.members, chain.family, chain.bounded) == (1, 8, 3, "candlestick_reversal", -13.0)


START_DAY = dt.datetime(2026, 7, 10)
