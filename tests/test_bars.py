"""Bar operators on small hand-made series, and every query with SQL against DuckDB."""

import datetime as dt
import os

import pytest

import __spark_entry__
from candlemill import registry
from candlemill.config import PatternConfig
from candlemill.operators import detectors, features, validate
from candlemill.sources.bars import canonical_columns, read_bars

SF = "/root/testdata/sf0.001"
START = dt.datetime(2026, 7, 10, 9, 30)
FLAT = (100.0, 100.8, 99.6, 100.2, 1000.0)


def bars(spark, rows, minutes=15):
    return spark.createDataFrame([("S", START + dt.timedelta(minutes=minutes * i), *map(float, r)) for i, r in enumerate(rows)], "symbol string, bar_start timestamp_ntz, open double, high double, low double, close double, volume double")


def series(n, changes=()):
    rows = [FLAT] * n
    for i, r in dict(changes).items():
        rows[i] = r
    return rows


def found(spark, rows, name):
    return detectors.bar_patterns(features.add_features(bars(spark, rows))).filter(f"pattern_id = '{name}'").collect()


def test_doji(spark):
    assert len(found(spark, [FLAT, (100.0, 101.0, 99.0, 100.02, 1500)], "doji")) == 1
    assert found(spark, [FLAT, (100.0, 101.0, 99.0, 100.25, 1500)], "doji") == []


def test_stars(spark):
    morning = {2: (101.2, 101.3, 99.7, 99.9, 2800), 3: (99.95, 100.05, 99.6, 99.9, 1400), 4: (99.95, 101.4, 99.9, 100.8, 2600)}
    evening = {2: (99.8, 101.3, 99.7, 101.1, 2800), 3: (101.15, 101.4, 100.9, 101.2, 1400), 4: (101.1, 101.2, 99.5, 100.0, 2600)}
    assert [r.bar_index for r in found(spark, series(5, morning), "morning_star")] == [4]
    assert [r.bar_index for r in found(spark, series(5, evening), "evening_star")] == [4]


def test_engulfing_and_inside_bars(spark):
    assert len(found(spark, series(25, {23: (99.8, 101.2, 99.7, 101.0, 2600), 24: (101.1, 101.3, 99.4, 99.6, 2800)}), "bearish_engulfing")) == 1
    assert len(found(spark, series(25, {23: (100, 105, 95, 102, 2600), 24: (101, 104, 96, 101.5, 1800)}), "inside_bar")) == 1
    failure = {22: (100, 105, 95, 102, 2500), 23: (101, 104, 96, 101.5, 2500), 24: (104.8, 105.6, 97, 100, 2600)}
    assert [r.bias for r in found(spark, series(25, failure), "inside_bar_failure")] == ["Bearish"]
    assert found(spark, series(25, failure | {24: (103.5, 104.5, 97, 97.5, 2600)}), "inside_bar_failure") == []


def test_breakout(spark):
    rows = series(30, {20: (100.10, 101.20, 100.00, 100.90, 2600)})
    got = detectors.raw_breaks(features.add_features(bars(spark, rows))).collect()
    assert [(r.pattern_id, r.bar_index) for r in got] == [("breakout", 20)]


def test_double_top(spark):
    text = "99.5,100.0,99.0,99.7|100.0,101.0,99.4,100.6|100.6,105.0,100.1,104.5|104.1,104.3,101.8,102.0|102.0,102.4,99.8,100.3|100.1,100.5,98.4,98.9|98.9,99.2,97.8,98.4|98.5,100.4,98.2,100.0|100.0,101.2,99.6,100.8|101.0,103.6,100.4,103.0|103.1,104.9,102.5,104.2|104.0,104.1,101.8,102.3|102.2,102.4,100.0,100.5|100.3,100.5,96.8,97.2|98.2,99.0,97.4,97.5"
    rows = [(*map(float, r.split(",")), 1000.0) for r in text.split("|")]
    got = detectors.double_setups(features.add_features(bars(spark, rows))).collect()
    assert [(r.i1, r.i2, r.neckline) for r in got] == [(2, 10, 97.8)]


def test_features_never_look_ahead(spark):
    rows = [(100 + (i * 7 % 11) / 10, 101.5 + (i % 5) / 10, 99 - (i % 3) / 10, 100 + (i * 5 % 13) / 10, 900 + 55 * (i % 17)) for i in range(80)]
    whole = {r.bar_index: r for r in features.add_features(bars(spark, rows)).collect()}
    for r in features.add_features(bars(spark, rows[:50])).collect():
        assert r == whole[r.bar_index]


def test_columns_and_files(spark, tmp_path):
    raw = spark.createDataFrame([("2026-07-10 09:30:00", 1.0, 2.0, 0.5, 1.5, 10)], "Timestamp string, Open double, HIGH double, low double, Close double, vol_ume int")
    assert canonical_columns(raw).columns == ["bar_start", "open", "high", "low", "close", "volume"]
    with pytest.raises(ValueError, match="both name"):
        canonical_columns(raw.withColumn("date", raw["Timestamp"]))
    with pytest.raises(ValueError, match="missing"):
        canonical_columns(raw.drop("low"))
    raw.write.option("header", True).csv(str(tmp_path / "b.csv"))
    assert read_bars(spark, str(tmp_path / "b.csv"), "2026-07-10", "2026-07-11").count() == 1
    with pytest.raises(ValueError, match="neither"):
        read_bars(spark, "b.txt")


def test_validation(spark):
    rows = bars(spark, [FLAT, (100.0, 99.0, 98.0, 98.5, 10.0), FLAT]).withColumn("input_id", features.F.monotonically_increasing_id())
    r = validate.report(rows.union(rows.limit(1)), "15m", "2026-07-10 10:00:00").first()
    assert (r.row_count, r.duplicate_count, r.invalid_ohlc_count, r.irregular_gap_count, r.completed_row_count) == (4, 1, 1, 1, 1)
    with pytest.raises(ValueError):
        PatternConfig(double_min_gap=30)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("events", "customer", "nation"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = con.sql(registry.oracle_sql()[name])
    ours = registry.queries()[name](spark, SF)
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)

    def plain(rows):
        return sorted(repr(tuple(round(x, 8) + 0.0 if isinstance(x, float) else x for x in r)) for r in rows)

    assert plain(map(tuple, ours.select(*columns).collect())) == plain(theirs.select(*columns).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
