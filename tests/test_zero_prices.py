"""Queries against DuckDB over events of which some are worth nothing: lows, and closes of signals, of zero."""

import collections
import datetime as dt
import math
import random

import pytest

import __spark_entry__
from candlemill.config import EvaluationConfig
from candlemill.operators import detectors, evaluate, features
from candlemill.sources.bars import bars_from_events

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Hours of four events, by two symbols; each sixth low is zero, each twelfth close too. A third one's highs reach zero from below."""
    rng, rows = random.Random(5), []
    for symbol in ("a", "b"):
        close = 20.0
        for i in range(72):
            opened = close + rng.randint(0, 3) / 4
            low, high = (0.0 if i % 6 == 5 else rng.randint(1, 20) / 4), 30 + rng.randint(0, 40) / 4
            close = 0.0 if i % 12 == 11 else min(high, opened + rng.randint(1, 12) / 4 if i % 12 == 10 else rng.randint(40, 100) / 4)
            rows += [(len(rows) + k, START + dt.timedelta(hours=i, minutes=10 * k), 1, symbol, float(v), "{}") for k, v in enumerate((opened, high, low, close))]
    for i in range(40):
        bar = (-4.0, 0.0 if i % 8 == 7 else -3.0, -10.0 if i % 8 == 3 else -6.0, -5.0)
        rows += [(len(rows) + k, START + dt.timedelta(hours=i, minutes=10 * k), 1, "c", v, "{}") for k, v in enumerate(bar)]
    folder = str(tmp_path_factory.mktemp("zero"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


def counted(rows):
    show = lambda x: x if not isinstance(x, float) else "nan" if math.isnan(x) else round(x, 8) + 0.0
    return collections.Counter(repr(tuple(map(show, r))) for r in rows)


def same_as_sql(spark, table, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{table}/events.parquet/*.parquet'")
    ours = __spark_entry__.queries()[name](spark, table)
    columns = sorted(ours.columns)
    got = counted(map(tuple, ours.select(*columns).collect()))
    assert got == counted(con.sql(__spark_entry__.oracle_sql()[name]).select(*columns).fetchall())
    return got


def test_lows_of_zero_are_no_double(spark, table):
    """Two lows of zero have no relative difference, so they are no pair, as in the SQL."""
    f = features.add_features(bars_from_events(spark.read.parquet(f"{table}/events.parquet"), "1h"))
    lows = [r.bar_index for r in features.swing_flags(f).filter("pivot_low AND low = 0 AND symbol = 'a'").collect()]
    assert len(lows) > 5
    setups = detectors.double_setups(f, False).collect()
    assert all(r.p1 > 0 for r in setups if r.symbol != "c")
    # a rise to a neckline of zero is infinite beside it
    assert {(r.neckline, r.depth) for r in setups if r.symbol == "c"} == {(0.0, math.inf)}


@pytest.mark.parametrize("name", ["double_bottom_setups", "double_events", "double_bottom", "structural_dedup", "structural_states", "linked_breaks", "market_assessment", "rule_confidence", "score_reconciliation", "exclusion_reasons", "evidence_categories", "top_patterns", "final_assessment", "confirmation_fields", "event_history", "eligibility"])
def test_zero_prices_against_sql(spark, table, name):
    same_as_sql(spark, table, name)


def test_outcomes_from_a_close_of_zero(spark):
    """What is gained on nothing is infinite, as in the SQL."""
    bars = spark.createDataFrame([("S", START + dt.timedelta(hours=i), i, x + 1, x, x) for i, x in enumerate((0.0, 2.0, 0.0, 0.0, 5.0))], "symbol string, bar_start timestamp_ntz, bar_index int, high double, low double, close double")
    signals = bars.selectExpr("symbol", "bar_start", "bar_index", "'p' AS pattern_id", "'Bearish' AS bias").filter("bar_index IN (0, 1, 2)")
    got = {r.bar_index: r for r in evaluate.outcomes(bars, signals, EvaluationConfig(horizons=(1,))).collect()}
    assert (got[0].directional_return, got[0].mfe, got[0].mae) == (-math.inf, -math.inf, -math.inf)
    assert got[1].directional_return == 1.0 and math.isnan(got[2].directional_return) and got[2].mae == -math.inf


def test_signals_asof_over_zero_prices(spark, table):
    """One row for each signal of the query that has SQL."""
    keys = lambda name: collections.Counter((r.symbol, r.bar_start, r.kind, r.pattern_id) for r in __spark_entry__.queries()[name](spark, table).collect())
    known = keys("historical_signals")
    assert known and keys("signals_asof") == known
