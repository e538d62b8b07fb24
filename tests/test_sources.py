"""Instruments, cached tables, streams and first crossings on small tables."""

import json
import random

import numpy as np

from candlemill.operators.crossings import first_above, first_beyond
from candlemill.sources import cache, instruments
from candlemill.streaming.bars import bars_from_stream


def test_resolve(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text("security_number,yahoo_symbol,name,exchange,currency,timezone\n 7 ,aaa.ta,,TASE,Unknown,\n7,bbb,,,,\n8,,x,,,\n")
    asked = spark.createDataFrame([(x,) for x in ("7", "8", "9", " nvda ", "", None)], "identifier string")
    got = {r.identifier: r for r in instruments.with_profile(instruments.resolve(asked, instruments.read_mapping(spark, str(path)))).collect()}
    assert (got["7"].symbol, got["7"].name, got["7"].exchange_timezone, got["7"].mic, got["7"].currency) == ("AAA.TA", "AAA.TA", "Asia/Jerusalem", "XTAE", "ILS")
    assert [got[x].problem for x in ("8", "9", " nvda ", "", None)] == ["no symbol", "unknown number", None, "blank", "blank"]
    assert got[" nvda "].symbol == "NVDA" and got[" nvda "].mic is None


def test_profile_precedence(spark):
    rows = [("A.L", "NMS", None, None), ("A.L", None, "Asia/Tokyo", None), ("A.L", None, "Asia/Tokyo", "UTC"), ("A", "unknown", None, None)]
    df = spark.createDataFrame(rows, "symbol string, provider_exchange string, provider_timezone string, timezone_override string")
    got = [(r.mic, r.exchange_timezone, r.exchange) for r in instruments.with_profile(df).collect()]
    assert got == [("XNAS", "America/New_York", "NMS"), ("XLON", "Asia/Tokyo", "LSE"), ("XLON", "UTC", "LSE"), (None, None, None)]


def test_cache_and_json(spark, tmp_path):
    calls = []

    def load():
        calls.append(1)
        return spark.createDataFrame([(1, None, "é")], "b int, a int, c string")

    ask = lambda ttl, **x: cache.cached(spark, str(tmp_path / "c"), ttl, load, **x).count()
    assert [ask(60, symbol="A", interval="1h"), ask(60, interval="1h", symbol="A"), len(calls)] == [1, 1, 1]
    ask(60, symbol="B", interval="1h")
    ask(-1, symbol="A", interval="1h")
    assert len(calls) == 3
    cache.write_json(load(), str(tmp_path / "j"))
    text = "".join(p.read_text() for p in (tmp_path / "j").glob("part*"))
    assert json.loads(text) == {"a": None, "b": 1, "c": "é"} and text.startswith('{"a"')


def test_stream_drops_late_events(spark, tmp_path):
    for name, rows in (("1", [("S", "2026-07-10 09:05:00", 1.0, 1), ("S", "2026-07-10 11:30:00", 2.0, 2)]), ("2", [("S", "2026-07-10 09:10:00", 9.0, 3), ("S", "2026-07-10 14:00:00", 3.0, 4)])):
        df = spark.createDataFrame(rows, "event_type string, ts string, value double, event_id int")
        df.selectExpr("event_type", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "value", "event_id").coalesce(1).write.parquet(f"{tmp_path}/in{name}")
    schema = spark.read.parquet(f"{tmp_path}/in1").schema
    for name in "12":
        bars = bars_from_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in[12]" if name == "2" else f"{tmp_path}/in1*"))
        bars.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((str(r.bar_start)[11:16], r.high) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("09:00", 1.0), ("11:00", 2.0)]


def test_first_above():
    r = random.Random(3)
    for n in (0, 1, 2, 7, 64, 100):
        values = np.array([float(r.randint(0, 9)) for _ in range(n)])
        start, x = np.array([r.randint(0, n) for _ in range(50)]), np.array([float(r.randint(-1, 10)) for _ in range(50)])
        assert first_above(values, start, x).tolist() == [next((p for p in range(s, n) if values[p] > v), n) for s, v in zip(start, x)]


def test_first_beyond_over_batches(spark):
    """The same answers whatever the size of batches, with nulls and several symbols."""
    r = random.Random(4)
    bars = [(s, i, None if r.random() < 0.05 else float(r.randint(0, 99)), float(r.randint(50, 99)), float(r.randint(0, 50))) for s in "abc" for i in range(60)]
    asks = [(r.choice("abcd"), f"q{k}", "w", r.randint(-2, 62), r.choice(["close", "high", "low"]), r.random() < 0.5, None if k == 0 else float(r.randint(0, 99)), r.random() < 0.5) for k in range(80)]
    frame = spark.createDataFrame(bars, "symbol string, bar_index int, close double, high double, low double")
    frame = frame.selectExpr("*", "timestampadd(HOUR, bar_index, TIMESTAMP_NTZ '2026-01-01 00:00:00') AS bar_start")
    questions = spark.createDataFrame(asks, "symbol string, ask string, what string, after int, field string, over boolean, x double, closed boolean")
    expected = {}
    for s, q, _, after, field, over, x, closed in asks:
        at = {"close": 2, "high": 3, "low": 4}[field]
        hit = lambda v: v is not None and x is not None and ((v > x if over else v < x) or (closed and v == x))
        found = [b[1] for b in bars if b[0] == s and b[1] > after and hit(b[at])]
        if found:
            expected[q] = min(found)
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "10000"):
            spark.conf.set(key, size)
            assert {x.ask: x.at for x in first_beyond(frame, questions).collect()} == expected
    finally:
        spark.conf.set(key, old)
