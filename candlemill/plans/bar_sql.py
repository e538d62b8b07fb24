"""The SQL twin of each bar query, for DuckDB."""

from __future__ import annotations

from .bar_queries import AS_OF

BARS = """bars AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS bar_start,
    arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
    arg_max(value, struct_pack(a := ts, b := event_id)) AS close, count(*)::DOUBLE AS volume
  FROM events GROUP BY 1, 2)"""
FEATURES = (
    BARS
    + """,
f1 AS (SELECT *, row_number() OVER w - 1 AS bar_index, abs(close - open) AS body, high - low AS bar_range,
    high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, close > open AS bullish, close < open AS bearish,
    close / nullif(lag(close) OVER w, 0) - 1 AS bar_return, strftime(bar_start, '%Y-%m-%d') AS session_date,
    CASE WHEN strftime(bar_start, '%H:%M:%S') < '09:30:00' THEN 'premarket' WHEN strftime(bar_start, '%H:%M:%S') < '16:00:00' THEN 'regular' ELSE 'afterhours' END AS session_segment,
    strftime(bar_start, '%H:%M') AS time_of_day
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
f2 AS (SELECT *, body / nullif(bar_range, 0) AS body_ratio, upper_wick / nullif(bar_range, 0) AS upper_wick_ratio, lower_wick / nullif(bar_range, 0) AS lower_wick_ratio,
    session_date || ':' || session_segment AS session_key,
    CASE WHEN count(close) OVER w20 = 20 THEN avg(close) OVER w20 END AS ma_20,
    CASE WHEN count(close) OVER w50 = 50 THEN avg(close) OVER w50 END AS ma_50,
    avg(bar_range) OVER p20 AS atr, avg(volume) OVER p20 AS rolling_volume,
    CASE WHEN count(bar_return) OVER w20 = 20 THEN stddev_samp(bar_return) OVER w20 END AS volatility,
    CASE WHEN count(high) OVER p20 = 20 THEN max(high) OVER p20 END AS rolling_high,
    CASE WHEN count(low) OVER p20 = 20 THEN min(low) OVER p20 END AS rolling_low,
    max(high) OVER p30 AS resistance, min(low) OVER p30 AS support,
    avg(close) OVER (PARTITION BY symbol, session_date ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS session_ma_20,
    max(high) OVER s AS session_high, min(low) OVER s AS session_low, first_value(open) OVER s AS session_open, row_number() OVER s - 1 AS session_position,
    CASE WHEN count(volume) OVER c5 >= 3 THEN avg(volume) OVER c5 END AS clock_volume
  FROM f1 WINDOW w20 AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
    w50 AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
    p20 AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
    p30 AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
    s AS (PARTITION BY symbol, session_date ORDER BY bar_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    c5 AS (PARTITION BY symbol, time_of_day ORDER BY bar_start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (close - session_high) / nullif(session_high, 0) AS from_session_high, (close - session_low) / nullif(session_low, 0) AS from_session_low,
    CASE WHEN clock_volume IS NOT NULL THEN 'time_of_day' ELSE 'rolling_20' END AS volume_baseline_source,
    coalesce(clock_volume, rolling_volume) AS volume_baseline,
    CASE WHEN atr > 0 THEN bar_range / atr END AS range_strength,
    CASE WHEN coalesce(clock_volume, rolling_volume) > 0 THEN volume / coalesce(clock_volume, rolling_volume) END AS volume_strength,
    coalesce(bar_range >= 0.8 * atr, false) OR coalesce(volume >= rolling_volume, false) AS significant,
    coalesce(bar_range > 1.2 * atr + 1e-9, false) AS strong_range,
    coalesce(volume > 1.2 * coalesce(clock_volume, rolling_volume) + 1e-9, false) AS strong_volume
  FROM f2),
n AS (SELECT *, lag(close) OVER w AS c1, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(bullish) OVER w AS bull1, lag(bearish) OVER w AS bear1,
    lag(body_ratio) OVER w AS br1, lag(significant) OVER w AS sig1, lag(session_key) OVER w AS k1, lag(bar_range) OVER w AS r1,
    lag(close, 2) OVER w AS c2, lag(open, 2) OVER w AS o2, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lag(bullish, 2) OVER w AS bull2, lag(bearish, 2) OVER w AS bear2,
    lag(body_ratio, 2) OVER w AS br2, lag(session_key, 2) OVER w AS k2, lag(bar_range, 2) OVER w AS r2,
    coalesce(lag(rolling_high) OVER w, rolling_high) AS up_ref, coalesce(lag(rolling_low) OVER w, rolling_low) AS down_ref,
    lead(high, 1) OVER w AS hn1, lead(high, 2) OVER w AS hn2, lead(low, 1) OVER w AS ln1, lead(low, 2) OVER w AS ln2
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
swings AS (SELECT *, coalesce(high > h1 AND high > h2 AND high > hn1 AND high > hn2, false) AS swing_high, coalesce(low < l1 AND low < l2 AND low < ln1 AND low < ln2, false) AS swing_low,
    coalesce(high > h1 AND high > h2 AND high >= hn1 AND high >= hn2, false) AS pivot_high, coalesce(low < l1 AND low < l2 AND low <= ln1 AND low <= ln2, false) AS pivot_low FROM n),
patterns AS (
  SELECT symbol, bar_start, bar_index, 'bullish_engulfing' AS pattern_id, 'Bullish' AS bias FROM n WHERE session_key = k1 AND bear1 AND bullish AND open <= c1 AND close >= o1 AND (significant OR sig1)
  UNION ALL SELECT symbol, bar_start, bar_index, 'bearish_engulfing', 'Bearish' FROM n WHERE session_key = k1 AND bull1 AND bearish AND open >= c1 AND close <= o1 AND (significant OR sig1)
  UNION ALL SELECT symbol, bar_start, bar_index, 'morning_star', 'Bullish' FROM n WHERE session_key = k1 AND session_key = k2 AND bear2 AND br2 >= 0.45 AND br1 <= 0.35
    AND greatest(o1, c1) <= c2 + (bar_range + r1 + r2) / 3 * 0.1 AND least(o1, c1) <= c2 + (bar_range + r1 + r2) / 3 * 0.1 AND bullish AND close >= (o2 + c2) / 2
  UNION ALL SELECT symbol, bar_start, bar_index, 'evening_star', 'Bearish' FROM n WHERE session_key = k1 AND session_key = k2 AND bull2 AND br2 >= 0.45 AND br1 <= 0.35
    AND greatest(o1, c1) >= c2 - (bar_range + r1 + r2) / 3 * 0.1 AND least(o1, c1) >= c2 - (bar_range + r1 + r2) / 3 * 0.1 AND bearish AND close <= (o2 + c2) / 2
  UNION ALL SELECT symbol, bar_start, bar_index, 'inside_bar', 'Neutral' FROM n WHERE session_key = k1 AND high < h1 AND low > l1 AND (significant OR sig1)
  UNION ALL SELECT symbol, bar_start, bar_index, 'inside_bar_failure', 'Bearish' FROM n WHERE session_key = k1 AND session_key = k2 AND h1 < h2 AND l1 > l2 AND significant AND high > h2 AND low >= l2 AND close > l2 AND close < h2 AND bearish
  UNION ALL SELECT symbol, bar_start, bar_index, 'inside_bar_failure', 'Bullish' FROM n WHERE session_key = k1 AND session_key = k2 AND h1 < h2 AND l1 > l2 AND significant AND low < l2 AND high <= h2 AND close > l2 AND close < h2 AND bullish
  UNION ALL SELECT symbol, bar_start, bar_index, 'doji', 'Neutral' FROM n WHERE bar_range > 0 AND body_ratio <= 0.08
  UNION ALL SELECT symbol, bar_start, bar_index, 'lower_rejection', 'Neutral' FROM n WHERE lower_wick_ratio >= 0.55 AND body_ratio <= 0.35 AND (close - low) / nullif(bar_range, 0) >= 0.6 AND significant
  UNION ALL SELECT symbol, bar_start, bar_index, 'upper_rejection', 'Neutral' FROM n WHERE upper_wick_ratio >= 0.55 AND body_ratio <= 0.35 AND (close - low) / nullif(bar_range, 0) <= 0.4 AND significant)"""
)
QUOTES = """quotes AS (
  SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS bar_start, CASE WHEN event_id % 23 <> 0 THEN value END AS open,
    value + (event_id % 11 - 1) * 0.5::DOUBLE AS high, value - (event_id % 13 - 1) * 0.5::DOUBLE AS low, value + (event_id % 5 - 2) * 0.25::DOUBLE AS close,
    (event_id % 17 - 1)::DOUBLE AS volume, event_id AS input_id FROM events)"""
BAD = "coalesce(high < open OR high < close OR high < low OR low > open OR low > close OR volume < 0 OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false)"
HORIZONS = (1, 3, 6)


def _touch(h: int) -> str:
    """First bars after a signal that reach the target and the stop."""
    up, down = "lead(high, {k}) OVER w >= close * (1 + {r})", "lead(low, {k}) OVER w <= close * (1 - {r})"
    part = lambda rule, r: "CASE " + " ".join(f"WHEN {rule.format(k=k, r=r)} THEN {k}" for k in range(1, h + 1)) + " END"
    frame = f"(PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return (
        f"SELECT symbol, bar_index, {h} AS horizon, close, lead(close, {h}) OVER w AS exit, max(high) OVER {frame} AS top, min(low) OVER {frame} AS bottom, "
        f"{part(up, 0.01)} AS bull_t, {part(down, 0.005)} AS bull_s, {part(down, 0.01)} AS bear_t, {part(up, 0.005)} AS bear_s FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)"
    )


#: Outcomes of the events in a relation ``signals``, which the user of this text puts before it.
OUTCOMES = (
    FEATURES
    + ", ahead AS ("
    + " UNION ALL ".join(_touch(h) for h in HORIZONS)
    + """),
results AS (SELECT symbol, bar_start, bar_index, pattern_id, bias, horizon,
    CASE WHEN bias = 'Bullish' THEN exit / close - 1 ELSE -(exit / close - 1) END AS directional_return,
    CASE WHEN exit IS NOT NULL THEN CASE WHEN bias = 'Bullish' THEN top / close - 1 ELSE 1 - bottom / close END END AS mfe,
    CASE WHEN exit IS NOT NULL THEN CASE WHEN bias = 'Bullish' THEN bottom / close - 1 ELSE 1 - top / close END END AS mae,
    CASE WHEN exit IS NULL THEN 'insufficient_future_bars' WHEN t IS NULL AND s IS NULL THEN 'neither_hit' WHEN t = s THEN 'both_same_bar' WHEN s IS NULL OR t < s THEN 'target_first' ELSE 'stop_first' END AS touch
  FROM (SELECT p.*, a.* EXCLUDE (symbol, bar_index), CASE WHEN bias = 'Bullish' THEN bull_t ELSE bear_t END AS t, CASE WHEN bias = 'Bullish' THEN bull_s ELSE bear_s END AS s
        FROM signals p JOIN ahead a USING (symbol, bar_index)))"""
)
SUMMARY = """count(*) AS signals, count(*) FILTER (WHERE directional_return > 0) AS wins, count(*) FILTER (WHERE directional_return < 0) AS losses, count(*) FILTER (WHERE directional_return = 0) AS flat,
  round(avg((directional_return > 0)::INT), 9) AS precision, round(avg(directional_return), 9) AS mean_return, round(median(directional_return), 9) AS median_return,
  round(avg(mfe), 9) AS mean_mfe, round(avg(mae), 9) AS mean_mae, round(avg((touch = 'target_first')::INT), 9) AS target_first_rate, round(avg((touch = 'stop_first')::INT), 9) AS stop_first_rate"""


def select(columns: str, source: str = "f", digits: str = "", where: str = "true") -> str:
    plain = ", ".join([c for c in columns.split()] + [f"round({c}, 9) AS {c}" for c in digits.split()])
    return f"WITH {FEATURES} SELECT symbol, bar_start, {plain} FROM {source} WHERE {where}"


def doubles(top: bool, more: str = "") -> str:
    p, q, agg, edge = ("high", "low", "arg_min(k.low, struct_pack(a := k.low, b := k.bar_index))", "least(p1, p2)") if top else ("low", "high", "arg_max(k.high, struct_pack(a := k.high, b := -k.bar_index))", "greatest(p1, p2)")
    depth = f"({edge} - neckline) / {edge}" if top else f"(neckline - {edge}) / neckline"
    return f"""WITH {FEATURES}, necks AS (
      SELECT a.symbol, a.bar_index AS i1, b.bar_index AS i2, a.{p} AS p1, b.{p} AS p2, {agg} AS neckline, {agg.replace("k.low,", "k.bar_index,", 1) if top else agg.replace("k.high,", "k.bar_index,", 1)} AS valley
      FROM swings a JOIN swings b ON a.symbol = b.symbol AND b.bar_index - a.bar_index BETWEEN 4 AND 24 AND abs(a.{p} - b.{p}) / greatest(a.{p}, b.{p}) <= 0.006
      JOIN swings k ON k.symbol = a.symbol AND k.bar_index > a.bar_index AND k.bar_index < b.bar_index
      WHERE a.pivot_{p} AND b.pivot_{p} AND k.pivot_{q} GROUP BY ALL),
    good AS (SELECT *, {depth} AS depth FROM necks WHERE {depth} >= 0.008)
    SELECT symbol, i1, i2, p1, p2, neckline, round(depth, 9) AS depth{more} FROM good QUALIFY row_number() OVER (PARTITION BY symbol, i1 ORDER BY i2) = 1"""


def patterns(*ids: str) -> str:
    return f"WITH {FEATURES} SELECT * FROM patterns WHERE pattern_id IN ({', '.join(repr(i) for i in ids)})"


SQL = {
    "bars_hourly": f"WITH {BARS} SELECT * FROM bars",
    "completed_bars_asof": f"WITH {BARS} SELECT * FROM bars WHERE bar_start + INTERVAL '1 hour' <= TIMESTAMP '{AS_OF}'",
    "dedup_keep_last": f"WITH {QUOTES} SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, bar_start ORDER BY input_id DESC) = 1",
    "invalid_ohlc": f"WITH {QUOTES} SELECT * FROM quotes WHERE {BAD}",
    "irregular_gaps": f"WITH {BARS}, g AS (SELECT symbol, bar_start, lag(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) AS b FROM bars) SELECT symbol, bar_start FROM g WHERE b::DATE = bar_start::DATE AND b + INTERVAL '1 hour' <> bar_start",
    "session_filter": f"WITH {BARS} SELECT * FROM bars WHERE strftime(bar_start, '%H:%M:%S') >= '09:30:00'",
    "validation_counters": f"""WITH {QUOTES}, d AS (SELECT * FROM quotes QUALIFY row_number() OVER (PARTITION BY symbol, bar_start ORDER BY input_id DESC) = 1),
      t AS (SELECT symbol, count(*) AS row_count, count(*) - count(DISTINCT bar_start) AS duplicate_count FROM quotes GROUP BY 1),
      m AS (SELECT symbol, sum((open IS NULL)::INT + (high IS NULL)::INT + (low IS NULL)::INT + (close IS NULL)::INT + (volume IS NULL)::INT)::BIGINT AS missing_value_count FROM d GROUP BY 1),
      w AS (SELECT *, {BAD} AS bad FROM d WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL),
      b AS (SELECT symbol, count(*) FILTER (WHERE bad) AS invalid_ohlc_count FROM w GROUP BY 1),
      g AS (SELECT symbol, bar_start, lag(bar_start) OVER (PARTITION BY symbol ORDER BY bar_start) AS p FROM w WHERE NOT bad),
      l AS (SELECT symbol, count(*) FILTER (WHERE p::DATE = bar_start::DATE AND p + INTERVAL '15 minutes' <> bar_start) AS irregular_gap_count,
            count(*) FILTER (WHERE bar_start + INTERVAL '15 minutes' <= TIMESTAMP '{AS_OF}') AS completed_row_count FROM g GROUP BY 1)
      SELECT t.*, coalesce(missing_value_count, 0) AS missing_value_count, coalesce(invalid_ohlc_count, 0) AS invalid_ohlc_count, coalesce(irregular_gap_count, 0) AS irregular_gap_count, coalesce(completed_row_count, 0) AS completed_row_count
      FROM t LEFT JOIN m USING (symbol) LEFT JOIN b USING (symbol) LEFT JOIN l USING (symbol)""",
    "session_segments": select("session_date session_segment session_key"),
    "candle_geometry": select("bullish bearish", digits="body bar_range upper_wick lower_wick body_ratio upper_wick_ratio lower_wick_ratio bar_return"),
    "moving_averages": select("", digits="ma_20 ma_50"),
    "range_and_volume_baselines": select("", digits="atr rolling_volume range_strength"),
    "volatility20": select("", digits="volatility"),
    "rolling_levels": select("rolling_high rolling_low"),
    "support_resistance": select("resistance support"),
    "session_running": select("session_high session_low session_open session_position", digits="session_ma_20 from_session_high from_session_low"),
    "time_of_day_volume": select("volume_baseline_source", digits="clock_volume volume_baseline"),
    "strength_flags": select("significant strong_range strong_volume", digits="volume_strength"),
    "swing_points": select("swing_high swing_low", "swings", where="swing_high OR swing_low"),
    "pivots": select("pivot_high pivot_low", "swings", where="pivot_high OR pivot_low"),
    "regression_slope": f"WITH {FEATURES} SELECT symbol, bar_start, CASE WHEN count(close) OVER w = 20 THEN round(regr_slope(close, bar_index) OVER w, 9) END AS slope FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bar_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "break_structure_events": f"""WITH {FEATURES}, b AS (SELECT *, coalesce(session_key = k1 AND close > rolling_high AND c1 <= up_ref, false) AS break_up, coalesce(session_key = k1 AND close < rolling_low AND c1 >= down_ref, false) AS break_down FROM n)
      SELECT symbol, bar_start, break_up, break_down, 11.0::DOUBLE + CASE WHEN strong_volume THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN strong_range THEN 1.5 ELSE 0.0 END::DOUBLE AS break_base FROM b WHERE break_up OR break_down""",
    "candle_direction": f"""WITH {FEATURES}, d AS (SELECT symbol, bar_start, coalesce(greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
        0.5::DOUBLE * ((close - open) / nullif(bar_range, 0)) + 0.3::DOUBLE * 2 * ((close - low) / nullif(bar_range, 0) - 0.5::DOUBLE) + 0.2::DOUBLE * (lower_wick_ratio - upper_wick_ratio))), 0.0::DOUBLE) AS s FROM (SELECT * FROM f WHERE bar_range > 0) UNION ALL SELECT symbol, bar_start, 0.0 FROM f WHERE bar_range = 0)
      SELECT symbol, bar_start, round(s, 9) AS direction_score, CASE WHEN s >= 0.6 THEN 'Strong Bullish' WHEN s >= 0.2 THEN 'Bullish' WHEN s <= -0.6 THEN 'Strong Bearish' WHEN s <= -0.2 THEN 'Bearish' ELSE 'Neutral' END AS direction FROM d""",
    "raw_breaks": f"""WITH {FEATURES} SELECT symbol, bar_start, bar_index, 'breakout' AS pattern_id, 'Bullish' AS bias, rolling_high AS level FROM n WHERE session_key = k1 AND volume_strength >= 1 AND close > rolling_high AND c1 <= up_ref
      UNION ALL SELECT symbol, bar_start, bar_index, 'breakdown', 'Bearish', rolling_low FROM n WHERE session_key = k1 AND volume_strength >= 1 AND close < rolling_low AND c1 >= down_ref""",
    "pattern_counts": f"WITH {FEATURES} SELECT symbol, pattern_id, bias, count(*) AS n FROM patterns GROUP BY ALL",
    "double_top_setups": doubles(True),
    "double_bottom_setups": doubles(False),
    "confidence_bucket": "SELECT CASE WHEN event_id % 101 < 25 THEN '0-24' WHEN event_id % 101 < 50 THEN '25-49' WHEN event_id % 101 < 75 THEN '50-74' ELSE '75-100' END AS bucket, count(*) AS n FROM events GROUP BY 1",
    "bullish_engulfing": patterns("bullish_engulfing"),
    "bearish_engulfing": patterns("bearish_engulfing"),
    "morning_star": patterns("morning_star"),
    "evening_star": patterns("evening_star"),
    "inside_bar": patterns("inside_bar"),
    "inside_bar_failure": patterns("inside_bar_failure"),
    "doji": patterns("doji"),
    "long_rejection_geometry": patterns("lower_rejection", "upper_rejection"),
}
