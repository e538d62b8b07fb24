"""The SQL twins of the queries over trends, breaks and double patterns, for DuckDB."""

from __future__ import annotations

from .bar_sql import FEATURES, doubles

#: Signed base of each crossing, then the fading score as eight steps from the oldest bar to the newest.
STEPS = [
    "s{n} AS (SELECT *, CASE WHEN greatest(0, abs(e{k}) - {d}) = 0 OR e{k} IS NULL THEN b{m} WHEN e{k} > 0 THEN greatest(b{m}, e{k} - {d}) ELSE least(b{m}, e{k} + {d}) END AS b{n} FROM s{m})".format(n=8 - k, m=7 - k, k=k, d=f"{2 * k}.0::DOUBLE")
    for k in range(7, -1, -1)
]
SCORED = (
    FEATURES
    + """,
signed AS (SELECT *, CASE WHEN session_key = k1 AND close > rolling_high AND c1 <= up_ref THEN 1 WHEN session_key = k1 AND close < rolling_low AND c1 >= down_ref THEN -1 END
    * (11.0::DOUBLE + CASE WHEN strong_volume THEN 2.0 ELSE 0.0 END::DOUBLE + CASE WHEN strong_range THEN 1.5 ELSE 0.0 END::DOUBLE) AS e0 FROM swings),
s0 AS (SELECT *, 0.0::DOUBLE AS b0, """
    + ", ".join(f"lag(e0, {k}) OVER w AS e{k}" for k in range(1, 8))
    + """ FROM signed WINDOW w AS (PARTITION BY symbol ORDER BY bar_start)),
"""
    + ",\n".join(STEPS)
    + ",\nt0 AS (SELECT *, b8 AS break_score FROM s8)"
)


def frame(n: int, keys: str, end: str = "CURRENT ROW") -> str:
    return f"(PARTITION BY {keys} ORDER BY bar_start ROWS BETWEEN {n} PRECEDING AND {end})"


def snapshot(name: str, source: str, horizon: int, share: float, session: bool = False) -> str:
    keys, place = ("symbol, session_date", "session_position") if session else ("symbol", "bar_index")
    n = f"least({place} + 1, {horizon})"
    top, slow = min(20, max(5, horizon // 3)), min(50, horizon)
    size = f"least(20, greatest(5, {n} // 3))"
    fast = "CASE " + " ".join(f"WHEN {size} = {k} THEN avg(close) OVER {frame(k - 1, keys)}" for k in range(5, top + 1)) + " END"
    was = "CASE " + " ".join(f"WHEN {size} = {k} THEN avg(close) OVER {frame(k + 2, keys, '3 PRECEDING')}" for k in range(5, top + 1)) + " END"
    seen = lambda k: f"sum(sign(coalesce(bar_return, 0))) OVER {frame(k - 1, keys)} / least({n}, {k})"
    share_of = "CASE " + " ".join(f"WHEN greatest(8, {n} // 2) = {k} THEN {seen(k)}" for k in range(8, max(8, horizon // 2) + 1)) + " END" if session else seen(max(8, horizon // 2))
    swing = lambda c: f"list({c}) FILTER (WHERE swing_{c} AND {place} >= 2) OVER {frame(horizon - 3, keys, '2 PRECEDING')}"
    move = lambda c: f"CASE WHEN {c}[-1] > {c}[-2] * (1 + band) THEN 7 WHEN {c}[-1] < {c}[-2] * (1 - band) THEN -7 ELSE 0 END"
    rising = f"CASE WHEN n < {slow} + 3 THEN 0 WHEN fast > was AND slow > was_slow THEN 5 WHEN fast < was AND slow < was_slow THEN -5 ELSE 0 END"
    return f"""{name}_a AS (SELECT *, {n} AS n, avg(bar_range) OVER {frame(horizon - 1, keys)} AS u, CASE WHEN {place} > 0 THEN regr_slope(close, bar_index) OVER {frame(horizon - 1, keys)} END AS slope,
    {fast} AS fast, {was} AS was, avg(close) OVER {frame(slow - 1, keys)} AS slow, avg(close) OVER {frame(slow + 2, keys, '3 PRECEDING')} AS was_slow, {share_of} AS persistence,
    {swing('high')} AS highs, {swing('low')} AS lows, first_value(close) OVER {frame(horizon - 1, keys)} AS first_close FROM {source}),
  {name}_b AS (SELECT *, CASE WHEN u > 1e-9 THEN u ELSE greatest(abs(close) * 0.001::DOUBLE, 1e-6) END AS unit FROM {name}_a),
  {name}_c AS (SELECT *, greatest(unit / greatest(abs(close), 1) * 0.35::DOUBLE, 0.0015::DOUBLE) AS band, greatest(-24, least(24, slope / unit * 80)) AS slope_score FROM {name}_b),
  {name}_d AS (SELECT *, CASE WHEN n < 8 THEN 0 ELSE greatest(-100, least(100, slope_score + CASE WHEN abs(fast - slow) / unit >= 0.12::DOUBLE THEN sign(fast - slow) * 10 ELSE 0 END
    + CASE WHEN close > fast AND close > slow THEN 5 WHEN close < fast AND close < slow THEN -5 ELSE 0 END + {rising} + persistence * 18 + {move('highs')} + {move('lows')} + break_score * {share})) END::DOUBLE AS {name}_raw FROM {name}_c)"""


def label(x: str) -> str:
    return f"CASE WHEN {x} >= 18 THEN 'Uptrend' WHEN {x} <= -18 THEN 'Downtrend' ELSE 'Neutral' END"


BASE = "t0"
KEY = "symbol, bar_start"
HORIZONS = {"short": (12, 1.0), "medium": (48, 1.0), "long": (120, 0.5)}
BROAD = (
    f"WITH {SCORED},\n"
    + ",\n".join(snapshot(k, BASE, h, s) for k, (h, s) in HORIZONS.items())
    + f""" SELECT {KEY}, {', '.join(f'{label(f"{k}_raw")} AS {k}_label, round({k}_raw, 2) AS {k}_score' for k in HORIZONS)}, trend_score, {label('trend_score')} AS trend
    FROM (SELECT s.symbol, s.bar_start, short_raw, medium_raw, long_raw, CASE WHEN s.bar_index < 7 THEN 0 ELSE round((round(round(short_raw, 2) * 100) * 50 + round(round(medium_raw, 2) * 100) * 35 + round(round(long_raw, 2) * 100) * 15) / 100.0::DOUBLE) / 100.0::DOUBLE END AS trend_score
      FROM short_d s JOIN medium_d USING ({KEY}) JOIN long_d USING ({KEY}))"""
)
LOCAL = (
    f"{snapshot('loc', BASE, 20, 0.0, True)},\nlocals AS (SELECT *, greatest(-100, least(100, round(loc_raw, 2) + greatest(-22, least(22, (close - session_open) / unit * 6)) + (CASE WHEN session_high - session_low > 1e-9 THEN (close - session_low) / (session_high - session_low) ELSE 0.5 END::DOUBLE - 0.5::DOUBLE) * 24)) AS score FROM loc_d),\n"
    f"local AS (SELECT {KEY}, bar_index, {label('score')} AS local_trend, round(score, 2) AS local_score FROM locals)"
)
ENTRY = f"""{snapshot('pre', BASE, 15, 1.0)},
  before AS (SELECT *, round(pre_raw, 2) AS s, round((close - first_close) / unit, 2) AS m FROM pre_d),
  now AS (SELECT *, CASE WHEN n < 8 THEN 'ambiguous' WHEN pre_raw >= 18 AND m >= 1.25 THEN 'uptrend' WHEN pre_raw <= -18 AND m <= -1.25 THEN 'downtrend' WHEN abs(s) >= 16 AND abs(m) >= 1 THEN CASE WHEN s > 0 THEN 'uptrend' ELSE 'downtrend' END
      WHEN abs(s) >= 10 THEN 'sideways' ELSE 'ambiguous' END AS direction, n >= 8 AND abs(s) >= 18 AND abs(slope_score) >= 6 AND abs(m) >= 1.25 AS fine FROM before),
  entry AS (SELECT * EXCLUDE (highs, lows), coalesce(lag(direction) OVER w, 'ambiguous') AS entry_direction, coalesce(lag(s) OVER w, 0) AS entry_score, coalesce(lag(m) OVER w, 0) AS entry_move, coalesce(lag(fine) OVER w, false) AS entry_quality
    FROM now WINDOW w AS (PARTITION BY symbol ORDER BY bar_start))"""
REJECTIONS = f"""WITH {SCORED}, {LOCAL}, {ENTRY},
  shaped AS (SELECT e.*, coalesce(lag(local_trend) OVER (PARTITION BY e.symbol ORDER BY e.bar_start) = 'Downtrend', false) AS against, (e.close - e.low) / nullif(bar_range, 0) AS place,
    entry_direction = 'downtrend' AND entry_quality AS fell, entry_direction = 'uptrend' AND entry_quality AS rose, coalesce(e.low <= support * 1.005::DOUBLE, false) AS near_low, coalesce(e.high >= resistance * 0.995::DOUBLE, false) AS near_high
    FROM entry e JOIN local USING ({KEY})),
  lower AS (SELECT * FROM shaped WHERE lower_wick_ratio >= 0.55 AND body_ratio <= 0.35 AND place >= 0.6 AND significant)
  SELECT {KEY}, bar_index, pattern_id, CASE WHEN fell THEN pattern_name ELSE 'Lower-Wick Rejection' END AS name, CASE WHEN fell OR near_low THEN 'Bullish' ELSE 'Neutral' END AS bias, CASE WHEN fell OR near_low THEN 'tentative' ELSE 'candidate' END AS status
  FROM lower, (VALUES ('bullish_pin_bar', 'Bullish Pin Bar'), ('hammer', 'Hammer')) v(pattern_id, pattern_name)
  UNION ALL SELECT {KEY}, bar_index, 'shooting_star', CASE WHEN rose AND near_high AND NOT against THEN 'Shooting Star' WHEN against THEN 'Upper-Wick Rejection' WHEN near_high THEN 'Resistance Rejection' ELSE 'Upper-Wick Rejection' END,
    CASE WHEN (rose AND near_high) OR against THEN 'Bearish' ELSE 'Neutral' END, CASE WHEN (rose AND near_high) OR against THEN 'tentative' ELSE 'candidate' END
  FROM shaped WHERE upper_wick_ratio >= 0.55 AND body_ratio <= 0.35 AND place <= 0.4 AND significant"""
TOLERANCE = "greatest(coalesce(atr, bar_range) * 0.15::DOUBLE, abs({level}) * 0.001::DOUBLE, 0.01::DOUBLE)"


def _side(name: str, bias: str, level: str, ref: str, sign: int) -> str:
    return f"""SELECT symbol, bar_start, bar_index, '{name}' AS pattern_id, '{bias}' AS bias, {level} AS level, {sign} AS sgn, c1, {level} + {sign} * {TOLERANCE.format(level=level)} AS new_edge,
      coalesce(session_key = k1 AND volume_strength >= 1 AND (close - {level}) * {sign} > 0 AND (c1 - {ref}) * {sign} <= 0, false) AS crossed, coalesce(session_key <> k1, true) AS changed,
      strong_volume OR strong_range OR abs(close - {level}) / {TOLERANCE.format(level=level)} >= 2.5 AS strong FROM n WHERE {level} IS NOT NULL"""


BREAKS = f"""WITH RECURSIVE {FEATURES}, both_sides AS ({_side('breakout', 'Bullish', 'rolling_high', 'up_ref', 1)} UNION ALL {_side('breakdown', 'Bearish', 'rolling_low', 'down_ref', -1)}),
  sparse AS (SELECT *, row_number() OVER (PARTITION BY symbol, pattern_id ORDER BY bar_index) AS k FROM both_sides WHERE crossed OR changed),
  fold AS (SELECT DISTINCT symbol, pattern_id, 0::BIGINT AS k, 0::BIGINT AS wait, NULL::DOUBLE AS edge, false AS fires FROM sparse
    UNION ALL SELECT symbol, pattern_id, k, CASE WHEN f THEN bar_index + 4 ELSE wait END, CASE WHEN bar_index < wait THEN edge WHEN changed THEN NULL WHEN f THEN new_edge ELSE edge END, f
    FROM (SELECT s.*, o.wait, o.edge, s.bar_index >= o.wait AND s.crossed AND coalesce((s.c1 - o.edge) * s.sgn < 0, true) AS f FROM fold o JOIN sparse s ON s.symbol = o.symbol AND s.pattern_id = o.pattern_id AND s.k = o.k + 1))
  SELECT symbol, bar_start, bar_index, pattern_id, bias, level, strong FROM sparse JOIN (SELECT symbol, pattern_id, k FROM fold WHERE fires) USING (symbol, pattern_id, k)"""


def double_outcomes(top: bool, more: str = "") -> str:
    outer, down = ("greatest(p1, p2)", 1) if top else ("least(p1, p2)", -1)
    inner = doubles(top, ", valley")
    return f"""WITH setups AS ({inner}), {FEATURES},
      s AS (SELECT u.*, {outer} AS edge, u.i2 + 2 AS known, {TOLERANCE.format(level='neckline')} AS tol, {TOLERANCE.format(level=outer)} AS edge_tol, (SELECT max(bar_index) FROM f l WHERE l.symbol = u.symbol) AS last
        FROM setups u JOIN f ON f.symbol = u.symbol AND f.bar_index = u.i2),
      hits AS (SELECT s.symbol, s.i1, min(CASE WHEN (neckline - close) * {down} > tol OR (close - edge) * {down} > edge_tol THEN bar_index END) AS met_at,
          arg_min((neckline - close) * {down} > tol, CASE WHEN (neckline - close) * {down} > tol OR (close - edge) * {down} > edge_tol THEN bar_index END) AS good
        FROM s JOIN f ON f.symbol = s.symbol AND f.bar_index BETWEEN known + 1 AND known + 24 GROUP BY ALL)
      SELECT symbol, i1, i2, neckline, known, CASE WHEN met_at IS NOT NULL THEN CASE WHEN good THEN 'confirmed' ELSE 'failed' END WHEN known + 24 <= last THEN 'expired' ELSE 'tentative' END AS status,
        coalesce(met_at, CASE WHEN known + 24 <= last THEN known + 24 END) AS decided{more} FROM s LEFT JOIN hits USING (symbol, i1) WHERE known <= last"""


SQL = {
    "break_structure_score": f"WITH {SCORED} SELECT {KEY}, break_score FROM t0 WHERE break_score <> 0",
    "trend_broad": BROAD,
    "trend_local": f"WITH {SCORED}, {LOCAL} SELECT {KEY}, local_trend, local_score FROM local",
    "prior_context": f"WITH {SCORED}, {ENTRY} SELECT {KEY}, entry_direction, entry_score, entry_move, entry_quality FROM entry",
    "rejection_patterns": REJECTIONS,
    "breakout_final": BREAKS,
    "double_top": double_outcomes(True),
    "double_bottom": double_outcomes(False),
}
