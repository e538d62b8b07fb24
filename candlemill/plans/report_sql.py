"""The SQL twins of backtests, rankings and zoned sessions, for DuckDB."""

from __future__ import annotations

from ..operators.ranking import PAST, RECENT, RECENT_BARS, STATE_RANK, STATUS_RANK, TOP
from .bar_sql import BARS, FEATURES, OUTCOMES, SUMMARY
from .bar_sql import SQL as BAR_SQL
from .signal_sql import EVENTS, FAMILY, JUDGED
from .trend_sql import BROAD

RATED = f"WITH signals AS ({EVENTS} SELECT symbol, bar_start, bar_index, pattern_id, bias FROM ev WHERE status = 'confirmed' AND bias <> 'Neutral'), {OUTCOMES}"


def ranks(column: str, of: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in of.items()) + f" ELSE {len(of)} END"


def names(those: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in those)


RANKED = f"""{JUDGED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {ranks("status", STATUS_RANK)}, {ranks("state", STATE_RANK)}, abs(contribution) DESC, last - bar_index, priority, name, bar_index, kind, bias) AS rank FROM judged)"""
MEASURES = {"return": "directional_return", "raw": "raw_return", "mfe": "mfe", "mae": "mae"}
ALL_GROUPS = f"""{RATED}, contexts AS ({BROAD}), told AS (SELECT *, CASE WHEN bias = 'Bullish' THEN directional_return ELSE 0.0 - directional_return END AS raw_return,
    CASE touch WHEN 'target_first' THEN 0.01 WHEN 'stop_first' THEN -0.005 ELSE directional_return END AS trade_return FROM results JOIN contexts USING (symbol, bar_start) WHERE directional_return IS NOT NULL),
  seen AS (SELECT 'overall' AS kind, 'all' AS value, * FROM told UNION ALL SELECT 'pattern', pattern_id, * FROM told UNION ALL SELECT 'trend', trend, * FROM told
    UNION ALL SELECT 'session', CASE WHEN strftime(bar_start, '%H:%M:%S') < '09:30:00' THEN 'premarket' WHEN strftime(bar_start, '%H:%M:%S') < '16:00:00' THEN 'regular' ELSE 'afterhours' END || ' | ' || strftime(bar_start, '%H:%M'), * FROM told),
  domain AS (SELECT kind, value, unnest([1, 3, 6]) AS horizon FROM (SELECT DISTINCT kind, value FROM seen UNION SELECT 'overall', 'all'))
SELECT d.kind, d.value, d.horizon, count(s.kind) AS signals, count(*) FILTER (WHERE directional_return > 0) AS wins, count(*) FILTER (WHERE directional_return < 0) AS losses, count(*) FILTER (WHERE directional_return = 0) AS flat,
  round(avg((directional_return > 0)::INT), 9) AS precision, round(avg((directional_return < 0)::INT), 9) AS false_positive_rate, round(avg((trade_return > 0)::INT), 9) AS win_rate,
  {", ".join(f"round(avg({c}), 9) AS mean_{m}, round(median({c}), 9) AS median_{m}" for m, c in MEASURES.items())}, round(avg(trade_return), 9) AS expectancy,
  {", ".join(f"round(avg((touch = '{x}')::INT), 9) AS {n}" for n, x in (("target_first_rate", "target_first"), ("stop_first_rate", "stop_first"), ("neither_rate", "neither_hit"), ("same_bar_rate", "both_same_bar")))}
FROM domain d LEFT JOIN seen s ON s.kind = d.kind AND s.value = d.value AND s.horizon = d.horizon GROUP BY ALL"""
SQL = {
    "backtest_all_groups": ALL_GROUPS,
    "forward_outcomes": f"{RATED} SELECT symbol, bar_start, bar_index, pattern_id, bias, horizon, round(directional_return, 9) AS directional_return, round(mfe, 9) AS mfe, round(mae, 9) AS mae FROM results",
    "target_stop_first_touch": f"{RATED} SELECT symbol, bar_start, pattern_id, horizon, touch FROM results",
    "backtest_summary": f"{RATED} SELECT horizon, {SUMMARY} FROM results WHERE directional_return IS NOT NULL GROUP BY ALL",
    "backtest_summary_by_pattern": f"{RATED} SELECT pattern_id, horizon, {SUMMARY} FROM results WHERE directional_return IS NOT NULL GROUP BY ALL",
    "backtest_summary_by_session": f"{RATED} SELECT CASE WHEN strftime(bar_start, '%H:%M:%S') < '09:30:00' THEN 'premarket' WHEN strftime(bar_start, '%H:%M:%S') < '16:00:00' THEN 'regular' ELSE 'afterhours' END AS session_segment, horizon, {SUMMARY} FROM results WHERE directional_return IS NOT NULL GROUP BY ALL",
    "backtest_summary_by_context": f"{RATED}, contexts AS ({BROAD}) SELECT trend AS market_context, horizon, {SUMMARY} FROM results JOIN contexts USING (symbol, bar_start) WHERE directional_return IS NOT NULL GROUP BY ALL",
    "top_patterns": f"{RANKED} SELECT symbol, rank, bar_start, kind, pattern_id, name, bias, status, state FROM ranked WHERE rank <= {TOP}",
    "analytical_families": f"{EVENTS} SELECT symbol, {FAMILY} AS family, bias, count(*) AS n, count(DISTINCT pattern_id) AS patterns FROM first GROUP BY ALL",
    "signal_strength": f"WITH {FEATURES} SELECT symbol, bar_start, floor(greatest(range_strength, volume_strength) * 100 + 0.5) / 100 AS strength FROM f",
    "evidence_categories": f"""{JUDGED}, sorted AS (SELECT *, CASE WHEN state IN ({names(PAST)}) OR NOT CASE WHEN reason IS NULL THEN age <= max_age ELSE last - since <= {RECENT_BARS} END THEN 'historical_lifecycle'
        WHEN reason IS NULL AND abs(contribution + volume) > 0 THEN 'current_contributing' WHEN state = 'awaiting_confirmation' THEN 'awaiting_confirmation' WHEN bias = 'Neutral' OR status = 'candidate' THEN 'current_neutral'
        WHEN state IN ({names(RECENT)}) THEN 'recent_non_contributing' ELSE 'historical_lifecycle' END AS category FROM judged)
      SELECT symbol, category, state, count(*) AS n FROM sorted GROUP BY ALL""",
    "zoned_sessions": f"""WITH {BARS}, z AS (SELECT symbol, bar_start, zone, timezone(zone, timezone('UTC', bar_start)) AS local_start FROM bars, (VALUES ('America/New_York'), ('Asia/Jerusalem')) v(zone)),
      s AS (SELECT *, strftime(local_start, '%H:%M:%S') AS clock, strftime(local_start, '%Y-%m-%d') AS session_date FROM z)
      SELECT symbol, bar_start, zone, local_start, local_start::DATE AS trading_date, session_date, CASE WHEN clock < '09:30:00' THEN 'premarket' WHEN clock < '16:00:00' THEN 'regular' ELSE 'afterhours' END AS session_segment FROM s""",
    "validation_warnings": f"""WITH c AS ({BAR_SQL["validation_counters"]}), q AS (SELECT event_type AS symbol, time_bucket(INTERVAL '15 minutes', ts) AS t, event_id FROM events),
      u AS (SELECT symbol, count(*) FILTER (WHERE early) AS unsorted FROM (SELECT symbol, lag(t) OVER (PARTITION BY symbol ORDER BY event_id) > t AS early FROM q) GROUP BY 1),
      x AS (SELECT symbol, CASE WHEN unsorted > 0 THEN 'Input timestamps were unsorted.' END AS a, CASE WHEN duplicate_count > 0 THEN format('Found {{}} duplicate timestamps.', duplicate_count) END AS b,
        CASE WHEN missing_value_count > 0 THEN format('Found {{}} missing OHLCV values.', missing_value_count) END AS m, CASE WHEN invalid_ohlc_count > 0 THEN format('Found {{}} rows with invalid OHLCV values.', invalid_ohlc_count) END AS i,
        CASE WHEN irregular_gap_count > 0 THEN format('Detected {{}} irregular or mixed same-session interval(s) relative to interval 15m.', irregular_gap_count) END AS g FROM c JOIN u USING (symbol))
      SELECT symbol, concat_ws(' ', a, b, m, i, g) AS warnings, coalesce(a, b, m, i) AS strict_error FROM x""",
    "exact_duplicates": f"""{EVENTS}, both_runs AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE bar_start < TIMESTAMP '2024-01-15 00:00:00')
      SELECT symbol, pattern_id, copies, count(*) AS n FROM (SELECT symbol, bar_index, pattern_id, status, bias, bar_start, count(*) AS copies FROM both_runs GROUP BY ALL) GROUP BY ALL""",
    "event_history": f"""{JUDGED}, placed AS (SELECT symbol, bar_start, kind, pattern_id, name, state, since, row_number() OVER (PARTITION BY symbol ORDER BY since DESC, name, bar_index, kind, bias) AS place
        FROM judged) SELECT * FROM placed WHERE place <= 10""",
    "bar_labels": f"""WITH {BARS}, z AS (SELECT symbol, bar_start, timezone('America/New_York', timezone('UTC', bar_start)) AS t FROM bars),
      o AS (SELECT *, date_diff('minute', bar_start, t) AS m FROM z), p AS (SELECT *, CASE WHEN m < 0 THEN '-' ELSE '+' END || lpad((abs(m) // 60)::VARCHAR, 2, '0') AS h, lpad((abs(m) % 60)::VARCHAR, 2, '0') AS r FROM o)
      SELECT symbol, bar_start, strftime(t, '%Y-%m-%dT%H:%M') || h || ':' || r AS iso, strftime(t, '%Y-%m-%d %H:%M:%S') || h || r || ' America/New_York' AS display, strftime(t, '%Y-%m-%d %H:%M') || ' America/New_York' AS compact FROM p""",
}
