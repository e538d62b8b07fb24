"""The SQL twins of the queries over events, for DuckDB."""

from __future__ import annotations

from ..operators.ranking import FAMILIES
from ..operators.signals import WEIGHTS
from .bar_sql import FEATURES
from .double_sql import DOUBLES, FIRST_DOUBLES
from .trend_sql import BREAKS, BROAD, REJECTIONS, TOLERANCE

FAMILY = "CASE " + " ".join(f"WHEN pattern_id IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in FAMILIES.items()) + " ELSE 'other' END"
TABLE = ", ".join(f"('{k}', {b}, {p}, {s}, {a})" for k, (b, p, s, a) in WEIGHTS.items())
EVENTS = f"""WITH raw AS (
    SELECT symbol, bar_start, bar_index, pattern_id, pattern_id AS name, bias, CASE WHEN pattern_id = 'doji' THEN 'candidate' ELSE 'confirmed' END AS status, false AS strong, NULL::DOUBLE AS level FROM (WITH {FEATURES} SELECT * FROM patterns WHERE pattern_id NOT LIKE '%rejection')
    UNION ALL SELECT symbol, bar_start, bar_index, pattern_id, name, bias, status, false, NULL FROM ({REJECTIONS})
    UNION ALL SELECT symbol, bar_start, bar_index, pattern_id, pattern_id, bias, 'confirmed', strong, level FROM ({BREAKS})),
  ev AS (SELECT raw.* , CASE WHEN strong THEN 26 ELSE w.base END AS base, priority, specificity, max_age, coalesce(volume_strength >= 1, false) AS loud,
      CASE WHEN pattern_id IN ('breakout', 'breakdown') THEN pattern_id WHEN pattern_id LIKE 'inside%' THEN 'inside:' || bias WHEN pattern_id LIKE '%engulfing' THEN 'engulfing:' || bias ELSE 'candlestick' END AS kind,
      CASE WHEN pattern_id IN ('bullish_pin_bar', 'hammer', 'shooting_star') THEN CASE bias WHEN 'Bearish' THEN high WHEN 'Bullish' THEN low END WHEN pattern_id = 'morning_star' THEN star_low WHEN pattern_id = 'evening_star' THEN star_high WHEN pattern_id IN ('breakout', 'breakdown') THEN level END AS zone
    FROM raw JOIN (VALUES {TABLE}) w(pattern_id, base, priority, specificity, max_age) USING (pattern_id) JOIN (WITH {FEATURES} SELECT symbol, bar_index, high, low, lag(high) OVER v AS star_high, lag(low) OVER v AS star_low, volume_strength FROM f WINDOW v AS (PARTITION BY symbol ORDER BY bar_start)) USING (symbol, bar_index)),
  first AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY symbol, bar_start, kind ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'tentative' THEN 1 ELSE 2 END, bias = 'Neutral', specificity DESC, name LIKE '%Rejection', priority, base DESC, name, pattern_id) = 1)"""
def chains(events: str, tolerance: float) -> str:
    """Relations up to ``chained``: events with a zone and the number of their chain."""
    return f"""chain_zone AS (SELECT *, {FAMILY} AS family FROM {events} e WHERE zone IS NOT NULL AND bias <> 'Neutral'),
  chain_pair AS (SELECT *, lag(bar_index) OVER w AS i, lag(zone) OVER w AS y FROM chain_zone WINDOW w AS (PARTITION BY symbol, family, bias ORDER BY bar_index, pattern_id)),
  chain_mark AS (SELECT *, CASE WHEN bar_index - i <= 5 AND abs(zone - y) / greatest(abs(zone), abs(y), 1e-6) <= {tolerance}::DOUBLE AND NOT EXISTS (SELECT 1 FROM {events} o WHERE o.symbol = chain_pair.symbol AND o.bar_index > chain_pair.i AND o.bar_index < chain_pair.bar_index AND o.status = 'confirmed' AND o.bias <> 'Neutral' AND o.bias <> chain_pair.bias) THEN 0 ELSE 1 END AS fresh FROM chain_pair),
  chained AS (SELECT *, sum(fresh) OVER (PARTITION BY symbol, family, bias ORDER BY bar_index, pattern_id) AS cluster FROM chain_mark)"""


#: Prices of the table drawn together, so that zones meet as those of one instrument do.
CLOSE_TABLE = "FROM (SELECT * REPLACE (100.0::DOUBLE + value / 1000.0::DOUBLE AS value) FROM events)"
STATES = f"""{EVENTS}, b AS (WITH {FEATURES} SELECT symbol, bar_index, open, high, low, close, atr, bar_range, rolling_high, rolling_low, lag(close) OVER w AS pc,
      least(low, lag(low) OVER w) AS l2, greatest(high, lag(high) OVER w) AS h2, min(low) OVER v AS l3, max(high) OVER v AS h3, max(bar_index) OVER (PARTITION BY symbol) AS last
    FROM f WINDOW w AS (PARTITION BY symbol ORDER BY bar_index), v AS (PARTITION BY symbol ORDER BY bar_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
  own AS (SELECT e.symbol, e.bar_start, e.bar_index, kind, pattern_id, bias, max_age, b.* EXCLUDE (symbol, bar_index), CASE pattern_id WHEN 'breakout' THEN rolling_high WHEN 'breakdown' THEN rolling_low END AS level,
      CASE WHEN pattern_id LIKE '%engulfing' OR pattern_id = 'inside_bar' THEN l2 WHEN pattern_id LIKE '%star' AND pattern_id <> 'shooting_star' OR pattern_id = 'inside_bar_failure' THEN l3 ELSE b.low END AS bottom,
      CASE WHEN pattern_id LIKE '%engulfing' OR pattern_id = 'inside_bar' THEN h2 WHEN pattern_id LIKE '%star' AND pattern_id <> 'shooting_star' OR pattern_id = 'inside_bar_failure' THEN h3 ELSE b.high END AS top
    FROM first e JOIN b USING (symbol, bar_index)),
  zoned AS (SELECT *, level - {TOLERANCE.format(level='level')} AS zl, level + {TOLERANCE.format(level='level')} AS zu, {TOLERANCE.format(level='bottom')} AS bt, {TOLERANCE.format(level='top')} AS tt, {TOLERANCE.format(level='low')} AS lt, {TOLERANCE.format(level='high')} AS ht FROM own),
  later AS (SELECT z.symbol, z.bar_index AS i, z.kind, x.bar_index AS j, x.bar_index > z.bar_index + 1 AND CASE pattern_id WHEN 'breakout' THEN x.close < zl AND x.pc < zl WHEN 'breakdown' THEN x.close > zu AND x.pc > zu END AS fail,
      CASE pattern_id WHEN 'breakout' THEN x.close < zl WHEN 'breakdown' THEN x.close > zu END AS lose, CASE WHEN level IS NOT NULL THEN x.high >= zl AND x.low <= zu END AS touch,
      CASE pattern_id WHEN 'breakout' THEN x.close >= level AND (x.close > zu OR (x.close > x.open AND x.low <= level)) WHEN 'breakdown' THEN x.close <= level AND (x.close < zl OR (x.close < x.open AND x.high >= level)) END AS reject,
      CASE WHEN level IS NOT NULL THEN false WHEN pattern_id = 'bullish_pin_bar' THEN x.close < z.low WHEN pattern_id = 'shooting_star' THEN x.close > z.high WHEN bias = 'Bullish' THEN x.close < bottom - bt WHEN bias = 'Bearish' THEN x.close > top + tt ELSE false END AS bad,
      CASE WHEN pattern_id IN ('hammer', 'bullish_pin_bar') THEN x.close > z.high + ht WHEN pattern_id = 'shooting_star' THEN x.close < z.low - lt ELSE false END AS good,
      CASE WHEN pattern_id IN ('hammer', 'bullish_pin_bar') THEN x.low <= z.low + (z.high - z.low) * 0.35::DOUBLE AND x.close > z.low + (z.high - z.low) * 0.35::DOUBLE
        WHEN pattern_id = 'shooting_star' THEN x.high >= z.high - (z.high - z.low) * 0.35::DOUBLE AND x.close < z.high - (z.high - z.low) * 0.35::DOUBLE ELSE false END AS again
    FROM zoned z JOIN b x ON x.symbol = z.symbol AND x.bar_index > z.bar_index),
  touched AS (SELECT *, min(CASE WHEN touch THEN j END) OVER (PARTITION BY symbol, i, kind) AS t FROM later),
  met AS (SELECT symbol, i AS bar_index, kind, min(j) FILTER (WHERE fail) AS failed, min(j) FILTER (WHERE lose) AS lost, max(j) FILTER (WHERE lose) AS latest, any_value(t) AS back, min(j) FILTER (WHERE reject AND j >= t) AS rejected,
      min(j) FILTER (WHERE bad) AS bad, min(j) FILTER (WHERE good) AS good, min(j) FILTER (WHERE again) AS again FROM touched GROUP BY ALL),
  facts AS (SELECT o.*, failed, lost, latest, rejected, bad, good, CASE WHEN level IS NOT NULL THEN CASE WHEN lost IS NULL THEN back END WHEN bad IS NULL AND good IS NULL THEN again END AS retest FROM own o LEFT JOIN met USING (symbol, bar_index, kind)),
  spent AS (SELECT *, CASE WHEN last - coalesce(CASE WHEN level IS NULL THEN retest END, bar_index) > max_age THEN least(last, coalesce(CASE WHEN level IS NULL THEN retest END, bar_index) + max_age + 1) END AS over FROM facts),
  states AS (SELECT symbol, bar_start, bar_index, kind, pattern_id, bias, max_age, last,
      CASE WHEN level IS NOT NULL THEN CASE WHEN failed IS NOT NULL THEN 'failed_' || pattern_id WHEN lost IS NOT NULL THEN 'reclaimed' WHEN rejected IS NOT NULL THEN 'retest_rejected' WHEN retest IS NOT NULL THEN 'retest_pending' WHEN over IS NOT NULL THEN 'expired' WHEN bar_index = last THEN 'new' ELSE 'active' END
        WHEN bad <= coalesce(good, bad) THEN 'invalidated' WHEN good IS NOT NULL THEN 'directionally_confirmed' WHEN over IS NOT NULL THEN 'expired' WHEN bar_index = last THEN 'new' WHEN retest IS NOT NULL THEN 'retested' ELSE 'active' END AS state,
      CASE WHEN level IS NOT NULL THEN CASE WHEN failed IS NOT NULL THEN failed WHEN lost IS NOT NULL THEN latest ELSE coalesce(rejected, retest, over, bar_index) END
        WHEN bad <= coalesce(good, bad) THEN bad ELSE coalesce(good, over, retest, bar_index) END AS since, retest FROM spent)"""
JUDGED = f"""{STATES}, days AS (SELECT symbol, bar_index, (bar_start + INTERVAL '1 hour')::DATE AS day FROM (WITH {FEATURES} SELECT * FROM f)),
  deduped AS MATERIALIZED ({DOUBLES} SELECT * FROM deduped), tall AS (SELECT symbol, bar_index, close, atr, bar_range FROM b), ends AS (SELECT symbol, max(bar_index) AS last FROM b GROUP BY 1), {FIRST_DOUBLES},
  dwhole AS (SELECT d.*, bar_start, 'structural:' || pattern_id || ':' || i2 || ':' || floor(neckline * 100 + 0.5)::BIGINT AS kind, coalesce(volume_strength >= 1, false) AS loud FROM deduped d JOIN (WITH {FEATURES} SELECT symbol, bar_index, bar_start, volume_strength FROM f) USING (symbol, bar_index)),
  meetings AS (SELECT d.symbol, d.pattern_id, d.i1, d.i2, d.status, r.bar_index AS broken, r.bar_index >= i2 AND abs(r.zone - neckline) <= tol AS sure FROM dfirst d JOIN first r ON r.symbol = d.symbol AND r.pattern_id = CASE d.pattern_id WHEN 'double_top' THEN 'breakdown' ELSE 'breakout' END
      WHERE d.status = 'confirmed' AND (abs(r.bar_index - confirmation) <= 1 AND r.bar_index >= i2 AND abs(r.zone - neckline) <= tol OR r.bar_index = d.bar_index AND abs(r.zone - neckline) <= greatest(abs(neckline) * 0.01, 0.5))),
  stars AS (SELECT symbol, pattern_id, i1, i2, status, coalesce(min(broken) FILTER (WHERE sure), min(broken)) AS star FROM meetings GROUP BY ALL),
  firsts AS (SELECT symbol, bar_start, bar_index, pattern_id, name, bias, status, strong, base, priority, specificity, max_age, loud, kind, zone, bar_index AS anchored, NULL::BIGINT AS star, NULL::DOUBLE AS own_strength FROM first
    UNION ALL SELECT w.symbol, w.bar_start, w.bar_index, w.pattern_id, w.pattern_id, w.bias, w.status, false, 20, 2, 24, CASE w.status WHEN 'tentative' THEN 6 ELSE 16 END, w.loud, w.kind, w.neckline, CASE w.status WHEN 'tentative' THEN w.i2 ELSE w.bar_index END, star, w.strength
      FROM dwhole w JOIN dfirst USING (symbol, pattern_id, i1, i2, status) LEFT JOIN stars USING (symbol, pattern_id, i1, i2, status)),
  all_states AS (SELECT symbol, bar_start, kind, state, since, last FROM states UNION ALL SELECT symbol, bar_start, kind, state, since, last FROM dstates JOIN dwhole USING (symbol, pattern_id, i1, i2, status)),
  aged AS (SELECT a.*, state, since, s.last, CASE WHEN state IN ('retest_rejected', 'retest_pending', 'invalidated', 'failed', 'failed_breakout', 'failed_breakdown', 'reclaimed') THEN since WHEN state = 'expired' THEN s.last ELSE anchored END AS anchor FROM firsts a JOIN all_states s USING (symbol, bar_start, kind)),
  dated AS (SELECT aged.*, last - anchor AS age, day, (SELECT max(day) FROM days d WHERE d.symbol = aged.symbol) AS last_day, status = 'tentative' AND state IN ('new', 'active', 'retested') AS pending FROM aged JOIN days ON days.symbol = aged.symbol AND days.bar_index = anchor),
  reasoned AS (SELECT *, CASE WHEN day <> last_day THEN 'outside current trading session' WHEN bias = 'Neutral' THEN 'informational only' WHEN pending OR state = 'directionally_confirmed' THEN CASE WHEN age > max_age THEN 'outside scoring horizon' END
      WHEN state IN ('expired', 'invalidated') THEN state WHEN state = 'failed' THEN 'failed pattern' WHEN state = 'awaiting_confirmation' THEN 'awaiting neckline confirmation' WHEN state LIKE 'failed%' THEN replace(state, '_', ' ') WHEN state = 'reclaimed' THEN 'level reclaimed' WHEN status = 'tentative' THEN 'unconfirmed structural pattern' WHEN age > max_age THEN 'outside scoring horizon' END AS reason FROM dated),
  worthy AS (SELECT *, CASE WHEN reason IS NULL THEN CASE bias WHEN 'Bullish' THEN 1 ELSE -1 END * pow(0.85::DOUBLE, age) ELSE 0 END AS unit FROM reasoned),
  weighty AS (SELECT *, unit * CASE WHEN pending THEN 1.5::DOUBLE ELSE base * CASE WHEN strong THEN 1.15::DOUBLE ELSE 1 END * CASE WHEN status = 'tentative' THEN 0.5::DOUBLE ELSE 1 END END AS contribution, CASE WHEN loud AND NOT pending THEN unit * 2.5::DOUBLE ELSE 0 END AS vol FROM worthy),
  voices AS MATERIALIZED (SELECT symbol, bias, coalesce(star, bar_index) AS hub, kind, pattern_id LIKE 'double%' AS twice, (-abs(contribution), age, CASE WHEN pattern_id LIKE 'double%' THEN 1 WHEN strong THEN 2 ELSE 0 END, kind) AS rank FROM weighty WHERE reason IS NULL AND (pattern_id LIKE 'double%' OR pattern_id LIKE 'break%')),
  led AS (SELECT a.symbol, a.kind, a.hub FROM voices a WHERE NOT a.twice AND EXISTS (SELECT 1 FROM voices d WHERE d.twice AND d.symbol = a.symbol AND d.bias = a.bias AND d.hub = a.hub)
    UNION ALL SELECT d.symbol, d.kind, d.hub FROM voices d WHERE d.twice AND EXISTS (SELECT 1 FROM voices o WHERE o.twice AND o.symbol = d.symbol AND o.bias = d.bias AND o.hub = d.hub AND o.rank < d.rank)
      AND EXISTS (SELECT 1 FROM voices a WHERE NOT a.twice AND a.symbol = d.symbol AND a.bias = d.bias AND a.hub = d.hub AND NOT EXISTS (SELECT 1 FROM voices o WHERE o.twice AND o.symbol = d.symbol AND o.bias = d.bias AND o.hub = d.hub AND o.rank < a.rank))),
  paid AS (SELECT w.* EXCLUDE (reason, contribution, vol), CASE WHEN l.symbol IS NULL THEN reason ELSE 'linked confirmation duplicate' END AS reason, CASE WHEN l.symbol IS NULL THEN contribution ELSE 0 END AS contribution, CASE WHEN l.symbol IS NULL THEN vol ELSE 0 END AS vol
    FROM weighty w LEFT JOIN led l ON l.symbol = w.symbol AND l.kind = w.kind AND l.hub = coalesce(w.star, w.bar_index)),
  single AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY symbol, bar_index, bias ORDER BY vol = 0, abs(contribution) DESC, priority, pattern_id) = 1 THEN vol ELSE 0 END AS volume FROM paid),
  {chains("(SELECT * FROM single WHERE reason IS NULL)", 0.006)},
  sized AS (SELECT symbol, bar_start, kind, count(*) OVER c AS members, max(abs(contribution)) OVER c AS best, row_number() OVER (PARTITION BY symbol, family, bias, cluster ORDER BY abs(contribution) DESC, bar_index, pattern_id) AS k FROM chained WINDOW c AS (PARTITION BY symbol, family, bias, cluster)),
  judged AS (SELECT s.* EXCLUDE (reason, contribution, volume), CASE WHEN members > 1 AND k > 1 THEN 'clustered correlated evidence' ELSE reason END AS reason, CASE WHEN members > 1 AND k > 1 THEN 0 ELSE volume END AS volume,
      CASE WHEN members > 1 AND k > 1 THEN 0 WHEN members > 1 THEN CASE bias WHEN 'Bullish' THEN 1 ELSE -1 END * least(best + 1.5::DOUBLE * (members - 1), best * 1.35::DOUBLE) ELSE contribution END AS contribution FROM single s LEFT JOIN sized USING (symbol, bar_start, kind))"""
SQL = {
    "eligibility": f"{JUDGED} SELECT symbol, bar_start, kind, pattern_id, state, anchor, age, reason, round(contribution, 9) AS contribution, round(volume, 9) AS volume FROM judged",
    "exclusion_reasons": f"{JUDGED} SELECT symbol, coalesce(reason, 'counted') AS reason, count(*) AS n FROM judged GROUP BY ALL",
    "market_assessment": f"""{JUDGED}, broad AS ({BROAD}), trends AS (SELECT b.symbol, arg_max(b.trend, b.bar_start) AS trend FROM broad b GROUP BY 1),
      live AS (SELECT * FROM judged WHERE reason IS NULL AND state IN ('new', 'active', 'retested', 'retest_pending', 'retest_rejected', 'directionally_confirmed')),
      newest AS (SELECT symbol, pattern_id AS newest_id, state AS newest_state, age AS newest_age FROM live QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY age, priority, bar_index, pattern_id, bias) = 1),
      turns AS (SELECT symbol, bool_or(pattern_id IN ('bullish_pin_bar', 'hammer', 'double_bottom')) AS turns_up, bool_or(pattern_id IN ('shooting_star', 'double_top')) AS turns_down FROM live GROUP BY 1),
      sums AS (SELECT symbol, sum(greatest(contribution, 0)) AS bullish, sum(-least(contribution, 0)) AS bearish, sum(volume) AS volume, count(*) FILTER (WHERE reason IS NULL AND status = 'confirmed') AS confirmed FROM judged GROUP BY 1),
      merged AS (SELECT symbol, trend, coalesce(bullish, 0)::DOUBLE AS bullish, coalesce(bearish, 0)::DOUBLE AS bearish, coalesce(volume, 0)::DOUBLE AS volume, coalesce(confirmed, 0) AS confirmed, turns_up, turns_down, newest_id, newest_state, newest_age FROM trends LEFT JOIN sums USING (symbol) LEFT JOIN newest USING (symbol) LEFT JOIN turns USING (symbol)),
      netted AS (SELECT *, bullish - bearish AS p, bullish - bearish + volume + CASE trend WHEN 'Uptrend' THEN 12 WHEN 'Downtrend' THEN -12 ELSE 0 END AS net, CASE WHEN bullish > 0 AND bearish > 0 THEN least(bullish, bearish) / greatest(bullish, bearish) ELSE 0.0::DOUBLE END AS conflict FROM merged)
      SELECT symbol, trend, round(bullish, 9) AS bullish, round(bearish, 9) AS bearish, round(volume, 9) AS volume, round(net, 9) AS net, round(conflict, 9) AS conflict,
        CASE WHEN newest_id IS NULL THEN CASE WHEN trend = 'Neutral' THEN 'Neutral' ELSE 'Trend Only' END WHEN conflict >= 0.65 THEN 'Conflicted' WHEN newest_id = 'breakout' AND newest_age <= 3 THEN 'Breakout Attempt'
          WHEN newest_id = 'breakdown' AND newest_age <= 3 AND newest_state = 'retest_pending' THEN 'Bearish Continuation Under Retest' WHEN newest_id = 'breakdown' AND newest_age <= 3 AND trend = 'Downtrend' THEN 'Breakdown Attempt'
          WHEN trend = 'Downtrend' AND turns_up THEN 'Bearish Trend with Bullish Reversal Attempt' WHEN trend = 'Uptrend' AND turns_down THEN 'Bullish Trend with Bearish Reversal Attempt' WHEN trend = 'Uptrend' AND p > 0 THEN 'Bullish Continuation' WHEN trend = 'Downtrend' AND p < 0 THEN 'Bearish Continuation'
          WHEN trend <> 'Neutral' AND p <> 0 THEN 'Reversal Watch' WHEN p > 0 THEN 'Bullish Setup' WHEN p < 0 THEN 'Bearish Setup' ELSE 'Neutral' END AS market_state,
        CASE WHEN confirmed = 0 OR abs(net) < 12 OR conflict >= 0.65 THEN 'Neutral' WHEN net > 0 THEN 'Bullish' ELSE 'Bearish' END AS bias FROM netted""",
    "lifecycle_states": f"{STATES} SELECT symbol, bar_start, bar_index, kind, pattern_id, bias, state, since, retest FROM states",
    "lifecycle_counts": f"{STATES} SELECT pattern_id, bias, state, count(*) AS n FROM states GROUP BY ALL",
    "market_context_counts": f"{EVENTS} SELECT symbol, pattern_id, bias, status, count(*) AS n FROM ev GROUP BY ALL",
    "group_primary_top1": f"{EVENTS} SELECT symbol, bar_start, kind, pattern_id, name, bias, status, base FROM first",
    "cluster_islands": f"""{EVENTS.replace("FROM events", CLOSE_TABLE)}, {chains("first", 0.006)}
      SELECT symbol, family, bias, min(bar_index) AS first_bar, max(bar_index) AS last_bar, count(*) AS members, CASE bias WHEN 'Bullish' THEN 1 ELSE -1 END * least(max(base) + 1.5::DOUBLE * (count(*) - 1), max(base) * 1.35::DOUBLE) AS bounded FROM chained GROUP BY symbol, family, bias, cluster HAVING count(*) > 1""",
    "signal_scores": f"""{EVENTS}, broad AS ({BROAD}), ends AS (SELECT b.symbol, max(f.bar_index) AS last, arg_max(b.trend, f.bar_index) AS trend FROM broad b JOIN (WITH {FEATURES} SELECT symbol, bar_start, bar_index FROM f) f USING (symbol, bar_start) GROUP BY 1),
      worth AS (SELECT symbol, CASE bias WHEN 'Bullish' THEN 1 WHEN 'Bearish' THEN -1 ELSE 0 END * pow(0.85::DOUBLE, last - bar_index) AS unit, base * CASE WHEN strong THEN 1.15::DOUBLE ELSE 1 END AS b, loud FROM first JOIN ends USING (symbol) WHERE status = 'confirmed' AND last - bar_index <= max_age),
      sums AS (SELECT symbol, sum(greatest(unit * b, 0)) AS bullish, sum(-least(unit * b, 0)) AS bearish, sum(CASE WHEN loud THEN unit * 2.5::DOUBLE ELSE 0 END) AS volume FROM worth GROUP BY 1),
      points AS (SELECT symbol, coalesce(bullish, 0) AS bullish, coalesce(bearish, 0) AS bearish, coalesce(volume, 0) AS volume, CASE trend WHEN 'Uptrend' THEN 12 WHEN 'Downtrend' THEN -12 ELSE 0 END::DOUBLE AS trend_points FROM ends LEFT JOIN sums USING (symbol))
      SELECT symbol, round(bullish, 9) AS bullish, round(bearish, 9) AS bearish, round(volume, 9) AS volume, trend_points, round(bullish - bearish + volume + trend_points, 9) AS net FROM points""",
}
