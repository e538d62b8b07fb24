"""The SQL twins of the queries over double events, evidence groups, confidence and assessments, for DuckDB."""

from __future__ import annotations

from .bar_sql import FEATURES
from .double_sql import DOUBLES, FIRST_DOUBLES
from .signal_sql import EVENTS, FAMILY, JUDGED
from .signal_sql import SQL as SIGNAL_SQL
from .trend_sql import BREAKS, BROAD
from .trend_sql import SQL as TREND_SQL

COLUMNS = "symbol, pattern_id, bias, i1, i2, p1, p2, neckline, strength, status, bar_index, price, confirmation"
SPENT = "('clustered correlated evidence', 'linked confirmation duplicate')"
SURE = f"""{JUDGED}, assessed AS ({SIGNAL_SQL["market_assessment"]}),
  strengths AS (SELECT symbol, bar_index, floor(greatest(range_strength, volume_strength) * 100 + 0.5) / 100 AS strength FROM (WITH {FEATURES} SELECT * FROM f)),
  mates AS (SELECT symbol, bar_start, kind, count(*) - 1 AS mates FROM (SELECT symbol, bar_start, kind FROM ev WHERE bias <> 'Neutral' AND status <> 'candidate' UNION ALL SELECT symbol, bar_start, kind FROM dwhole WHERE status = 'confirmed') GROUP BY ALL),
  left_out AS (SELECT symbol, sum(mates + CASE WHEN reason IN {SPENT} THEN 1 ELSE 0 END) AS suppressed FROM judged JOIN mates USING (symbol, bar_start, kind) WHERE reason IS NULL OR reason IN {SPENT} GROUP BY 1),
  counted AS (SELECT j.*, {FAMILY} AS fam, coalesce(own_strength, x.strength) AS strength FROM judged j LEFT JOIN strengths x USING (symbol, bar_index) WHERE reason IS NULL AND status = 'confirmed'),
  facts_of AS (SELECT symbol, count(*) AS evidence, count(DISTINCT (bar_start, kind)) AS groups, count(DISTINCT (fam, bias)) AS families, avg(pow(0.85::DOUBLE, age)) AS recency, avg(least(coalesce(strength, 0), 3) / 3) AS strength,
    count(DISTINCT CASE WHEN loud THEN bar_index END) / count(DISTINCT bar_index) AS volume_ratio FROM counted GROUP BY 1),
  filled AS (SELECT a.*, coalesce(evidence, 0) AS evidence, coalesce(groups, 0) AS groups, coalesce(families, 0) AS families, coalesce(recency, 0) AS recency, coalesce(strength, 0) AS strength, coalesce(volume_ratio, 0)::DOUBLE AS volume_ratio, coalesce(suppressed, 0)::BIGINT AS suppressed
    FROM assessed a LEFT JOIN facts_of USING (symbol) LEFT JOIN left_out USING (symbol)),
  sure AS (SELECT * REPLACE (CASE WHEN rule_confidence >= 28 THEN bias ELSE 'Neutral' END AS bias) FROM (SELECT *, CASE WHEN evidence = 0 THEN CASE WHEN trend <> 'Neutral' THEN 12 ELSE 5 END ELSE round(round(greatest(5, least(100,
      18 + least(groups, families + 1) * 7 + least(evidence, 4) * 6 + recency * 18 + strength * 14 + volume_ratio * 8 + CASE WHEN trend = 'Uptrend' AND bullish > bearish OR trend = 'Downtrend' AND bullish < bearish THEN 8 ELSE 0 END
      - conflict * 20 - suppressed * 4 - greatest(0, evidence - families) * 3 - greatest(0, groups - families) * 4 - (1 - recency) * 10 - CASE market_state WHEN 'Trend Only' THEN 12 ELSE 0 END))::DOUBLE, 9), 1) END::DOUBLE AS rule_confidence FROM filled))"""
SQL = {
    "double_events": f"{DOUBLES} SELECT {COLUMNS} FROM doubles",
    "structural_dedup": f"{DOUBLES} SELECT {COLUMNS}, members FROM deduped",
    "linked_breaks": f"""{DOUBLES}, broken AS (SELECT * FROM ({BREAKS})), wanted AS (SELECT *, CASE pattern_id WHEN 'double_top' THEN 'breakdown' ELSE 'breakout' END AS trigger FROM deduped),
      linked AS (SELECT w.symbol, w.pattern_id, i1, i2, status, w.bar_index, b.bar_index AS break_bar, 'linked' AS relation FROM wanted w JOIN broken b ON b.symbol = w.symbol AND b.pattern_id = w.trigger AND abs(b.bar_index - w.confirmation) <= 1 AND b.bar_index >= i2 AND abs(b.level - neckline) <= tol WHERE status = 'confirmed'),
      inferred AS (SELECT w.symbol, w.pattern_id, i1, i2, status, w.bar_index, b.bar_index AS break_bar, 'inferred' AS relation FROM wanted w JOIN broken b ON b.symbol = w.symbol AND b.pattern_id = w.trigger AND b.bar_index = w.bar_index AND abs(b.level - neckline) <= greatest(abs(neckline) * 0.01, 0.5)
        WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.symbol = w.symbol AND l.pattern_id = w.pattern_id AND l.i1 = w.i1 AND l.i2 = w.i2 AND l.status = w.status AND l.bar_index = w.bar_index))
      SELECT * FROM linked UNION ALL SELECT * FROM inferred""",
    "structural_states": f"""{DOUBLES}, tall AS (SELECT symbol, bar_index, close, atr, bar_range FROM (WITH {FEATURES} SELECT * FROM f)), ends AS (SELECT symbol, max(bar_index) AS last FROM bars_of GROUP BY 1), {FIRST_DOUBLES}
      SELECT symbol, pattern_id, bias, i1, i2, status, state, since FROM dstates""",
    "canonical_groups": f"""{EVENTS}, named AS (SELECT symbol, bar_start, kind, string_agg(DISTINCT name, ', ' ORDER BY name) AS names, count(*) AS events FROM ev GROUP BY ALL)
      SELECT symbol, bar_start, kind, pattern_id, bias, status, names, events FROM first JOIN named USING (symbol, bar_start, kind)""",
    "rule_confidence": f"{SURE} SELECT symbol, evidence, families, suppressed, round(volume_ratio, 9) AS volume_ratio, round(rule_confidence, 9) AS rule_confidence, bias FROM sure",
    "final_assessment": f"""{SURE}, nearby AS (SELECT symbol, arg_max(local_trend, bar_start) AS local_trend FROM ({TREND_SQL["trend_local"]}) GROUP BY 1),
      reasoned_final AS (SELECT *, CASE WHEN bias = 'Neutral' THEN '' ELSE concat_ws('; ', CASE WHEN bullish > 0 AND bearish > 0 THEN 'bullish and bearish evidence are both currently contributing to the score' END,
          CASE WHEN bias = 'Bullish' AND trend = 'Downtrend' OR bias = 'Bearish' AND trend = 'Uptrend' THEN 'the broader trend is ' || trend || ', opposing the bias' END,
          CASE WHEN trend <> 'Neutral' AND local_trend <> 'Neutral' AND trend <> local_trend THEN 'the broad trend (' || trend || ') and local session trend (' || local_trend || ') disagree' END) END AS reasons FROM sure LEFT JOIN nearby USING (symbol))
      SELECT symbol, trend, local_trend, bias, round(rule_confidence, 9) AS rule_confidence, CASE WHEN reasons <> '' OR bias = 'Neutral' THEN 'NEUTRAL' WHEN bias = 'Bullish' THEN 'RECOMMEND TO BUY' ELSE 'NOT RECOMMENDED' END AS recommendation,
        CASE WHEN rule_confidence >= 60 AND reasons = '' THEN 'HIGH' WHEN rule_confidence >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS confidence_level, reasons FROM reasoned_final""",
    "score_reconciliation": f"""{JUDGED}, assessed AS ({SIGNAL_SQL["market_assessment"]}), totals AS (SELECT symbol,
        count(*) FILTER (WHERE reason IS NULL AND state IN ('expired', 'invalidated', 'failed_breakout', 'failed_breakdown', 'failed', 'awaiting_confirmation')) AS counted_wrongly,
        count(*) FILTER (WHERE reason IS NOT NULL AND abs(contribution) + abs(volume) > 0) AS left_out_wrongly, sum(contribution) FILTER (WHERE reason IS NULL) AS s, sum(volume) FILTER (WHERE reason IS NULL) AS v FROM judged GROUP BY 1)
      SELECT symbol, coalesce(counted_wrongly, 0) AS counted_wrongly, coalesce(left_out_wrongly, 0) AS left_out_wrongly, abs(bullish - bearish - coalesce(s, 0)) < 0.01 AS sums_agree, abs(volume - coalesce(v, 0)) < 0.01 AS volumes_agree FROM assessed LEFT JOIN totals USING (symbol)""",
    "confirmation_fields": f"""{JUDGED}, asked AS (SELECT e.pattern_id, e.status, s.state, e.pattern_id IN ('bullish_pin_bar', 'hammer', 'shooting_star') AS staged, e.pattern_id IN ('breakout', 'breakdown') AS broke, e.pattern_id LIKE 'double%' AS twice FROM firsts e JOIN all_states s USING (symbol, bar_start, kind))
      SELECT pattern_id, state, CASE WHEN NOT staged THEN 'Not Applicable' WHEN status = 'candidate' THEN 'Rejected' ELSE 'Validated' END AS context_status,
        CASE WHEN twice AND status = 'confirmed' THEN 'Confirmed' WHEN twice AND status = 'failed' THEN 'Failed' WHEN state = 'awaiting_confirmation' THEN 'Pending' WHEN NOT staged THEN 'Not Required' WHEN state = 'directionally_confirmed' THEN 'Confirmed' WHEN state = 'invalidated' THEN 'Failed' WHEN status = 'tentative' THEN 'Pending' ELSE 'Not Required' END AS directional_confirmation,
        CASE WHEN twice AND status = 'confirmed' THEN 'Present' WHEN twice AND status = 'failed' THEN 'Failed' WHEN state = 'awaiting_confirmation' THEN 'Pending' WHEN staged AND state = 'directionally_confirmed' OR broke AND state = 'retest_rejected' THEN 'Present' WHEN staged AND state = 'invalidated' OR broke AND state IN ('reclaimed', 'failed_breakout', 'failed_breakdown') THEN 'Failed'
          WHEN staged AND status = 'tentative' OR broke AND state IN ('new', 'active', 'retest_pending') THEN 'Pending' ELSE 'Not Applicable' END AS follow_through, count(*) AS n FROM asked GROUP BY ALL""",
    "candle_summaries": f"""{EVENTS}, shapes AS (SELECT symbol, bar_index, open, high, low, close, high - low AS r FROM (WITH {FEATURES} SELECT * FROM f))
      SELECT symbol, bar_index, pattern_id, bias, open, high, low, close, CASE WHEN r > 1e-9 THEN round(abs(close - open) / r, 9) ELSE 0 END AS body_ratio, CASE WHEN r > 1e-9 THEN round((high - greatest(open, close)) / r, 9) ELSE 0 END AS upper_wick_ratio,
        CASE WHEN r > 1e-9 THEN round((least(open, close) - low) / r, 9) ELSE 0 END AS lower_wick_ratio, CASE WHEN r > 1e-9 THEN round((close - low) / r, 9) ELSE 0.5::DOUBLE END AS close_location FROM ev JOIN shapes USING (symbol, bar_index)""",
    "break_evidence": f"""SELECT symbol, bar_start, CASE WHEN break_score > 0 THEN 'Price confirmed an upside break above the prior 30-bar high.' ELSE 'Price confirmed a downside break below the prior 30-bar low.' END AS evidence
      FROM ({TREND_SQL["break_structure_score"]}) WHERE abs(break_score) >= 4""",
    "historical_signals": f"""{EVENTS}, broad AS ({BROAD}), at_bar AS (SELECT symbol, bar_start, close AS entry_price, floor(greatest(range_strength, volume_strength) * 100 + 0.5) / 100 AS strength,
        CASE WHEN strftime(bar_start, '%H:%M:%S') < '09:30:00' THEN 'premarket' WHEN strftime(bar_start, '%H:%M:%S') < '16:00:00' THEN 'regular' ELSE 'afterhours' END AS session_segment FROM (WITH {FEATURES} SELECT * FROM f))
      SELECT symbol, bar_start, kind, bar_index, pattern_id, bias, status, entry_price, session_segment, strength, trend FROM first JOIN at_bar USING (symbol, bar_start) JOIN broad USING (symbol, bar_start) WHERE bias <> 'Neutral' AND status <> 'candidate' AND bar_index >= 19""",
}
#: Prices that walk by steps of the values, so that doubles merge and meet breaks.
WALK = "FROM (SELECT * REPLACE (100.0::DOUBLE + (sum((floor(value * 100)::BIGINT % 201) - 100) OVER (PARTITION BY event_type ORDER BY ts, event_id))::DOUBLE / 200.0::DOUBLE AS value) FROM events)"
OF_WALK = {"walked_dedup": SQL["structural_dedup"], "walked_links": SQL["linked_breaks"], "walked_states": SQL["structural_states"], "walked_eligibility": SIGNAL_SQL["eligibility"]}
SQL |= {name: sql.replace("FROM events", WALK) for name, sql in OF_WALK.items()}
