"""Relations of double events, which several SQL twins read, for DuckDB."""

from __future__ import annotations

from .bar_sql import FEATURES
from .trend_sql import TOLERANCE, double_outcomes

MORE = ", p1, p2, depth, tol, valley"
#: Relations up to ``deduped``: double events, and those that remain where setups share a second pivot.
DOUBLES = f"""WITH RECURSIVE bars_of AS (SELECT symbol, bar_index, high, low, close FROM (WITH {FEATURES} SELECT * FROM f)),
  sides AS (SELECT 'double_top' AS pattern_id, 'Bearish' AS bias, * FROM ({double_outcomes(True, MORE)}) UNION ALL SELECT 'double_bottom', 'Bullish', * FROM ({double_outcomes(False, MORE)})),
  shown AS (SELECT sides.*, floor(depth * 10000 + 0.5) / 100 AS strength, b.close AS closed, CASE WHEN pattern_id = 'double_top' THEN greatest(p1, p2, v.high, coalesce(b.high, p1)) ELSE least(p1, p2, v.low, coalesce(b.low, p1)) END AS rim
    FROM sides JOIN bars_of v ON v.symbol = sides.symbol AND v.bar_index = valley LEFT JOIN bars_of b ON b.symbol = sides.symbol AND b.bar_index = decided),
  doubles AS (SELECT symbol, pattern_id, bias, i1, i2, p1, p2, neckline, tol, strength, rim, 'tentative' AS status, known AS bar_index, neckline AS price, NULL::BIGINT AS confirmation FROM shown
    UNION ALL SELECT symbol, pattern_id, bias, i1, i2, p1, p2, neckline, tol, strength, rim, status, decided, CASE status WHEN 'expired' THEN neckline ELSE closed END, CASE status WHEN 'confirmed' THEN decided END FROM shown WHERE status <> 'tentative'),
  queue AS (SELECT *, dense_rank() OVER (ORDER BY symbol, pattern_id, i2, coalesce(confirmation, -1), status) AS g, row_number() OVER (PARTITION BY symbol, pattern_id, i2, confirmation, status ORDER BY bar_index, i1) AS k FROM doubles),
  led AS (SELECT DISTINCT g, 0::BIGINT AS k, []::DOUBLE[][] AS leaders, 0::BIGINT AS place FROM queue
    UNION ALL SELECT g, k, CASE WHEN spot > len(leaders) THEN list_append(leaders, row_of) ELSE leaders END, spot
    FROM (SELECT *, coalesce(nullif(list_position(list_transform(leaders, lambda l: abs(l[1] - row_of[1]) / greatest(abs(l[1]), abs(row_of[1]), 1e-9) <= 0.005 AND abs(l[2] - row_of[2]) / greatest(abs(l[2]), abs(row_of[2]), 1e-9) <= 0.005
        AND abs(l[3] - row_of[3]) / greatest(abs(l[3]), abs(row_of[3]), 1e-9) <= 0.005 AND abs(l[4] - row_of[4]) / greatest(abs(l[4]), abs(row_of[4]), 1e-9) <= 0.005), true), 0), len(leaders) + 1)::BIGINT AS spot
      FROM (SELECT q.g, q.k, o.leaders, [p1, p2, neckline, price]::DOUBLE[] AS row_of FROM led o JOIN queue q ON q.g = o.g AND q.k = o.k + 1))),
  deduped AS (SELECT q.* REPLACE (CASE WHEN bias = 'Bearish' THEN max(rim) OVER m ELSE min(rim) OVER m END AS rim), count(*) OVER m AS members FROM queue q JOIN led USING (g, k) WINDOW m AS (PARTITION BY g, place) QUALIFY row_number() OVER (PARTITION BY g, place ORDER BY strength DESC, i1) = 1)"""
#: Relations after ``deduped``: the first event of each group, the bar of the break it is linked to, and its state. They
#: need ``ends`` (symbol, last) and ``tall`` (bars with atr and bar_range).
FIRST_DOUBLES = f"""dfirst AS (SELECT * FROM deduped QUALIFY row_number() OVER (PARTITION BY symbol, pattern_id, i2, floor(neckline * 100 + 0.5) ORDER BY CASE status WHEN 'confirmed' THEN 0 WHEN 'tentative' THEN 1 ELSE 2 END, bar_index DESC, i1, status) = 1),
  rims AS (SELECT d.symbol, d.pattern_id, d.i1, d.i2, CASE WHEN bias = 'Bearish' THEN rim + {TOLERANCE.format(level='rim')} ELSE rim - {TOLERANCE.format(level='rim')} END AS edge FROM dfirst d JOIN tall t ON t.symbol = d.symbol AND t.bar_index = d.bar_index WHERE status = 'confirmed'),
  gone AS (SELECT d.symbol, d.pattern_id, d.i1, d.i2, min(x.bar_index) AS bad FROM dfirst d JOIN rims USING (symbol, pattern_id, i1, i2) JOIN tall x ON x.symbol = d.symbol AND x.bar_index > d.bar_index AND CASE WHEN bias = 'Bearish' THEN x.close > edge ELSE x.close < edge END WHERE status = 'confirmed' GROUP BY ALL),
  dstates AS (SELECT d.*, last, CASE status WHEN 'confirmed' THEN CASE WHEN bad IS NOT NULL THEN 'invalidated' WHEN last - bar_index > 16 THEN 'expired' WHEN bar_index = last THEN 'new' ELSE 'active' END
      WHEN 'tentative' THEN CASE WHEN last - bar_index > 6 THEN 'expired' ELSE 'awaiting_confirmation' END ELSE status END AS state,
      CASE WHEN status = 'confirmed' THEN coalesce(bad, CASE WHEN last - bar_index > 16 THEN least(last, bar_index + 17) ELSE bar_index END) WHEN status = 'tentative' AND last - bar_index > 6 THEN least(last, bar_index + 7) ELSE bar_index END AS since
    FROM dfirst d JOIN ends USING (symbol) LEFT JOIN gone USING (symbol, pattern_id, i1, i2))"""
