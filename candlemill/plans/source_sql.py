"""The SQL twins of the queries over instruments and streams, for DuckDB."""

from __future__ import annotations

from ..sources.instruments import ALIASES, PROFILES, SUFFIXES
from .bar_sql import BARS, FEATURES

rows = lambda table: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in table)
NAMES = rows([*[(p[0], p[0]) for p in PROFILES], *ALIASES.items()])
SQL = {
    "streamed_bars": f"WITH {BARS} SELECT * FROM bars WHERE bar_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'",
    "latest_sessions": f"""WITH {FEATURES}, ranked AS (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS d FROM f WHERE session_segment = 'regular')
      SELECT f.symbol, f.session_date, any_value(p.session_date) AS previous_date, min(bar_start) AS session_start, max(bar_start) AS last_bar, count(*) AS bars FROM f JOIN (SELECT DISTINCT symbol, session_date FROM ranked WHERE d = 1) l USING (symbol, session_date)
      LEFT JOIN (SELECT DISTINCT symbol, session_date FROM ranked WHERE d = 2) p ON p.symbol = f.symbol GROUP BY f.symbol, f.session_date""",
    "instrument_profiles": f"""WITH profiles(exchange, mic, zone, s, e, currency) AS (VALUES {rows(PROFILES)}), names(alias, code) AS (VALUES {NAMES}), tails(tail, code) AS (VALUES {rows(SUFFIXES.items())}),
      mapping AS (SELECT n_nationkey % 20 AS number, CASE WHEN n_nationkey % 7 <> 3 THEN upper(n_name[1:4]) || ['.TA', '.L', '.TO', '.V', '.AX', ''][n_nationkey % 6 + 1] END AS sym, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS name,
          CASE WHEN n_nationkey % 4 = 0 THEN 'nyq' END AS exchange, CASE WHEN n_nationkey % 5 = 0 THEN 'Europe/Paris' ELSE 'Asia/Jerusalem' END AS zone FROM nation QUALIFY row_number() OVER (PARTITION BY n_nationkey % 20 ORDER BY n_nationkey) = 1),
      found AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN sym WHEN 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'ABC.L' ELSE 'ABC.TO' END END AS symbol, name, m.exchange, m.zone,
          CASE c_custkey % 3 WHEN 0 THEN CASE WHEN number IS NULL THEN 'unknown number' WHEN sym IS NULL THEN 'no symbol' END WHEN 2 THEN 'blank' END AS problem
        FROM customer LEFT JOIN mapping m ON c_custkey % 3 = 0 AND number = c_custkey % 23)
      SELECT c_custkey, symbol, coalesce(name, symbol) AS name, coalesce(f.exchange, b.exchange, t.exchange) AS exchange, coalesce(b.currency, t.currency) AS currency, coalesce(f.zone, b.zone, t.zone) AS exchange_timezone, problem,
        coalesce(b.mic, t.mic) AS mic, coalesce(b.s, t.s) AS session_start, coalesce(b.e, t.e) AS session_end
      FROM found f LEFT JOIN names ON alias = upper(f.exchange) LEFT JOIN profiles b ON b.exchange = names.code LEFT JOIN tails ON tail = '.' || split_part(symbol, '.', 2) LEFT JOIN profiles t ON t.exchange = tails.code""",
}
