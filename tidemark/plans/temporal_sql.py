"""SQL of the calendar queries for DuckDB."""

from __future__ import annotations

from tidemark.plans.bars_sql import _BARS, _CELL

_H = "(date_part('hour', t) + date_part('minute', t) / 60.0::DOUBLE + date_part('second', t) / 3600.0::DOUBLE)"
_BOUNDS = "(VALUES ('W0', 0.0::DOUBLE, 7.0::DOUBLE), ('W1', 7.0, 12.5), ('W2', 12.5, 21.0), ('W3', 21.0, 24.0))"
CALENDAR = f"""WITH {_BARS}, t AS (SELECT symbol, timeframe, open_ms, make_timestamp(open_ms * 1000) AS t FROM bars), h AS (SELECT *, {_H} AS h FROM t)
SELECT symbol, timeframe, open_ms, name AS "window", CASE WHEN name = 'W1' AND h < 8 OR name = 'W2' AND h < 13 THEN 'EARLY' WHEN name = 'W1' AND h >= 11.5 OR name = 'W2' AND h >= 20.5 THEN 'LATE' ELSE 'MID' END AS phase,
  round((h - a) / (b - a), 6) AS progress, h >= 12.5 AND h < 16 AS is_overlap, h >= 7 AND h < 11 OR h >= 12.5 AND h < 16 AS is_core, CAST(floor(h * 2) AS INTEGER) AS day_bin,
  CASE date_part('isodow', t) WHEN 5 THEN 'FRIDAY' WHEN 6 THEN 'WEEKEND' WHEN 7 THEN 'WEEKEND' ELSE 'WEEKDAY' END AS day_type
FROM h JOIN {_BOUNDS} w(name, a, b) ON h >= a AND h < b"""
_MOVES = f"""{_BARS}, t AS (SELECT symbol, timeframe, n, open_ms, make_timestamp(open_ms * 1000) AS t, CASE WHEN c > 0 AND lag(c) OVER w > 0 THEN ln(c / lag(c) OVER w) END AS r FROM bars
  WHERE timeframe NOT IN ('1d', '1w', '1mo') WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
moves AS (SELECT *, {_H} AS h, CASE WHEN {_H} < 7 THEN 'W0' WHEN {_H} < 12.5 THEN 'W1' WHEN {_H} < 21 THEN 'W2' ELSE 'W3' END AS win FROM t WHERE r IS NOT NULL)"""
RANKS = f"""WITH {_MOVES}, v AS (SELECT symbol, timeframe, win, CAST(round(abs(r) / 1e-6) AS BIGINT) AS v FROM moves),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY {_CELL}, v) - 1) / 2.0::DOUBLE AS mid, count(*) OVER (PARTITION BY {_CELL}) AS n FROM v WINDOW w AS (PARTITION BY {_CELL} ORDER BY v)),
g AS (SELECT symbol, timeframe, n, win, sum(mid) AS s, count(*) AS m FROM k GROUP BY ALL), q AS (SELECT symbol, timeframe, n, sum(s * s / m) AS q, count(*) AS groups FROM g GROUP BY ALL),
x AS (SELECT symbol, timeframe, sum(CAST(c AS DOUBLE) ** 3 - c) AS ties FROM (SELECT symbol, timeframe, v, count(*) AS c FROM v GROUP BY ALL) GROUP BY ALL)
SELECT symbol, timeframe, groups, n, round(CASE WHEN 1 - ties / (CAST(n AS DOUBLE) ** 3 - n) > 1e-12 THEN (12.0::DOUBLE / (n * (n + 1.0::DOUBLE)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) ** 3 - n)) ELSE 0.0 END, 5) AS h
FROM q JOIN x USING (symbol, timeframe) WHERE groups > 1 AND n > 2"""
OPENING = f"""WITH {_MOVES}, d AS (SELECT *, CAST(t AS DATE) AS day, lag(CAST(t AS DATE)) OVER w AS before, sum(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS later, count(r) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS k
  FROM moves WINDOW w AS (PARTITION BY {_CELL} ORDER BY n))
SELECT symbol, timeframe, count(*) AS days, round(regr_slope(later, r), 6) AS slope FROM d WHERE day <> before AND k = 4 GROUP BY ALL HAVING count(*) >= 20"""

ORACLE = {"calendar": CALENDAR, "window_ranks": RANKS, "opening_momentum": OPENING}
