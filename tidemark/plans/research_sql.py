"""SQL of the research queries for DuckDB."""

from __future__ import annotations

import math

from tidemark.functions.features import DERIVED, EVENTS, expand
from tidemark.plans.bars_sql import _BARS, _CELL

_W = f"PARTITION BY {_CELL} ORDER BY n"
_TRADES = f"""{_BARS},
x AS (SELECT *, {expand(DERIVED['tr'], _CELL)} AS tr FROM bars),
s AS (SELECT symbol, timeframe, n, {expand(EVENTS['sweep_low'], _CELL)} AS hit, l - 0.5::DOUBLE * avg(tr) OVER ({_W} ROWS 13 PRECEDING) AS stop, lead(o) OVER ({_W}) AS entry FROM x),
g AS (SELECT symbol, timeframe, n, entry, stop, entry + 2.0::DOUBLE * (entry - stop) AS target FROM s WHERE hit AND entry > stop),
j AS (SELECT g.*, b.n - g.n AS k, b.c, CASE WHEN b.l <= g.stop THEN 'STOP' WHEN b.h >= g.target THEN 'TARGET' END AS how
  FROM g JOIN bars b ON b.symbol = g.symbol AND b.timeframe = g.timeframe AND b.n BETWEEN g.n + 1 AND g.n + 48),
e AS (SELECT symbol, timeframe, n, entry, stop, target, min(k) FILTER (how IS NOT NULL) AS k1, arg_min(how, k) FILTER (how IS NOT NULL) AS how, max(k) AS k2, arg_max(c, k) AS c FROM j GROUP BY ALL),
t AS (SELECT symbol, timeframe, n, CAST(coalesce(k1, k2) AS INTEGER) AS held, coalesce(how, 'TIME') AS reason,
  round((CASE how WHEN 'STOP' THEN stop WHEN 'TARGET' THEN target ELSE c END - entry) / (entry - stop) - 0.05::DOUBLE, 6) AS r FROM e)"""
_STEP = f"CASE WHEN r > 0 THEN {round(math.log(0.50 / 0.35), 9):.9f} ELSE {round(math.log(0.50 / 0.65), 9):.9f} END"
_UP, _DOWN = math.log(0.9 / 0.05), math.log(0.1 / 0.95)

ORACLE = {
    "trade_replay": f"WITH {_TRADES} SELECT symbol, timeframe, n, held, reason, r FROM t",
    "trade_metrics": f"""WITH {_TRADES}, a AS (SELECT timeframe, count(*) AS n, count(*) FILTER (r > 0) AS wins, CAST(CAST(sum(CAST(r AS DECIMAL(18,6))) AS VARCHAR) AS DOUBLE) AS total, stddev_samp(r) AS sd,
      CAST(CAST(sum(CAST(r AS DECIMAL(18,6))) FILTER (r > 0) AS VARCHAR) AS DOUBLE) AS up, CAST(CAST(-sum(CAST(r AS DECIMAL(18,6))) FILTER (r < 0) AS VARCHAR) AS DOUBLE) AS down FROM t GROUP BY ALL)
      SELECT timeframe, n, round(wins / CAST(n AS DOUBLE), 6) AS win_rate, round(total / n, 6) AS expectancy, round(sd, 6) AS deviation, round(up / nullif(down, 0), 6) AS profit_factor, round(total / n / nullif(sd, 0), 6) AS mean_to_deviation FROM a""",
    "trade_drawdown": f"""WITH {_TRADES}, q AS (SELECT symbol, timeframe, n, sum(CAST(r AS DECIMAL(18,6))) OVER ({_W}) AS equity FROM t),
      p AS (SELECT *, greatest(max(equity) OVER ({_W}), 0) - equity AS fall FROM q)
      SELECT symbol, timeframe, count(*) AS n, CAST(arg_max(equity, n) AS DOUBLE) AS equity, CAST(max(fall) AS DOUBLE) AS max_drawdown FROM p GROUP BY ALL""",
    "sequential_test": f"""WITH {_TRADES}, q AS (SELECT symbol, timeframe, n, sum(CAST({_STEP} AS DECIMAL(18,9))) OVER ({_W}) AS llr FROM t),
      v AS (SELECT *, CASE WHEN llr >= {_UP} THEN 'ACCEPT' WHEN llr <= {_DOWN} THEN 'REJECT' END AS v FROM q)
      SELECT symbol, timeframe, count(*) AS trades, coalesce(min(n) FILTER (v IS NOT NULL), -1) AS decided_at, coalesce(arg_min(v, n) FILTER (v IS NOT NULL), 'CONTINUE') AS verdict, round(CAST(arg_max(llr, n) AS DOUBLE), 6) AS llr FROM v GROUP BY ALL""",
    "obv": f"""WITH {_BARS}, f AS (SELECT symbol, timeframe, open_ms, n, CAST(CAST(coalesce(sign(c - lag(c) OVER ({_W})) * v, 0) AS VARCHAR) AS DECIMAL(28,8)) AS flow FROM bars)
      SELECT symbol, timeframe, open_ms, round(CAST(CAST(sum(flow) OVER ({_W}) AS VARCHAR) AS DOUBLE), 3) AS obv FROM f""",
    "chain_check": """WITH d AS (SELECT payload_hash, min(created_at) AS at_, min(nullif(parent_hash, '')) AS parent, min(kind) AS kind FROM ops_recovery_log WHERE payload_hash <> '' GROUP BY ALL)
      SELECT d.kind, CASE WHEN d.parent IS NULL THEN 'ROOT' WHEN p.payload_hash IS NULL THEN 'BROKEN' WHEN p.at_ <= d.at_ THEN 'LINKED' ELSE 'FORWARD' END AS link, count(*) AS n
      FROM d LEFT JOIN d p ON p.payload_hash = d.parent GROUP BY ALL""",
}
