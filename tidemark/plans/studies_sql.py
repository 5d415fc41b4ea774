"""SQL of the studies for DuckDB."""

from __future__ import annotations

from tidemark.plans.bars_sql import _BARS
from tidemark.plans.research_sql import _DOWN, _STEP, _TRADES, _UP, _W

# the walk: the first signal of a cell, then each first one after the exit before
_SINGLE = f"""{_TRADES},
walk AS (SELECT symbol, timeframe, min(n) AS n FROM t GROUP BY ALL
  UNION ALL SELECT w.symbol, w.timeframe, (SELECT min(x.n) FROM t x WHERE x.symbol = w.symbol AND x.timeframe = w.timeframe AND x.n > y.n + y.held)
  FROM walk w JOIN t y ON y.symbol = w.symbol AND y.timeframe = w.timeframe AND y.n = w.n WHERE EXISTS (SELECT 1 FROM t x WHERE x.symbol = w.symbol AND x.timeframe = w.timeframe AND x.n > y.n + y.held)),
single AS (SELECT t.* FROM t JOIN walk USING (symbol, timeframe, n)),
timed AS (SELECT s.symbol, s.timeframe, s.n, CAST(s.r AS DECIMAL(18,6)) AS r, row_number() OVER (PARTITION BY s.timeframe ORDER BY b.open_ms, s.symbol) AS number, count(*) OVER (PARTITION BY s.timeframe) AS size
  FROM single s JOIN bars b ON b.symbol = s.symbol AND b.timeframe = s.timeframe AND b.n = s.n)"""
_D = "CAST(CAST({} AS VARCHAR) AS DOUBLE)".format
WALK = f"""WITH RECURSIVE {_SINGLE}, seg AS (SELECT timeframe, CASE WHEN number <= floor(size * 0.7::DOUBLE) THEN 'TRAIN' ELSE 'TEST' END AS part, count(*) AS trades, {_D('sum(r)')} AS total, stddev_samp(CAST(r AS DOUBLE)) AS sd,
  {_D('sum(r) FILTER (r > 0)')} AS up, {_D('-sum(r) FILTER (r < 0)')} AS down FROM timed WHERE size >= 10 GROUP BY ALL),
rated AS (SELECT *, total / trades / nullif(sd, 0) * sqrt(trades) AS ratio, up / nullif(down, 0) AS pf FROM seg)
SELECT timeframe, part, trades, round(total / trades, 6) AS mean, round(pf, 6) AS profit_factor, round(ratio, 6) AS ratio, part = 'TEST' AND coalesce(ratio > 1, FALSE) AND coalesce(pf > 1.2, FALSE) AS is_promoted FROM rated"""
STRESS = f"""WITH RECURSIVE {_SINGLE}, st AS (SELECT timeframe, 'CRASH' AS scenario, CAST(-0.5 + 5 * r AS DECIMAL(20,7)) AS x FROM timed UNION ALL SELECT timeframe, 'VOLATILITY', 5 * r FROM timed UNION ALL SELECT timeframe, 'VOLUME', 0.1 * r FROM timed
  UNION ALL SELECT timeframe, 'CORRELATION', 3 * r FROM timed UNION ALL SELECT timeframe, 'FILLS', r - 0.01 - 0.5 * abs(r) FROM timed UNION ALL SELECT timeframe, 'TAIL', least(r, -abs(r) - 0.5) FROM timed)
SELECT timeframe, scenario, count(*) AS trades, round({_D('sum(x)')}, 6) AS total, round({_D('sum(x)')} / count(*), 6) AS mean, {_D('min(x)')} AS worst FROM st GROUP BY ALL"""
BENCHMARK = f"""WITH {_BARS} SELECT symbol, timeframe, round(arg_max(c, open_ms) / nullif(arg_min(o, open_ms), 0) - 1, 8) AS held_return, round(max(h) / nullif(min(l), 0) - 1, 8) AS span FROM bars GROUP BY ALL"""
RATES = f"""WITH RECURSIVE {_SINGLE}, c AS (SELECT symbol, timeframe, count(*) AS n, CAST(count(*) FILTER (r > 0) AS DOUBLE) AS wins FROM timed GROUP BY ALL),
p AS (SELECT *, sum(n) OVER w AS pn, sum(wins) OVER w / sum(n) OVER w AS pr FROM c WINDOW w AS (PARTITION BY timeframe)),
l AS (SELECT *, (pr + 3.8416::DOUBLE / (2 * pn) - 1.96::DOUBLE * sqrt(pr * (1 - pr) / pn + 3.8416::DOUBLE / (4.0::DOUBLE * pn * pn))) / (1 + 3.8416::DOUBLE / pn) AS low FROM p)
SELECT symbol, timeframe, n, round(wins / n, 6) AS rate, round(n / (n + 30.0::DOUBLE) * wins / n + (1 - n / (n + 30.0::DOUBLE)) * pr, 6) AS shrunken, round(low, 6) AS pool_lower, pn >= 30 AND low > 1.0::DOUBLE / 3 AS is_eligible FROM l"""
SINGLE = f"WITH RECURSIVE {_SINGLE} SELECT symbol, timeframe, n, held, reason, r FROM single"
PBO = f"""WITH RECURSIVE {_SINGLE}, folded AS (SELECT timeframe, symbol, CAST(floor((number - 1) * 8 / CAST(size AS DOUBLE)) AS INTEGER) AS fold, r FROM timed),
sums AS (SELECT timeframe, fold, symbol, sum(r) AS s FROM folded GROUP BY ALL), best AS (SELECT * FROM sums QUALIFY row_number() OVER (PARTITION BY timeframe, fold ORDER BY s DESC, symbol DESC) = 1),
others AS (SELECT b.timeframe, b.fold, x.fold AS seen, x.s AS got FROM best b JOIN sums x ON x.timeframe = b.timeframe AND x.symbol = b.symbol AND x.fold <> b.fold),
ranked AS (SELECT o.timeframe, o.fold, o.seen, count(*) FILTER (g.s <= o.got) / CAST(count(*) AS DOUBLE) AS rank FROM others o JOIN sums g ON g.timeframe = o.timeframe AND g.fold = o.seen GROUP BY ALL)
SELECT timeframe, count(*) AS pairs, round(avg(CASE WHEN rank <= 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS pbo, round(avg(rank), 6) AS mean_rank FROM ranked GROUP BY ALL"""

SINGLE_METRICS = f"""WITH RECURSIVE {_SINGLE}, m AS (SELECT timeframe, count(*) AS n, count(*) FILTER (r > 0) AS wins, {_D('sum(r)')} AS total, stddev_samp(CAST(r AS DOUBLE)) AS sd, {_D('sum(r) FILTER (r > 0)')} AS up, {_D('-sum(r) FILTER (r < 0)')} AS down FROM timed GROUP BY ALL)
SELECT timeframe, n, round(wins / CAST(n AS DOUBLE), 6) AS win_rate, round(total / n, 6) AS expectancy, round(sd, 6) AS deviation, round(up / nullif(down, 0), 6) AS profit_factor, round(total / n / nullif(sd, 0), 6) AS mean_to_deviation FROM m"""
SINGLE_DRAWDOWN = f"""WITH RECURSIVE {_SINGLE}, q AS (SELECT symbol, timeframe, n, sum(r) OVER ({_W}) AS equity FROM timed), p AS (SELECT *, greatest(max(equity) OVER ({_W}), 0) - equity AS fall FROM q)
SELECT symbol, timeframe, count(*) AS n, CAST(arg_max(equity, n) AS DOUBLE) AS equity, CAST(max(fall) AS DOUBLE) AS max_drawdown FROM p GROUP BY ALL"""
SINGLE_TEST = f"""WITH RECURSIVE {_SINGLE}, q AS (SELECT symbol, timeframe, n, sum(CAST({_STEP} AS DECIMAL(18,9))) OVER ({_W}) AS llr FROM timed), v AS (SELECT *, CASE WHEN llr >= {_UP} THEN 'ACCEPT' WHEN llr <= {_DOWN} THEN 'REJECT' END AS v FROM q)
SELECT symbol, timeframe, count(*) AS trades, coalesce(min(n) FILTER (v IS NOT NULL), -1) AS decided_at, coalesce(arg_min(v, n) FILTER (v IS NOT NULL), 'CONTINUE') AS verdict, round(CAST(arg_max(llr, n) AS DOUBLE), 6) AS llr FROM v GROUP BY ALL"""

ORACLE = {"single_metrics": SINGLE_METRICS, "single_drawdown": SINGLE_DRAWDOWN, "single_test": SINGLE_TEST, "walk_forward": WALK, "stress": STRESS, "benchmark": BENCHMARK, "shrunken_rates": RATES, "single_replay": SINGLE, "overfitting": PBO}
