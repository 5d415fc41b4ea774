"""SQL of the simpler queries beside the phases, for DuckDB."""

from __future__ import annotations

from tidemark.plans.bars_sql import _BARS, _CELL, _obs
from tidemark.plans.upkeep_sql import _LENGTH, _READ, _slot

_W = f"PARTITION BY {_CELL} ORDER BY n"
RUNS = f"""WITH {_BARS}, s AS (SELECT *, CASE WHEN timeframe = '1mo' THEN date_diff('month', make_timestamp(lag(open_ms) OVER ({_W}) * 1000), make_timestamp(open_ms * 1000)) <> 1 ELSE open_ms - lag(open_ms) OVER ({_W}) <> len_ms END AS cut FROM bars),
g AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER ({_W}) AS run FROM s)
SELECT symbol, timeframe, min(open_ms) AS first_ms, max(open_ms) AS last_ms, count(*) AS bars FROM g GROUP BY symbol, timeframe, run"""
AS_OF = f"""WITH {_obs(_READ)}, s AS (SELECT max(epoch_ms(as_of)) AS as_of FROM snapshot_pit),
k AS (SELECT *, {_slot('coalesce(t_open, t_close - 1)')} AS slot FROM once, s WHERE t_close <= as_of AND t_got <= as_of AND c IS NOT NULL),
o AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {_CELL}, slot ORDER BY t_got DESC, observation_id DESC) = 1)
SELECT symbol, timeframe, t_close AS close_ms, row_number() OVER w - 1 AS age, c FROM o WINDOW w AS (PARTITION BY {_CELL} ORDER BY slot DESC) QUALIFY row_number() OVER w <= 50"""
CALIBRATION = f"""WITH {_BARS}, u AS (SELECT *, CAST(c > lag(c) OVER ({_W}) AS INTEGER) AS up FROM bars),
p AS (SELECT *, sum(up) OVER ({_W} ROWS 49 PRECEDING) + 1 AS k, lead(up) OVER ({_W}) AS y FROM u), f AS (SELECT timeframe, CAST(k AS INTEGER) AS k, k / 52.0::DOUBLE AS p, y FROM p WHERE n > 50 AND y IS NOT NULL)
SELECT timeframe, CAST(k * 10 // 52 AS INTEGER) AS bin, count(*) AS bars, round(avg(p), 6) AS forecast, round(avg(y), 6) AS reached, round(avg((p - y) ** 2), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss FROM f GROUP BY ALL"""
CONFLICT = f"""WITH e AS (SELECT evidence_id, snapshot_id, timeframe, min(timestamp_utc) AS at_, max(confidence) AS confidence, min(engine_id) AS engine_id FROM evidence_event WHERE snapshot_id <> '' AND evidence_id IS NOT NULL GROUP BY ALL),
s AS (SELECT snapshot_id, min(as_of) AS as_of FROM snapshot_pit WHERE as_of IS NOT NULL GROUP BY ALL),
j AS (SELECT *, (epoch_ms(as_of) - epoch_ms(at_)) / CAST(({_LENGTH}) AS DOUBLE) >= 5 AS stale FROM e JOIN s USING (snapshot_id))
SELECT snapshot_id, count(*) AS events, count(DISTINCT engine_id) AS engines, round(max(confidence) - min(confidence), 6) AS quality_gap, round(avg(CAST(stale AS INTEGER)), 6) AS stale_share FROM j GROUP BY ALL"""
VETOES = """WITH d AS (SELECT proposal_id, min(struct_pack(d := decision, v := vetoes_applied)) AS x FROM trade_plan WHERE proposal_id IS NOT NULL GROUP BY ALL),
u AS (SELECT x.d AS decision, unnest(from_json(x.v, '["VARCHAR"]')) AS veto FROM d) SELECT decision, veto, count(*) AS plans FROM u GROUP BY ALL"""
CONTRACT = f"""WITH {_BARS}, t AS (SELECT *, lag(c) OVER ({_W}) AS pc FROM bars), r AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, greatest(abs(h - pc), abs(l - pc))) END AS tr FROM t),
a AS (SELECT *, list(tr) OVER ({_W} ROWS 13 PRECEDING) AS x FROM r), g AS (SELECT *, list_sum(x) / 14 AS atr, greatest(1e-10, 1e-9 * list_sum(x) / 14) AS eps FROM a WHERE n > 14)
SELECT symbol, timeframe, open_ms, CASE WHEN h >= l THEN 'VALID' ELSE 'QUARANTINED' END AS state, CASE WHEN h >= l THEN round(abs(c - o) / greatest(h - l, eps), 6) END AS body_ratio,
  CASE WHEN h >= l THEN round((h - greatest(o, c)) / greatest(h - l, eps), 6) END AS upper_wick, CASE WHEN h >= l THEN round((least(o, c) - l) / greatest(h - l, eps), 6) END AS lower_wick,
  CASE WHEN h >= l THEN round((c - l) / greatest(h - l, eps), 4) END AS close_position, CASE WHEN h >= l THEN round((h - l) / greatest(atr, eps), 4) END AS normalized_range FROM g"""

ORACLE = {"contiguous_runs": RUNS, "window_as_of": AS_OF, "calibration": CALIBRATION, "evidence_conflict": CONFLICT, "veto_counts": VETOES, "price_contract": CONTRACT}
