"""SQL of the upkeep queries for DuckDB, written from the definitions, not from the operators."""

from __future__ import annotations

_LENGTH = """CASE timeframe WHEN '1m' THEN 60000 WHEN '3m' THEN 180000 WHEN '5m' THEN 300000 WHEN '15m' THEN 900000
  WHEN '30m' THEN 1800000 WHEN '1h' THEN 3600000 WHEN '2h' THEN 7200000 WHEN '4h' THEN 14400000
  WHEN '6h' THEN 21600000 WHEN '8h' THEN 28800000 WHEN '12h' THEN 43200000 WHEN '1d' THEN 86400000
  WHEN '1w' THEN 604800000 WHEN '1mo' THEN 2592000000 END"""


def _ms(c: str) -> str:
    return f"CASE WHEN regexp_full_match({c}, '-?[0-9]+') THEN CAST({c} AS BIGINT) ELSE epoch_ms(CAST({c} AS TIMESTAMPTZ)) END"


def _slot(at: str) -> str:
    """Start of the slot that contains ``at``."""
    return f"""CASE timeframe WHEN '1mo' THEN epoch_ms(date_trunc('month', make_timestamp(({at}) * 1000)))
  WHEN '1w' THEN epoch_ms(date_trunc('week', make_timestamp(({at}) * 1000)))
  ELSE CAST(floor(({at})::DOUBLE / ({_LENGTH})) AS BIGINT) * ({_LENGTH}) END"""


def _next(slot: str) -> str:
    return f"CASE timeframe WHEN '1mo' THEN epoch_ms(make_timestamp(({slot}) * 1000) + INTERVAL 1 MONTH) ELSE ({slot}) + ({_LENGTH}) END"


_NUM = "CAST({0} AS DOUBLE) AS {0}".format


def _obs(status: str, extra: str = "") -> str:
    return f"""parsed AS (SELECT observation_id, symbol, timeframe, {_ms('open_time')} AS open_ms, {_ms('close_time')} AS close_ms,
    {_ms('retrieved_at')} AS retrieved_ms, candle_status, {', '.join(_NUM(c) for c in ('open_price', 'high_price', 'low_price', 'close_price', 'volume'))}
  FROM market_observation WHERE {status} {extra}),
obs AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY retrieved_ms NULLS LAST) = 1),
slotted AS (SELECT *, {_slot('coalesce(open_ms, close_ms - 1)')} AS slot FROM obs)"""


_READ = "candle_status IN ('CLOSED', 'CORRECTED')"

P1_FOUND = f"""WITH RECURSIVE {_obs(_READ)},
span AS (SELECT symbol, timeframe, min(slot) AS slot, max(slot) AS last FROM slotted GROUP BY ALL),
grid AS (SELECT * FROM span UNION ALL
  SELECT symbol, timeframe, nxt, last FROM (SELECT *, {_next('slot')} AS nxt FROM grid) WHERE nxt <= last)
SELECT symbol, timeframe, slot AS open_ms FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM slotted s WHERE s.symbol = g.symbol AND s.timeframe = g.timeframe AND s.slot = g.slot)"""

P1_GRID = f"""WITH RECURSIVE {_obs(_READ)},
one AS (SELECT symbol, timeframe, slot, volume, open_ms FROM slotted
  QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, slot ORDER BY retrieved_ms DESC NULLS FIRST) = 1),
span AS (SELECT symbol, timeframe, min(slot) AS slot, max(slot) AS last FROM one GROUP BY ALL),
grid AS (SELECT * FROM span UNION ALL
  SELECT symbol, timeframe, nxt, last FROM (SELECT *, {_next('slot')} AS nxt FROM grid) WHERE nxt <= last)
SELECT symbol, timeframe, slot AS open_ms, CASE WHEN o.slot IS NOT NULL THEN round(greatest(coalesce(o.volume, 0), 0), 3) END AS volume,
  CASE WHEN o.slot IS NULL THEN 0.0::DOUBLE ELSE round(1 - floor(coalesce((o.open_ms - slot) / CAST(({_next('slot')}) - slot AS DOUBLE), 0) * 1048576) / 1048576.0::DOUBLE, 6) END AS coverage,
  CASE WHEN o.slot IS NULL THEN 'lacking' ELSE 'measured' END AS status
FROM grid LEFT JOIN one o USING (symbol, timeframe, slot)"""

_LINKS = """raw AS (
  SELECT 'apex_risk_ladder_state' AS tbl, revision_id AS node_id, nullif(parent_revision_id, '') AS parent_id FROM apex_risk_ladder_state
  UNION ALL SELECT 'ops_recovery_log', payload_hash, nullif(parent_hash, '') FROM ops_recovery_log),
nodes AS (SELECT tbl, node_id, min(parent_id) AS parent_id FROM raw WHERE node_id <> '' GROUP BY ALL),
links AS (SELECT n.tbl, n.node_id, p.node_id AS parent_id FROM nodes n LEFT JOIN nodes p ON p.tbl = n.tbl AND p.node_id = n.parent_id),
down AS (SELECT tbl, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM links WHERE parent_id IS NULL
  UNION ALL SELECT l.tbl, l.node_id, d.root_id, d.depth + 1, d.path || '/' || l.node_id FROM down d JOIN links l ON l.tbl = d.tbl AND l.parent_id = d.node_id),
lost AS (SELECT tbl, node_id, parent_id FROM links l WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.tbl = l.tbl AND d.node_id = l.node_id)),
walk AS (SELECT tbl, node_id, parent_id AS cur FROM lost UNION SELECT w.tbl, w.node_id, l.parent_id FROM walk w JOIN lost l ON l.tbl = w.tbl AND l.node_id = w.cur),
onloop AS (SELECT tbl, node_id FROM walk WHERE cur = node_id),
looped AS (SELECT w.tbl, w.node_id, min(w.cur) AS root_id FROM walk w JOIN onloop o ON o.tbl = w.tbl AND o.node_id = w.cur GROUP BY ALL)"""

P2_FOUND = f"""WITH RECURSIVE {_LINKS}
SELECT tbl, node_id, root_id, depth FROM down UNION ALL SELECT tbl, node_id, root_id, -1 FROM looped"""
P2_PATHS = f"WITH RECURSIVE {_LINKS} SELECT tbl, node_id, root_id, depth, path FROM down"
P2_LOOPS = f"WITH RECURSIVE {_LINKS} SELECT tbl, root_id AS loop_id, count(*) AS n_nodes FROM looped GROUP BY ALL"
P2_DESCENDANTS = f"""WITH RECURSIVE {_LINKS},
free AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM onloop o WHERE o.tbl = l.tbl AND o.node_id = l.node_id)),
anc AS (SELECT l.tbl, l.node_id, p.node_id AS ancestor, 1 AS dist FROM free l JOIN free p ON p.tbl = l.tbl AND p.node_id = l.parent_id
  UNION ALL SELECT a.tbl, a.node_id, p.node_id, a.dist + 1 FROM anc a JOIN free l ON l.tbl = a.tbl AND l.node_id = a.ancestor JOIN free p ON p.tbl = l.tbl AND p.node_id = l.parent_id),
cnt AS (SELECT tbl, ancestor AS node_id, count(*) AS n, max(dist) AS h FROM anc GROUP BY ALL),
rings AS (SELECT tbl, root_id, count(*) - 1 AS n FROM looped GROUP BY ALL)
SELECT l.tbl, l.node_id, coalesce(c.n, 0) AS n_descendants, CAST(coalesce(c.h, 0) AS INTEGER) AS height FROM free l LEFT JOIN cnt c ON c.tbl = l.tbl AND c.node_id = l.node_id
UNION ALL SELECT o.tbl, o.node_id, r.n, -1 FROM (SELECT DISTINCT * FROM onloop) o JOIN looped x ON x.tbl = o.tbl AND x.node_id = o.node_id JOIN rings r ON r.tbl = o.tbl AND r.root_id = x.root_id"""
P2_PAIRS = f"""WITH RECURSIVE {_LINKS},
anc AS (SELECT tbl, node_id, parent_id AS ancestor, 1 AS dist FROM links WHERE parent_id IS NOT NULL
  UNION ALL SELECT a.tbl, a.node_id, l.parent_id, a.dist + 1 FROM anc a JOIN links l ON l.tbl = a.tbl AND l.node_id = a.ancestor
    WHERE l.parent_id IS NOT NULL AND a.dist <= (SELECT count(*) FROM lost) + (SELECT max(depth) FROM down))
SELECT tbl, ancestor AS ancestor_id, node_id AS descendant_id, min(dist) AS distance FROM anc WHERE ancestor <> node_id GROUP BY ALL"""


def _p3() -> str:
    cols = []
    for w in (7, 30):
        cols.append(f"CAST(sum(readings) OVER w{w} AS BIGINT) AS readings_{w}")
        for c in ("close_price", "volume", "high_price"):
            total = f"CAST(CAST(sum({c}) OVER w{w} AS VARCHAR) AS DOUBLE)"  # by way of text: rounded correctly
            cols.append(f"coalesce({total}, 0) AS {c}_sum_{w}")
            cols.append(f"CASE WHEN sum(n_{c}) OVER w{w} > 0 THEN {total} / CAST(sum(n_{c}) OVER w{w} AS BIGINT) END AS {c}_avg_{w}")
    sums = ", ".join(f"sum(CAST(CAST({c} AS VARCHAR) AS DECIMAL(28,8))) AS {c}, count({c}) AS n_{c}" for c in ("close_price", "volume", "high_price"))
    return f"""WITH {_obs(_READ)},
cells AS (SELECT * FROM slotted UNION ALL SELECT * REPLACE ('all' AS timeframe) FROM slotted),
daily AS (SELECT symbol, timeframe, CAST(make_timestamp(slot * 1000) AS DATE) AS day, count(*) AS readings, {sums} FROM cells GROUP BY ALL),
span AS (SELECT symbol, timeframe, min(day) AS lo, max(day) AS hi FROM daily GROUP BY ALL),
days AS (SELECT symbol, timeframe, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM span),
dense AS (SELECT symbol, timeframe, day, coalesce(readings, 0) AS readings, close_price, volume, high_price, coalesce(n_close_price, 0) AS n_close_price,
  coalesce(n_volume, 0) AS n_volume, coalesce(n_high_price, 0) AS n_high_price FROM days LEFT JOIN daily USING (symbol, timeframe, day))
SELECT symbol, timeframe, day, {', '.join(cols)} FROM dense
WINDOW w7 AS (PARTITION BY symbol, timeframe ORDER BY day ROWS 6 PRECEDING), w30 AS (PARTITION BY symbol, timeframe ORDER BY day ROWS 29 PRECEDING)"""


_REFS = """refs AS (
  SELECT 'quality_vector' AS child_table, quality_id AS child_id, observation_id AS ref_key, 'undated' AS period FROM quality_vector
    WHERE observation_id <> '' AND observation_id NOT IN (SELECT observation_id FROM market_observation WHERE observation_id IS NOT NULL)
  UNION ALL SELECT 'evidence_event', evidence_id, snapshot_id, coalesce(strftime(date_trunc('week', timestamp_utc AT TIME ZONE 'UTC'), '%Y-%m-%d'), 'undated') FROM evidence_event
    WHERE snapshot_id <> '' AND snapshot_id NOT IN (SELECT snapshot_id FROM snapshot_pit WHERE snapshot_id IS NOT NULL)
  UNION ALL SELECT 'trade_plan', proposal_id, setup_id, coalesce(strftime(date_trunc('week', created_utc AT TIME ZONE 'UTC'), '%Y-%m-%d'), 'undated') FROM trade_plan
    WHERE setup_id <> '' AND setup_id NOT IN (SELECT setup_id FROM setup_candidate WHERE setup_id IS NOT NULL)
  UNION ALL SELECT 'cell_decision_cursor', cell_id, proposal_id, coalesce(strftime(date_trunc('week', decided_at AT TIME ZONE 'UTC'), '%Y-%m-%d'), 'undated') FROM cell_decision_cursor
    WHERE proposal_id <> '' AND proposal_id NOT IN (SELECT proposal_id FROM trade_plan WHERE proposal_id IS NOT NULL))"""
P4_FOUND = f"WITH {_REFS} SELECT DISTINCT child_table, child_id, ref_key FROM refs"
P4_REPORT = f"WITH {_REFS} SELECT child_table, period, count(DISTINCT ref_key) AS keys, count(*) AS refs FROM refs GROUP BY ALL"

P5_FOUND = f"""WITH {_obs(_READ)},
r AS (SELECT *, coalesce(retrieved_ms, 4611686018427387904) AS arr FROM slotted),
q AS (SELECT DISTINCT quality_id, observation_id, q_ohlc FROM quality_vector WHERE q_ohlc IS NOT NULL AND NOT isnan(q_ohlc)),
v AS (
  SELECT observation_id AS record_id, symbol, timeframe, slot, arr, 'high_price' AS field, high_price AS value, high_price / nullif(greatest(open_price, close_price), 0) - 1 AS ratio,
    (high_price <= 0 OR high_price < low_price) AS bad FROM r WHERE high_price IS NOT NULL
  UNION ALL SELECT observation_id, symbol, timeframe, slot, arr, 'low_price', low_price, 1 - low_price / nullif(least(open_price, close_price), 0),
    (low_price <= 0 OR high_price < low_price) FROM r WHERE low_price IS NOT NULL
  UNION ALL SELECT observation_id, symbol, timeframe, slot, arr, 'volume', volume, NULL, volume < 0 FROM r WHERE volume IS NOT NULL
  UNION ALL SELECT quality_id, symbol, timeframe, slot, arr, 'q_ohlc', q_ohlc, q_ohlc, (q_ohlc < 0 OR q_ohlc > 1) FROM q JOIN r USING (observation_id)),
m AS (SELECT *, count(*) OVER c AS n, median(ratio) OVER c AS mid, median(value) OVER (o ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS near,
    row_number() OVER o AS rn, row_number() OVER (PARTITION BY symbol, timeframe, field, value ORDER BY slot, arr, record_id) AS rv
  FROM v WINDOW c AS (PARTITION BY symbol, timeframe, field), o AS (PARTITION BY symbol, timeframe, field ORDER BY slot, arr, record_id)),
k AS (SELECT *, count(*) OVER (PARTITION BY symbol, timeframe, field, value, rn - rv) AS run FROM m)
SELECT DISTINCT record_id, field FROM k
WHERE bad OR run >= 8 OR (n >= 12 AND CASE field WHEN 'volume' THEN value > 20 * near OR value < 0.01 * near
  WHEN 'q_ohlc' THEN abs(value - mid) > 0.1 ELSE ratio > 20 * mid END)"""

# quartiles are discrete; the sketches of the query are exact while a cell has under some 2,000 values, as at sf0.01
P5_FENCES = f"""WITH {_obs(_READ)},
r AS (SELECT *, coalesce(retrieved_ms, 4611686018427387904) AS arr FROM slotted),
q AS (SELECT quality_id, observation_id, min(q_ohlc) AS q_ohlc FROM quality_vector WHERE quality_id IS NOT NULL AND q_ohlc IS NOT NULL AND NOT isnan(q_ohlc) GROUP BY ALL),
v AS (SELECT observation_id AS record_id, symbol, timeframe, slot, arr, 'high_price' AS field, high_price / nullif(greatest(open_price, close_price), 0) - 1 AS value FROM r WHERE open_price IS NOT NULL AND close_price IS NOT NULL
  UNION ALL SELECT observation_id, symbol, timeframe, slot, arr, 'low_price', 1 - low_price / nullif(least(open_price, close_price), 0) FROM r WHERE open_price IS NOT NULL AND close_price IS NOT NULL
  UNION ALL SELECT observation_id, symbol, timeframe, slot, arr, 'volume', volume FROM r
  UNION ALL SELECT quality_id, symbol, timeframe, slot, arr, 'q_ohlc', q_ohlc FROM q JOIN r USING (observation_id)),
k AS (SELECT *, CAST((slot // 3600000) % 24 AS INTEGER) AS context, abs(value - lag(value) OVER (PARTITION BY symbol, timeframe, field ORDER BY slot, arr, record_id)) AS change FROM v WHERE value IS NOT NULL),
w AS (SELECT symbol, timeframe, field, quantile_disc(value, 0.25) AS w1, quantile_disc(value, 0.75) AS w3, quantile_disc(change, 0.75) AS normal FROM k GROUP BY ALL),
c AS (SELECT symbol, timeframe, field, context, count(*) AS m, quantile_disc(value, 0.25) AS c1, quantile_disc(value, 0.75) AS c3 FROM k GROUP BY ALL),
f AS (SELECT k.*, normal, CASE WHEN m >= 30 THEN c1 ELSE w1 END AS q1, CASE WHEN m >= 30 THEN c3 ELSE w3 END AS q3 FROM k JOIN w USING (symbol, timeframe, field) JOIN c USING (symbol, timeframe, field, context)),
g AS (SELECT record_id, field, context, value < q1 - (q3 - q1) * 6 OR value > q3 + (q3 - q1) * 6 AS is_outside, coalesce(change > 4 * normal, FALSE) AS is_jump, q1 = q3 AND value = q1 AS is_flat FROM f)
SELECT * FROM g WHERE is_outside OR is_jump OR is_flat"""

_ARRIVALS = f"""{_obs('TRUE', 'AND close_time IS NOT NULL AND retrieved_at IS NOT NULL')},
boot AS (SELECT cell_id, timeframe, cursor_ms, min(epoch_ms(updated_at)) AS arrival FROM research_bootstrap_progress
  WHERE cell_id IS NOT NULL AND cursor_ms IS NOT NULL AND updated_at IS NOT NULL GROUP BY ALL),
rec AS (SELECT 'market_observation' AS rec_table, symbol || ':' || timeframe AS cell_id, observation_id AS rec_id, close_ms AS event, retrieved_ms AS arrival, 12 * ({_LENGTH}) AS allowed, volume FROM obs
  UNION ALL SELECT 'research_bootstrap_progress', cell_id, cell_id || '#' || cursor_ms, cursor_ms, arrival, 12 * ({_LENGTH}), NULL FROM boot),
seen AS (SELECT *, max(event) OVER (PARTITION BY rec_table, cell_id ORDER BY arrival RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier FROM rec)"""
P6_FOUND = f"WITH {_ARRIVALS} SELECT rec_table, rec_id FROM seen WHERE frontier - event > allowed"
P6_DAYS = f"""WITH {_ARRIVALS},
late AS (SELECT *, coalesce(frontier - event > allowed, FALSE) AS is_late, CAST(make_timestamp(event * 1000) AS DATE) AS day FROM seen WHERE rec_table = 'market_observation'),
per AS (SELECT cell_id, day, count(*) FILTER (NOT is_late) AS n, CAST(sum(CAST(CAST(volume AS VARCHAR) AS DECIMAL(28,8))) FILTER (NOT is_late) AS DOUBLE) AS volume,
  count(*) FILTER (is_late) AS n_late, max(event) AS last, max(allowed) AS allowed FROM late GROUP BY ALL)
SELECT cell_id, day, n, round(volume, 3) AS volume, n_late,
  CASE WHEN max(last) OVER (PARTITION BY cell_id) - epoch_ms(CAST(day + 1 AS TIMESTAMP)) > allowed THEN 'frozen' ELSE 'provisional' END AS state FROM per"""

P7_FOUND = f"""WITH {_obs("candle_status IN ('CLOSED', 'CORRECTED', 'SUPERSEDED')")},
known AS (SELECT * FROM obs WHERE close_ms IS NOT NULL AND retrieved_ms IS NOT NULL),
snap AS (SELECT snapshot_id, min(as_of) AS as_of FROM snapshot_pit GROUP BY ALL),
ev AS (SELECT evidence_id, symbol, timeframe, min(epoch_ms(least(timestamp_utc, as_of))) AS k FROM evidence_event LEFT JOIN snap USING (snapshot_id) GROUP BY ALL)
SELECT evidence_id, observation_id FROM ev JOIN known USING (symbol, timeframe) WHERE close_ms <= k AND retrieved_ms <= k
QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY close_ms DESC, retrieved_ms DESC, observation_id DESC) = 1"""

ORACLE = {
    "p1_found": P1_FOUND, "p1_grid": P1_GRID, "p2_found": P2_FOUND, "p2_paths": P2_PATHS, "p2_descendants": P2_DESCENDANTS, "p2_loops": P2_LOOPS, "p2_pairs": P2_PAIRS,
    "p3_rolling": _p3(), "p4_found": P4_FOUND, "p4_report": P4_REPORT, "p5_found": P5_FOUND, "p5_fences": P5_FENCES, "p6_found": P6_FOUND, "p6_days": P6_DAYS, "p7_found": P7_FOUND,
}
