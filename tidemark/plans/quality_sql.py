"""SQL of the quality queries for DuckDB."""

from __future__ import annotations

from tidemark.plans.quality import FRESH_S, OI_LAG_S, PARTS, Q_MIN, WEIGHTS
from tidemark.plans.upkeep_sql import _LENGTH, _READ, _ms, _slot


def _case(values: dict[str, float]) -> str:
    return "CASE timeframe " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " END"


_COLS = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("open_price", "high_price", "low_price", "close_price", "volume", "open_interest"))
_READINGS = f"""parsed AS (SELECT observation_id, symbol, timeframe, {_ms('open_time')} AS t_open, {_ms('close_time')} AS t_close, {_ms('retrieved_at')} AS t_got, {_COLS} FROM market_observation WHERE {{}}),
once AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY t_got NULLS LAST) = 1)"""
_RAW = " + ".join(f"({_case({t: w[i] for t, w in WEIGHTS.items()})}) * q_{k}" for i, k in enumerate(PARTS))
_STEP = "CASE timeframe WHEN '1mo' THEN date_diff('month', make_timestamp(prev * 1000), make_timestamp(slot * 1000)) ELSE (slot - prev) // ({}) END"
STATES = f"""WITH {_READINGS.format(_READ)},
s AS (SELECT *, {_slot('coalesce(t_open, t_close - 1)')} AS slot FROM once),
p AS (SELECT *, max(slot) OVER (PARTITION BY symbol, timeframe ORDER BY slot RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, (t_got - t_close) / 1000.0::DOUBLE AS delay FROM s),
k AS (SELECT *, {_STEP.format(_LENGTH)} AS step, {_case(FRESH_S)} AS lim, {_case(OI_LAG_S)} AS oil,
  coalesce(high_price >= open_price AND high_price >= close_price AND low_price <= open_price AND low_price <= close_price AND high_price >= low_price, FALSE) AS fits,
  open_price IS NULL OR high_price IS NULL OR low_price IS NULL OR close_price IS NULL AS gone FROM p),
o AS (SELECT *, CASE WHEN open_interest IS NULL THEN 'MISSING' WHEN open_interest < 0 THEN 'INVALID' WHEN delay IS NULL THEN 'MISSING' WHEN delay <= oil THEN 'AVAILABLE' WHEN delay <= 5 * oil THEN 'STALE' ELSE 'DEGRADED' END AS oi_state FROM k),
q AS (SELECT *, CASE WHEN gone THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS q_schema, 1 - CASE WHEN delay IS NULL THEN NULL WHEN delay < 0 THEN 0 WHEN delay > lim THEN 1 ELSE delay / lim END AS q_time, coalesce(1.0::DOUBLE / step, 1.0) AS q_seq,
  CASE WHEN fits THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q_ohlc, CASE WHEN volume > 0 THEN 1.0::DOUBLE WHEN volume = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS q_volume,
  CASE oi_state WHEN 'AVAILABLE' THEN 1.0::DOUBLE WHEN 'STALE' THEN 0.5::DOUBLE WHEN 'DEGRADED' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS q_oi, 1.0::DOUBLE AS q_source FROM o),
r AS (SELECT *, {_RAW} AS q_raw FROM q)
SELECT observation_id, symbol, timeframe, oi_state, {', '.join(f'round(q_{k} + 1e-9, 6) AS q_{k}' for k in PARTS)}, round(q_raw + 1e-9, 6) AS q_raw,
  CASE WHEN gone THEN 'SCHEMA' WHEN delay IS NULL THEN 'TIMESTAMP' WHEN NOT fits THEN 'OHLC' WHEN volume < 0 THEN 'VOLUME_NEGATIVE' WHEN delay > lim THEN 'FRESHNESS' WHEN oi_state = 'DEGRADED' THEN 'OI_LAG'
    WHEN step > 1 THEN 'COMPLETENESS' WHEN q_raw < {_case(Q_MIN)} THEN 'Q_MIN' ELSE 'VALID' END AS state FROM r"""


def _number(c: str) -> str:
    return f"regexp_replace(regexp_replace(CAST(CAST(CAST({c} AS VARCHAR) AS DECIMAL(28,8)) AS VARCHAR), '0+$', ''), '\\.$', '')"


DUPLICATES = f"""WITH {_READINGS.format('TRUE')},
h AS (SELECT observation_id, symbol, timeframe, sha256('{{"close":"' || {_number('close_price')} || '","open":"' || {_number('open_price')} || '","symbol":"' || symbol || '","timeframe":"' || timeframe || '","timestamp":"'
  || strftime(make_timestamp(t_close * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(t_close % 1000 AS VARCHAR), 3, '0') || 'Z","volume":"' || {_number('volume')} || '"}}') AS content_hash FROM once)
SELECT symbol, timeframe, content_hash, count(*) AS ids, min(observation_id) AS first_id FROM h WHERE content_hash IS NOT NULL GROUP BY ALL HAVING count(*) > 1"""


def _months(table: str, at: str, keep: int) -> str:
    return f"""SELECT '{table}' AS table_name, month, n, date_diff('month', month, max(month) OVER ()) > {keep} AS is_past
  FROM (SELECT CAST(date_trunc('month', {at}) AS DATE) AS month, count(*) AS n FROM {table} WHERE {at} IS NOT NULL GROUP BY ALL)"""


RETENTION = " UNION ALL ".join((
    _months("market_observation", f"make_timestamp(CASE WHEN close_time IS NOT NULL THEN {_ms('close_time')} ELSE {_ms('open_time')} END * 1000)", 12),
    _months("snapshot_pit", "as_of AT TIME ZONE 'UTC'", 6), _months("evidence_event", "timestamp_utc AT TIME ZONE 'UTC'", 6),
))
RECONCILE = f"""WITH {_READINGS.format(_READ)},
b AS (SELECT cell_id, max(cursor_ms) AS cursor_ms FROM research_bootstrap_progress WHERE cell_id <> '' AND cursor_ms IS NOT NULL GROUP BY ALL),
m AS (SELECT symbol || ':' || timeframe AS cell_id, max(t_close) AS close_ms FROM once GROUP BY ALL)
SELECT coalesce(b.cell_id, m.cell_id) AS cell_id, cursor_ms, close_ms, cursor_ms - close_ms AS delta_ms,
  CASE WHEN close_ms IS NULL THEN 'NO_BARS' WHEN cursor_ms IS NULL THEN 'NO_CURSOR' WHEN cursor_ms = close_ms THEN 'MATCH' WHEN cursor_ms < close_ms THEN 'BEHIND' ELSE 'AHEAD' END AS state
FROM b FULL JOIN m ON b.cell_id = m.cell_id"""
FRESHNESS = f"""WITH e AS (SELECT evidence_id, timeframe, snapshot_id, min(timestamp_utc) AS at_ FROM evidence_event WHERE evidence_id IS NOT NULL GROUP BY ALL),
s AS (SELECT snapshot_id, min(as_of) AS as_of FROM snapshot_pit WHERE snapshot_id <> '' GROUP BY ALL),
a AS (SELECT evidence_id, timeframe, (epoch_ms(as_of) - epoch_ms(at_)) / CAST(({_LENGTH}) AS DOUBLE) AS age FROM e LEFT JOIN s USING (snapshot_id))
SELECT evidence_id, timeframe, round(age, 6) AS age_bars, CASE WHEN age >= 0 THEN round(exp(-0.1::DOUBLE * age), 6) END AS freshness,
  CASE WHEN age IS NULL THEN 'UNKNOWN' WHEN age < 0 THEN 'FUTURE' WHEN age >= 5 THEN 'EXPIRED' ELSE 'ACTIVE' END AS state FROM a"""
NEAREST = """WITH l AS (SELECT DISTINCT symbol, CAST(price_level AS DOUBLE) AS level FROM evidence_event WHERE CAST(price_level AS DOUBLE) > 0),
s AS (SELECT DISTINCT setup_id, symbol, CAST(entry_price AS DOUBLE) AS entry FROM setup_candidate WHERE setup_id IS NOT NULL AND CAST(entry_price AS DOUBLE) > 0)
SELECT setup_id, symbol, entry, level, round(abs(level - entry) / entry, 8) AS distance FROM s JOIN l USING (symbol) WHERE abs(level - entry) <= 0.005::DOUBLE * entry
QUALIFY row_number() OVER (PARTITION BY setup_id, symbol, entry ORDER BY abs(level - entry), level) = 1"""

ORACLE = {"quality_states": STATES, "content_duplicates": DUPLICATES, "retention_report": RETENTION, "cursor_reconcile": RECONCILE, "evidence_freshness": FRESHNESS, "nearest_levels": NEAREST}
