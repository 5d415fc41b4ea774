"""SQL of the recursive indicators for DuckDB: every average is reduced over the bar's whole history."""

from __future__ import annotations

from tidemark.plans.bars_sql import _BARS, _CELL


def _fold(a: str, n: int, keep: str) -> str:
    """Average of the list ``a`` seeded with the mean of its first ``n`` values; ``keep`` is what stays of it."""
    return f"CASE WHEN len({a}) >= {n} THEN list_reduce(list_concat([list_sum({a}[1:{n}]) / {n}], {a}[{n + 1}:]), lambda s, x: s * ({keep}) + x * (1 - ({keep}))) END"


def _ema(a: str, n: int) -> str:
    return _fold(a, n, f"1 - 2.0::DOUBLE / {n + 1}")


def _wilder(a: str, n: int = 14) -> str:
    return _fold(a, n, f"1 - 1.0::DOUBLE / {n}")


_W = f"PARTITION BY {_CELL} ORDER BY n"
INDICATORS = f"""WITH {_BARS},
s AS (SELECT *, lag(c) OVER ({_W}) AS pc, lag(h) OVER ({_W}) AS ph, lag(l) OVER ({_W}) AS pl FROM bars),
m AS (SELECT *, CASE WHEN h - ph > pl - l AND h > ph THEN h - ph WHEN n > 1 THEN 0.0::DOUBLE END AS up, CASE WHEN pl - l > h - ph AND l < pl THEN pl - l WHEN n > 1 THEN 0.0::DOUBLE END AS dn,
  CASE WHEN n > 1 THEN greatest(h - l, greatest(abs(h - pc), abs(l - pc))) END AS tr FROM s),
a AS (SELECT symbol, timeframe, n, open_ms, list(c) OVER w AS cs, list(tr) FILTER (n > 1) OVER w AS ts, list(greatest(c - pc, 0.0::DOUBLE)) FILTER (n > 1) OVER w AS gs, list(greatest(pc - c, 0.0::DOUBLE)) FILTER (n > 1) OVER w AS ls,
  list(up) FILTER (n > 1) OVER w AS us, list(dn) FILTER (n > 1) OVER w AS ds FROM m WINDOW w AS ({_W})),
f AS (SELECT symbol, timeframe, n, open_ms, {_ema('cs', 20)} AS ema_20, {_wilder('cs')} AS rma_14, {_wilder('ts')} AS atr_wilder, {_ema('cs', 12)} - {_ema('cs', 26)} AS macd,
  {_wilder('gs')} AS gain, {_wilder('ls')} AS loss, {_wilder('us')} AS up, {_wilder('ds')} AS dn FROM a),
d AS (SELECT *, CASE WHEN atr_wilder >= 1e-12 THEN 100 * up / atr_wilder ELSE 0 END AS dp, CASE WHEN atr_wilder >= 1e-12 THEN 100 * dn / atr_wilder ELSE 0 END AS dm FROM f),
x AS (SELECT *, CASE WHEN dp + dm > 1e-12 THEN 100 * abs(dp - dm) / (dp + dm) ELSE 0.0::DOUBLE END AS dx FROM d),
y AS (SELECT *, list(dx) FILTER (n > 14) OVER ({_W}) AS xs, list(macd) FILTER (n >= 26) OVER ({_W}) AS ms FROM x),
z AS (SELECT *, {_fold('ms', 9, '0.8::DOUBLE')} AS signal, CASE WHEN n > 14 THEN coalesce({_wilder('xs')}, list_sum(xs) / len(xs)) END AS adx FROM y)
SELECT symbol, timeframe, open_ms, round(ema_20 + 1e-9, 6) AS ema_20, round(rma_14 + 1e-9, 6) AS rma_14, round(atr_wilder, 6) AS atr_wilder, round(macd, 6) AS macd, round(signal, 6) AS macd_signal, round(macd - signal, 6) AS macd_histogram,
  round(CASE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi_14, round(CASE WHEN loss = 0 AND gain = 0 THEN 50.0::DOUBLE WHEN loss = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + gain / loss) END, 6) AS rsi_14_neutral,
  CASE WHEN n > 14 THEN round(dp, 6) END AS di_plus, CASE WHEN n > 14 THEN round(dm, 6) END AS di_minus, round(adx, 6) AS adx_14 FROM z"""

OI_Z = f"""WITH {_BARS}, k AS (SELECT *, row_number() OVER ({_W}) AS i FROM bars WHERE oi IS NOT NULL),
w AS (SELECT symbol, timeframe, open_ms, i, oi, list(oi) OVER (PARTITION BY {_CELL} ORDER BY i ROWS 19 PRECEDING) AS x FROM k),
v AS (SELECT *, list_sum(x) / 20 AS m FROM w WHERE i >= 20), d AS (SELECT *, sqrt(list_sum(list_transform(x, lambda q: (q - list_sum(x) / 20) ** 2)) / 20) AS sd FROM v)
SELECT symbol, timeframe, open_ms, CASE WHEN list_max(x) = list_min(x) OR sd < 1e-12 THEN 0.0::DOUBLE ELSE round((oi - m) / sd, 4) END AS oi_z FROM d"""

ORACLE = {"indicators": INDICATORS, "open_interest_z": OI_Z}
