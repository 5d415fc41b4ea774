"""SQL of the bar queries for DuckDB."""

from __future__ import annotations

from tidemark.plans.upkeep_sql import _LENGTH, _READ, _ms, _slot

_NUM = ", ".join(f"CAST({a} AS DOUBLE) AS {b}" for a, b in zip(("open_price", "high_price", "low_price", "close_price", "volume", "open_interest"), ("o", "h", "l", "c", "v", "oi")))


def _obs(status: str) -> str:
    return f"""parsed AS (SELECT observation_id, symbol, timeframe, {_ms('open_time')} AS t_open, {_ms('close_time')} AS t_close, {_ms('retrieved_at')} AS t_got, {_NUM}
  FROM market_observation WHERE {status}),
once AS (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY observation_id ORDER BY t_got NULLS LAST) = 1)"""


_BARS = f"""{_obs(_READ)},
placed AS (SELECT *, {_slot('coalesce(t_open, t_close - 1)')} AS open_ms FROM once WHERE o IS NOT NULL AND h IS NOT NULL AND l IS NOT NULL AND c IS NOT NULL),
bars AS (SELECT symbol, timeframe, open_ms, o, h, l, c, v, oi, {_LENGTH} AS len_ms,
    row_number() OVER (PARTITION BY symbol, timeframe ORDER BY open_ms) AS n
  FROM (SELECT * FROM placed QUALIFY row_number() OVER (PARTITION BY symbol, timeframe, open_ms ORDER BY t_got DESC NULLS FIRST, observation_id DESC) = 1))"""
_CELL = "symbol, timeframe"


# ---------------------------------------------------------------- features, from the definitions
# Each bar carries the lists of its neighbours; every figure is worked out on these lists, not by window functions.


def _mean(x: str) -> str:
    return f"(list_sum({x}) / len({x}))"


def _dev(x: str) -> str:
    """Population deviation of a list."""
    return f"sqrt(list_sum(list_transform({x}, lambda q: (q - list_sum({x}) / len({x})) ** 2)) / len({x}))"


def _score(x: str, n: int) -> str:
    return f"CASE WHEN n >= {n} THEN CASE WHEN list_max({x}) = list_min({x}) OR {_dev(x)} < 1e-12 THEN 0.0::DOUBLE ELSE round(({x}[-1] - {_mean(x)}) / {_dev(x)}, 4) END END"


def _moment(x: str, y: str) -> str:
    """Sum of products of the deviations of two lists."""
    return f"list_sum(list_transform(list_zip({x}, {y}), lambda q: (q[1] - list_sum({x}) / len({x})) * (q[2] - list_sum({y}) / len({y}))))"


_LISTED = f"""{_BARS},
steps AS (SELECT *, h - l AS rg, lag(c) OVER w AS pc, lag(h) OVER w AS ph, lag(l) OVER w AS pl, oi - lag(oi) OVER w AS doi FROM bars WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
terms AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(rg, greatest(abs(h - pc), abs(l - pc))) END AS tr, CASE WHEN c > 0 AND pc > 0 THEN ln(c / pc) END AS r,
  CASE WHEN o > 0 AND pc > 0 THEN ln(o / pc) END AS gap, CASE WHEN c > 0 AND o > 0 THEN ln(c / o) END AS bd, least(least(o, h), least(l, c)) AS lowest FROM steps),
parts AS (SELECT *, CASE WHEN lowest > 0 THEN ln(h / l) ** 2 END AS hl2, CASE WHEN lowest > 0 THEN 0.5::DOUBLE * ln(h / l) ** 2 - (2 * ln(2.0::DOUBLE) - 1) * ln(c / o) ** 2 END AS gk,
  CASE WHEN lowest > 0 THEN ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) END AS rs FROM terms),
listed AS (SELECT *, list(c) OVER t20 AS c20, list(v) FILTER (v IS NOT NULL) OVER t20 AS v20, list(rg) OVER t20 AS rg20, list(h) OVER t14 AS h14, list(l) OVER t14 AS l14, list(c) FILTER (v IS NOT NULL) OVER t48 AS c48, list(v) FILTER (v IS NOT NULL) OVER t48 AS v48,
    list(v) FILTER (v IS NOT NULL) OVER p20 AS pv20, list(h) OVER p20 AS ph20, list(l) OVER p20 AS pl20, list(rg) OVER p20 AS prg20, list(n::DOUBLE) OVER t20 AS n20, list(tr) OVER t14 AS tr14, list(tr) OVER p14 AS ptr14,
    list(tr) OVER t10 AS tr10, list(tr) OVER t50 AS tr50, list(lowest) OVER t20 AS low20, list(hl2) OVER t20 AS hl20, list(gk) OVER t20 AS gk20, list(rs) OVER t20 AS rs20, list(rs) OVER t30 AS rs30,
    list(hl2) OVER t30 AS hl30, list(r) OVER t30 AS r30, list(gap) OVER t20 AS gap20, list(gap) OVER t30 AS gap30, list(bd) OVER t20 AS bd20, list(bd) OVER t30 AS bd30,
    list(h) OVER p2 AS ph2, list(l) OVER p2 AS pl2, list(h) OVER f2 AS fh2, list(l) OVER f2 AS fl2, list(h) OVER f96 AS fh96, list(l) OVER f96 AS fl96, list(h) OVER t12 AS h12, list(l) OVER t12 AS l12,
    list(struct_pack(s := open_ms, c := c)) OVER f48 AS f48, list(v) FILTER (v IS NOT NULL) OVER p50 AS pv50, list(rg) OVER p50 AS prg50, list(doi) FILTER (doi IS NOT NULL) OVER p20 AS pdoi20, list(oi) FILTER (oi IS NOT NULL) OVER t5 AS oi5,
    list(abs(r)) FILTER (v IS NOT NULL AND r IS NOT NULL) OVER t20 AS ar20, list(v) FILTER (v IS NOT NULL AND r IS NOT NULL) OVER t20 AS vr20
  FROM parts WINDOW t10 AS ({{0}} 9 PRECEDING), t12 AS ({{0}} 11 PRECEDING), t14 AS ({{0}} 13 PRECEDING), t20 AS ({{0}} 19 PRECEDING), t30 AS ({{0}} 29 PRECEDING), t48 AS ({{0}} 47 PRECEDING), t50 AS ({{0}} 49 PRECEDING),
    p50 AS ({{0}} BETWEEN 50 PRECEDING AND 1 PRECEDING), t5 AS ({{0}} 4 PRECEDING), p2 AS ({{0}} BETWEEN 2 PRECEDING AND 1 PRECEDING), p14 AS ({{0}} BETWEEN 14 PRECEDING AND 1 PRECEDING), p20 AS ({{0}} BETWEEN 20 PRECEDING AND 1 PRECEDING),
    f2 AS ({{0}} BETWEEN 1 FOLLOWING AND 2 FOLLOWING), f48 AS ({{0}} BETWEEN 1 FOLLOWING AND 48 FOLLOWING), f96 AS ({{0}} BETWEEN 1 FOLLOWING AND 96 FOLLOWING))""".replace("{0}", f"PARTITION BY {_CELL} ORDER BY n ROWS")
_GOOD = "h >= l AND h - l >= 1e-12"
_CANDLE_SQL = {
    "status": "CASE WHEN l > h THEN 'INVALID' WHEN h - l >= 1e-12 THEN 'OK' ELSE 'DEGRADED' END",
    **{k: f"CASE WHEN {_GOOD} THEN {x} END" for k, x in {
        "body_ratio": "round(greatest(c - o, o - c) / rg, 6)", "upper_wick": "round((CASE WHEN o > c THEN h - o ELSE h - c END) / rg, 6)", "lower_wick": "round((CASE WHEN o < c THEN o - l ELSE c - l END) / rg, 6)",
        "close_position": "round((c - l) / rg, 4)", "bar_range": "round(rg, 8)", "body_size": "round(greatest(c - o, o - c), 8)", "is_bullish": "CAST(o <= c AS INTEGER)", "is_bearish": "CAST(o > c AS INTEGER)",
    }.items()},
    "is_inside": "coalesce(ph > h AND pl < l, FALSE)", "is_outside": "coalesce(ph < h AND pl > l, FALSE)", "log_return": "round(r, 8)",
    "hour": "CAST(date_part('hour', make_timestamp(open_ms * 1000)) AS INTEGER)", "weekday": "CAST(date_part('isodow', make_timestamp(open_ms * 1000)) - 1 AS INTEGER)",
}
_FIXED = "CAST(CAST({} AS VARCHAR) AS DECIMAL({},{}))".format
_PVS = f"CAST({_FIXED('h', 16, 6)} + {_FIXED('l', 16, 6)} + {_FIXED('c', 16, 6)} AS DECIMAL(19,6)) * CAST({_FIXED('v', 18, 4)} AS DECIMAL(19,4))"
_TRAILING_SQL = {
    "true_range": f"CASE WHEN {_GOOD} THEN round(tr, 8) END", "sma_20": f"CASE WHEN n >= 20 THEN round({_mean('c20')}, 9) END",
    **{f"return_{k}": f"CASE WHEN n > 20 THEN round(c / nullif(lag(c, {k}) OVER w, 0) - 1, 8) END" for k in (1, 5, 20)},
    "vwap_20": f"CASE WHEN n >= 20 THEN round(CAST(CAST(sum({_PVS}) OVER (w ROWS 19 PRECEDING) AS VARCHAR) AS DOUBLE) / nullif(CAST(CAST(sum({_FIXED('v', 18, 4)}) OVER (w ROWS 19 PRECEDING) AS VARCHAR) AS DOUBLE) * 3, 0), 9) END",
    "volume_z": f"CASE WHEN v IS NOT NULL THEN {_score('v20', 20)} WHEN n >= 20 AND {_dev('v20')} < 1e-12 THEN 0.0::DOUBLE END", "range_z": _score("rg20", 20), "volume_ratio_prev": f"CASE WHEN n > 20 THEN round(v / nullif({_mean('pv20')}, 0), 4) END",
    "slope_20": f"CASE WHEN n >= 20 THEN round(CAST(CAST(list_sum(list_transform(c20, lambda q, i: (2 * i - 21) * {_FIXED('q', 16, 6)})) AS VARCHAR) AS DOUBLE) / 1330, 8) END",
    "r2_20": f"CASE WHEN n >= 20 THEN CASE WHEN list_max(c20) = list_min(c20) THEN 1.0::DOUBLE ELSE round({_moment('n20', 'c20')} ** 2 / 665.0::DOUBLE / {_moment('c20', 'c20')}, 6) END END",
    "oi_delta": "round(oi - lag(oi) OVER w, 8)", "roc_10": "round((c / nullif(lag(c, 10) OVER w, 0) - 1) * 100, 6)",
    "stochastic_k": "CASE WHEN n >= 14 THEN CASE WHEN list_max(h14) = list_min(l14) THEN 50.0::DOUBLE ELSE round((c - list_min(l14)) / (list_max(h14) - list_min(l14)) * 100, 6) END END",
    "price_volume_corr": f"CASE WHEN n >= 48 THEN round({_moment('c48', 'v48')} / CASE WHEN list_max(c48) > list_min(c48) AND list_max(v48) > list_min(v48) THEN sqrt({_moment('c48', 'c48')} * {_moment('v48', 'v48')}) END, 6) END",
    "bollinger_width": f"CASE WHEN n >= 20 THEN round(4 * {_dev('c20')} / nullif({_mean('c20')}, 0), 8) END",
    "hl2_channel_high": "CASE WHEN n > 20 THEN list_max(ph20) END", "hl2_channel_low": "CASE WHEN n > 20 THEN list_min(pl20) END",
}


def _squares(x: str) -> str:
    return f"list_sum(list_transform({x}, lambda q: q * q))"


def _filled(x: str) -> str:
    return f"list_filter({x}, lambda q: q IS NOT NULL)"


def _msq(x: str) -> str:
    return f"({_squares(_filled(x))} / nullif(len({_filled(x)}), 0))"


_K = "(0.34::DOUBLE / (1.34::DOUBLE + 31.0::DOUBLE / 29.0::DOUBLE))"
_WHOLE = "n >= 20 AND list_min(low20) > 0"
_VOLATILITY_SQL = {
    "parkinson": f"CASE WHEN {_WHOLE} THEN round(sqrt(list_sum(hl20) / (4 * 20 * ln(2.0::DOUBLE))), 8) END",
    "garman_klass": f"CASE WHEN {_WHOLE} AND list_sum(gk20) >= 0 THEN round(sqrt(list_sum(gk20) / 20), 8) END",
    "garman_klass_floored": f"CASE WHEN n >= 20 THEN round(sqrt(list_sum(list_transform({_filled('gk20')}, lambda q: greatest(q, 0.0::DOUBLE))) / nullif(len({_filled('gk20')}), 0)), 8) END",
    "rogers_satchell": f"CASE WHEN {_WHOLE} AND list_sum(rs20) >= 0 THEN round(sqrt(list_sum(rs20) / 20), 8) END",
    "yang_zhang_30": f"CASE WHEN n > 30 THEN round(sqrt(coalesce({_msq('gap30')}, 0) + {_K} * coalesce({_msq('bd30')}, 0) + (1 - {_K}) * greatest(0.0::DOUBLE, list_sum(rs30) / nullif(len({_filled('rs30')}), 0))), 8) END",
    "parkinson_adjusted_30": f"CASE WHEN n > 30 THEN round(sqrt(coalesce({_msq('gap30')}, 0) + coalesce(list_sum(hl30), 0) / (4 * ln(2.0::DOUBLE) * 30)), 8) END",
    "realized_var_30": f"CASE WHEN n > 30 THEN round({_squares(_filled('r30'))}, 10) END", "hv_30": f"CASE WHEN n > 30 THEN round(sqrt({_squares(_filled('r30'))} * (365.0::DOUBLE * 86400000) / len_ms), 8) END",
    "overnight_var": f"CASE WHEN n > 20 THEN round({_msq('gap20')}, 10) END", "open_close_var": f"CASE WHEN n >= 20 THEN round({_msq('bd20')}, 10) END",
    "volatility_ratio": f"CASE WHEN n > 50 THEN round({_mean('tr10')} / nullif({_mean('tr50')}, 0), 6) END",
    "atr_14": f"CASE WHEN n > 14 AND {_mean('tr14')} >= 1e-8 THEN round({_mean('tr14')}, 8) END", "normalized_range": f"CASE WHEN n > 14 AND {_GOOD} THEN round(rg / greatest({_mean('tr14')}, 1e-12), 4) END",
    "compression": f"coalesce(n > 50 AND {_mean('tr10')} < 0.75::DOUBLE * {_mean('tr50')}, FALSE)",
}
_ATR = _mean(_filled("tr14"))
_EVENTS_SQL = {
    "swing_high": "coalesce(n > 2 AND len(fh2) = 2 AND h > list_max(ph2) AND h >= list_max(fh2), FALSE)", "swing_low": "coalesce(n > 2 AND len(fl2) = 2 AND l < list_min(pl2) AND l <= list_min(fl2), FALSE)",
    "gap_open": f"coalesce(n > 14 AND abs(o - pc) > 1.8::DOUBLE * {_mean(_filled('ptr14'))}, FALSE)",
    "fvg": f"CASE WHEN n > 14 AND l - ph2[1] >= 0.2::DOUBLE * {_ATR} THEN 'UP' WHEN n > 14 AND pl2[1] - h >= 0.2::DOUBLE * {_ATR} THEN 'DOWN' END",
    "fvg_lower": "CASE WHEN len(ph2) = 2 THEN CASE WHEN l > ph2[1] THEN ph2[1] WHEN pl2[1] > h THEN h END END", "fvg_upper": "CASE WHEN len(ph2) = 2 THEN CASE WHEN l > ph2[1] THEN l WHEN pl2[1] > h THEN pl2[1] END END",
    "fvg_fill": "CASE WHEN len(ph2) = 2 THEN CASE WHEN l > ph2[1] THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (l - list_min(fl96)) / (l - ph2[1]))), 6) WHEN pl2[1] > h THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (list_max(fh96) - h) / (pl2[1] - h))), 6) END END",
    "sweep_low": "coalesce(n > 20 AND l < list_min(pl20) AND c > list_min(pl20), FALSE)", "sweep_high": "coalesce(n > 20 AND h > list_max(ph20) AND c < list_max(ph20), FALSE)",
    "break_up": f"coalesce(n > 20 AND c > list_max(ph20) AND c - list_max(ph20) >= 0.3::DOUBLE * {_ATR}, FALSE)", "break_down": f"coalesce(n > 20 AND c < list_min(pl20) AND list_min(pl20) - c >= 0.3::DOUBLE * {_ATR}, FALSE)",
    "climax": f"coalesce(n > 20 AND v > 3 * {_mean('pv20')} AND rg > 2 * {_mean('prg20')}, FALSE)", "range_12": f"coalesce(n >= 12 AND list_max(h12) - list_min(l12) < 1.5::DOUBLE * {_ATR}, FALSE)",
    "forward_return_48": "CASE WHEN len(f48) = 48 AND f48[48].s = CASE timeframe WHEN '1mo' THEN epoch_ms(make_timestamp(open_ms * 1000) + INTERVAL 48 MONTH) ELSE open_ms + 48 * len_ms END THEN round(f48[48].c / nullif(c, 0) - 1, 8) END",
    "wash_like": f"coalesce(n > 20 AND v > 3 * {_mean('pv20')} AND abs((rg - {_mean('prg20')}) / nullif({_dev('prg20')}, 0)) < 0.5 AND abs(c - o) / nullif(rg, 0) < 0.1::DOUBLE, FALSE)",
}


def _prior(x: str, past: str, n: int) -> str:
    return f"CASE WHEN n > {n} AND {x} IS NOT NULL THEN CASE WHEN list_max({past}) = list_min({past}) OR {_dev(past)} < 1e-12 THEN 0.0::DOUBLE ELSE ({x} - {_mean(past)}) / {_dev(past)} END END"


_PVZ, _PRZ = f"({_prior('v', 'pv50', 50)})", f"({_prior('rg', 'prg50', 50)})"
_POZ = f"(CASE WHEN doi IS NOT NULL AND len(pdoi20) = 20 AND list_max(pdoi20) <> list_min(pdoi20) THEN (doi - {_mean('pdoi20')}) / {_dev('pdoi20')} END)"
_TANH = "((exp(2 * ({0})) - 1) / (exp(2 * ({0})) + 1))".format
_PARTICIPATION_SQL = {
    "volume_z_prior": f"round({_PVZ}, 4)", "range_z_prior": f"round({_PRZ}, 4)", "oi_change_z": f"round({_POZ}, 4)", "effort_result": f"round({_PVZ} * {_PRZ} * sign(c - pc), 6)",
    "accumulation": f"CASE WHEN n > 50 THEN round((0.25::DOUBLE * {_TANH('sign(c - o)')} + 0.25::DOUBLE * {_TANH('CASE WHEN h > l THEN 2 * (c - l) / rg - 1 ELSE 0 END')} + 0.15::DOUBLE * {_TANH(f'least(greatest({_PRZ} / 2, -300), 300)')} + CASE WHEN {_PVZ} IS NULL THEN NULL ELSE 0.2::DOUBLE * {_TANH(f'least(greatest({_PVZ} / 2, -300), 300)')} END"
      f" + CASE WHEN {_POZ} IS NULL THEN 0 ELSE 0.15::DOUBLE * {_TANH(f'least(greatest({_POZ} / 2, -300), 300)')} END) / CASE WHEN {_POZ} IS NULL THEN 0.85::DOUBLE ELSE 1 END, 6) END",
    "is_climax": f"coalesce(n > 50 AND v >= 2.5::DOUBLE * {_mean('pv20')} AND {_PRZ} >= 2, FALSE)", "is_dry": f"coalesce(n > 20 AND v <= 0.4::DOUBLE * {_mean('pv20')}, FALSE)",
    "effort_without_result": f"coalesce(n > 50 AND {_PVZ} > 1.5 AND abs({_PRZ}) < 0.5, FALSE)", "effort_with_result": f"coalesce(n > 50 AND {_PVZ} > 1.5 AND abs({_PRZ}) > 1.5, FALSE)",
    "oi_state": "CASE WHEN oi IS NULL THEN 'MISSING' WHEN len(oi5) = 5 AND list_max(oi5) = list_min(oi5) THEN 'STALE' ELSE 'AVAILABLE' END",
    "volume_effort_corr": f"CASE WHEN n > 20 AND len(v20) = 20 THEN round({_moment('vr20', 'ar20')} / CASE WHEN list_max(vr20) > list_min(vr20) AND list_max(ar20) > list_min(ar20) THEN sqrt({_moment('vr20', 'vr20')} * {_moment('ar20', 'ar20')}) END, 6) END",
}
_BY_GROUP = {"candle": _CANDLE_SQL, "trailing": _TRAILING_SQL, "volatility": _VOLATILITY_SQL, "events": _EVENTS_SQL, "participation": _PARTICIPATION_SQL}


def _features(group: str) -> str:
    cols = ", ".join(f"{x} AS {n}" for n, x in _BY_GROUP[group].items())
    return f"WITH {_LISTED} SELECT symbol, timeframe, open_ms, {cols} FROM listed WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)"


def _seed(a: str, n: int) -> str:
    return f"list_sum({a}[1:{n}]) / {n}"


def _ema(a: str, n: int) -> str:
    return f"list_reduce(list_concat([{_seed(a, n)}], {a}[{n + 1}:]), lambda s, x: s * (1 - 2.0::DOUBLE / {n + 1}) + x * (2.0::DOUBLE / {n + 1}))"


def _rma(a: str, n: int) -> str:
    return f"list_reduce(list_concat([{_seed(a, n)}], {a}[{n + 1}:]), lambda s, x: (s * {n - 1} + x) / {n})"


_FOLDS = f"""WITH {_BARS},
t AS (SELECT *, lag(c) OVER w AS pc FROM bars WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
u AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(h - l, abs(h - pc), abs(l - pc)) END AS tr FROM t),
a AS (SELECT symbol, timeframe, open_ms, n, list(c) OVER w AS cs, list(tr) OVER w AS ts, list(greatest(c - pc, 0.0::DOUBLE)) OVER w AS ups, list(greatest(pc - c, 0.0::DOUBLE)) OVER w AS downs
  FROM u WINDOW w AS (PARTITION BY {_CELL} ORDER BY n ROWS 59 PRECEDING)),
f AS (SELECT symbol, timeframe, open_ms, {_ema('cs', 20)} AS ema_20, {_rma('cs', 14)} AS rma_14, {_rma('ts', 14)} AS atr_wilder, {_ema('cs', 12)} - {_ema('cs', 26)} AS macd,
  {_rma('ups', 14)} AS up, {_rma('downs', 14)} AS down FROM a WHERE n > 60)
SELECT symbol, timeframe, open_ms, round(ema_20, 6) AS ema_20, round(rma_14, 6) AS rma_14, round(atr_wilder, 8) AS atr_wilder, round(macd, 6) AS macd,
  round(CASE WHEN down = 0 AND up = 0 THEN 50.0 WHEN down = 0 THEN 100.0 ELSE 100 - 100 / (1 + up / nullif(down, 0)) END, 6) AS rsi_14 FROM f"""

_RESAMPLE = f"""WITH {_BARS}
SELECT symbol, timeframe, CAST(make_timestamp(open_ms * 1000) AS DATE) AS day, arg_min(o, open_ms) AS o, max(h) AS h, min(l) AS l, arg_max(c, open_ms) AS c,
  round(CAST(CAST(sum(CAST(CAST(v AS VARCHAR) AS DECIMAL(28,8))) AS VARCHAR) AS DOUBLE), 3) AS v, arg_max(oi, open_ms) FILTER (oi IS NOT NULL) AS oi, count(*) AS n, round(count(*) * max(len_ms) / 86400000.0::DOUBLE, 6) AS completeness
FROM bars WHERE len_ms < 86400000 GROUP BY ALL"""

_VALIDATION = f"""WITH {_obs('TRUE')}
SELECT symbol, timeframe, CASE WHEN o IS NULL OR h IS NULL OR l IS NULL OR c IS NULL THEN 'NO_PRICE' WHEN t_close IS NULL AND t_open IS NULL THEN 'NO_TIME'
  WHEN h < greatest(o, c, l) THEN 'HIGH_BELOW' WHEN l > least(o, c) THEN 'LOW_ABOVE' WHEN l <= 0 THEN 'NOT_POSITIVE' WHEN v IS NULL THEN 'NO_VOLUME' WHEN v < 0 THEN 'NEGATIVE_VOLUME'
  WHEN oi < 0 THEN 'NEGATIVE_OI' WHEN t_open >= t_close THEN 'TIME_ORDER' ELSE 'OK' END AS code, count(*) AS n
FROM once GROUP BY ALL"""

_EXPECTED = """CASE max(timeframe) WHEN '1mo' THEN date_diff('month', make_timestamp(min(open_ms) * 1000), make_timestamp(max(open_ms) * 1000)) ELSE (max(open_ms) - min(open_ms)) // max(len_ms) END + 1"""
_FRONTIER = f"""WITH {_BARS}, f AS (SELECT symbol, timeframe, max(open_ms) AS last_open_ms, count(*) AS n_bars, {_EXPECTED} AS n_expected, count(oi) AS n_oi FROM bars GROUP BY ALL)
SELECT symbol, timeframe, last_open_ms, n_bars, CAST(n_expected AS BIGINT) AS n_expected, round(n_bars / CAST(n_expected AS DOUBLE), 6) AS completeness, n_oi FROM f"""

_LAST = f"""WITH {_BARS} SELECT symbol, timeframe, open_ms, max(n) OVER (PARTITION BY {_CELL}) - n AS age, o, h, l, c, v FROM bars
QUALIFY n > max(n) OVER (PARTITION BY {_CELL}) - 50"""

_PROFILE = f"""WITH {_BARS},
t AS (SELECT *, (h + l + c) / 3 AS tp FROM bars WHERE h >= l AND v >= 0 AND l > 0),
s AS (SELECT *, min(tp) OVER (PARTITION BY {_CELL}) AS lo, max(tp) OVER (PARTITION BY {_CELL}) AS hi FROM t),
b AS (SELECT symbol, timeframe, CAST(least(floor((tp - lo) / nullif(hi - lo, 0) * 50), 49) AS INTEGER) AS bin, CAST(CAST(v AS VARCHAR) AS DECIMAL(28,8)) AS v FROM s WHERE hi > lo),
g AS (SELECT symbol, timeframe, bin, sum(v) AS volume FROM b GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rk, coalesce(sum(volume) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead, sum(volume) OVER (PARTITION BY {_CELL}) AS total
  FROM g WINDOW w AS (PARTITION BY {_CELL} ORDER BY volume DESC, bin))
SELECT symbol, timeframe, bin, round(CAST(CAST(volume AS VARCHAR) AS DOUBLE), 3) AS volume, rk = 1 AS is_poc, CAST(ahead AS DOUBLE) < CAST(total AS DOUBLE) * 0.7 AS in_value_area FROM r"""

_SEASONAL = f"""WITH {_BARS},
t AS (SELECT *, CASE WHEN c > 0 AND lag(c) OVER w > 0 THEN ln(c / lag(c) OVER w) END AS r FROM bars WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
g AS (SELECT symbol, timeframe, CAST((open_ms // 3600000) % 24 AS INTEGER) AS hour, count(*) AS n, sum(r * r) AS s, count(*) FILTER (r > 0) AS ups FROM t WHERE r IS NOT NULL GROUP BY ALL),
p AS (SELECT *, sum(s) OVER w / CAST(sum(n) OVER w AS DOUBLE) AS grand, ups / CAST(n AS DOUBLE) AS p FROM g WINDOW w AS (PARTITION BY {_CELL})),
q AS (SELECT *, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) AS half FROM p)
SELECT symbol, timeframe, hour, n, round(least(greatest(s / n / nullif(grand, 0), 0.1), 10.0), 6) AS factor, round(p, 6) AS up_rate, round(mid - half, 6) AS up_low, round(mid + half, 6) AS up_high FROM q"""

_SPREADS = f"""WITH {_BARS},
a AS (SELECT symbol, timeframe, v, c, ln(h / l) AS hl, ln(c) AS lc, (ln(h) + ln(l)) / 2 AS eta, greatest(h, lag(h) OVER w) AS h2, least(l, lag(l) OVER w) AS l2, lag(c) OVER w AS pc, n
  FROM bars WHERE h > 0 AND l > 0 AND c > 0 AND h >= l WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
b AS (SELECT *, lc - ln(pc) AS r, power(hl, 2) + power(lag(hl) OVER w, 2) AS beta, power(ln(h2 / l2), 2) AS gamma, lag(lc) OVER w AS plc, lag(eta) OVER w AS peta FROM a WINDOW w AS (PARTITION BY {_CELL} ORDER BY n)),
d AS (SELECT *, (sqrt(2 * beta) - sqrt(beta)) / (3 - 2 * sqrt(2.0::DOUBLE)) - sqrt(gamma / (3 - 2 * sqrt(2.0::DOUBLE))) AS alpha, lag(r) OVER w AS pr, (plc - peta) * (plc - (peta + eta) / 2) AS mid FROM b WINDOW w AS (PARTITION BY {_CELL} ORDER BY n))
SELECT symbol, timeframe, count(*) AS n, round(avg(greatest(0.0, 2 * (exp(alpha) - 1) / (1 + exp(alpha)))), 8) AS corwin_schultz, round(sqrt(greatest(0.0, 4 * avg(mid))), 8) AS abdi_ranaldo,
  round(2 * sqrt(greatest(0.0, -covar_pop(r, pr))), 8) AS roll, round(avg(abs(r) / v) FILTER (v > 0) * 1e6, 6) AS amihud_1e6, round(regr_slope(c - pc, sign(r) * v) * 1e6, 6) AS kyle_1e6
FROM d WHERE r IS NOT NULL GROUP BY ALL"""

_TRANSITIONS = f"""WITH {_BARS},
s AS (SELECT *, CASE WHEN c > o * 1.0005::DOUBLE THEN 'UP' WHEN c < o * 0.9995::DOUBLE THEN 'DOWN' ELSE 'FLAT' END AS state FROM bars),
t AS (SELECT timeframe, state, lag(state) OVER (PARTITION BY {_CELL} ORDER BY n) AS prev FROM s),
g AS (SELECT timeframe, prev, state, count(*) AS n FROM t WHERE prev IS NOT NULL GROUP BY ALL)
SELECT timeframe, prev, state, n, round((n + 1) / CAST(sum(n) OVER (PARTITION BY timeframe, prev) + 3 AS DOUBLE), 6) AS rate FROM g"""

_COARSER = f"""WITH {_BARS}, k AS (SELECT *, open_ms + len_ms AS close_ms FROM bars)
SELECT f.symbol, f.open_ms, f.c, a.open_ms AS open_1h, a.c AS c_1h, b.open_ms AS open_1d, b.c AS c_1d FROM (SELECT * FROM k WHERE timeframe = '15m') f
ASOF LEFT JOIN (SELECT * FROM k WHERE timeframe = '1h') a ON a.symbol = f.symbol AND f.close_ms >= a.close_ms
ASOF LEFT JOIN (SELECT * FROM k WHERE timeframe = '1d') b ON b.symbol = f.symbol AND f.close_ms >= b.close_ms"""

# two steps up (else one) and four (else the coarsest), written out from the ladder of timeframes
_LADDER = ["1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "1w", "1mo"]
_PAIRS = ", ".join(f"('{t}', {repr(_LADDER[min(i + 2, 13)]) if i < 13 else 'NULL'}, {repr(_LADDER[min(i + 4, 13)]) if i < 13 else 'NULL'})" for i, t in enumerate(_LADDER))
_COARSER_ALL = f"""WITH {_BARS}, k AS (SELECT *, CASE timeframe WHEN '1mo' THEN epoch_ms(make_timestamp(open_ms * 1000) + INTERVAL 1 MONTH) ELSE open_ms + len_ms END AS close_ms FROM bars),
f AS (SELECT k.*, w.mid, w.high FROM k JOIN (VALUES {_PAIRS}) w(tf, mid, high) ON w.tf = k.timeframe)
SELECT f.symbol, f.timeframe, f.open_ms, f.c, f.mid AS tf_mid, a.open_ms AS open_mid, a.c AS c_mid, f.high AS tf_high, b.open_ms AS open_high, b.c AS c_high FROM f
ASOF LEFT JOIN k a ON a.symbol = f.symbol AND a.timeframe = f.mid AND f.close_ms >= a.close_ms ASOF LEFT JOIN k b ON b.symbol = f.symbol AND b.timeframe = f.high AND f.close_ms >= b.close_ms"""

_QUALITY = f"""WITH {_BARS},
q AS (SELECT DISTINCT quality_id, observation_id, q_raw FROM quality_vector WHERE q_raw IS NOT NULL AND NOT isnan(q_raw)),
p AS (SELECT observation_id, symbol, timeframe, {_slot('coalesce(t_open, t_close - 1)')} AS open_ms FROM once),
j AS (SELECT symbol, timeframe, q_raw AS q, exp(-0.05::DOUBLE * (top - n)) AS wt FROM q JOIN p USING (observation_id)
  JOIN (SELECT *, max(n) OVER (PARTITION BY {_CELL}) AS top FROM bars) USING (symbol, timeframe, open_ms))
SELECT symbol, timeframe, count(*) AS n, min(q) AS q_min, round(sum(q * wt) / nullif(sum(wt), 0), 6) AS q_window, min(q) < 0.5 AS is_vetoed FROM j GROUP BY ALL"""

_AGREEMENT = """WITH e AS (SELECT DISTINCT evidence_id, snapshot_id, engine_id, event_type, confidence, strength FROM evidence_event WHERE snapshot_id <> '' AND validity = 1),
p AS (SELECT snapshot_id, engine_id, count(*) AS k, sum(CAST(confidence AS DECIMAL(18,6))) AS s, max(strength) AS hi, min(strength) AS lo FROM e GROUP BY ALL)
SELECT snapshot_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS engines, round(CAST(CAST(sum(s) AS VARCHAR) AS DOUBLE) / sum(k), 6) AS mean_confidence, max(hi) - min(lo) AS strength_spread,
  round(max(k) / CAST(sum(k) AS DOUBLE), 6) AS dominant_share FROM p GROUP BY ALL"""

ORACLE = {
    "bars_clean": f"WITH {_BARS} SELECT symbol, timeframe, open_ms, o, h, l, c, v, oi FROM bars",
    **{f"features_{g}": _features(g) for g in _BY_GROUP},
    "features_folds": _FOLDS, "bars_resample_1d": _RESAMPLE, "bars_validation": _VALIDATION, "bars_frontier": _FRONTIER, "bars_last_window": _LAST,
    "volume_profile": _PROFILE, "seasonal_factors": _SEASONAL, "spread_proxies": _SPREADS, "transition_matrix": _TRANSITIONS, "coarser_asof": _COARSER, "coarser_all": _COARSER_ALL,
    "window_quality": _QUALITY, "evidence_agreement": _AGREEMENT,
}
