"""Bar features as column expressions over trailing frames.

Each feature is SQL text over o, h, l, c, v, oi and n (the bar's number in its cell). ``{p:k}`` stands
for the value k bars ago of the column p (``{p:-k}``: k bars on), ``{20}`` for the frame of the last 20 bars with the
current one, ``{-20}`` for the 20 bars before it and ``{+k}`` for the k bars after it. A feature is
null until its frame is full (a flag is false). Divisions are guarded with nullif; results are rounded half up.
"""

from __future__ import annotations

import re

#: A candle that the guard lets through; the others have a status instead of values.
_OK = "h - l >= 1e-12"
CANDLE = {
    "status": "CASE WHEN h < l THEN 'INVALID' WHEN h - l < 1e-12 THEN 'DEGRADED' ELSE 'OK' END",
    "body_ratio": f"CASE WHEN {_OK} THEN round(abs(c - o) / (h - l), 6) END",
    "upper_wick": f"CASE WHEN {_OK} THEN round((h - greatest(o, c)) / (h - l), 6) END",
    "lower_wick": f"CASE WHEN {_OK} THEN round((least(o, c) - l) / (h - l), 6) END",
    "close_position": f"CASE WHEN {_OK} THEN round((c - l) / (h - l), 4) END",
    "bar_range": f"CASE WHEN {_OK} THEN round(h - l, 8) END",
    "body_size": f"CASE WHEN {_OK} THEN round(abs(c - o), 8) END",
    "is_bullish": f"CASE WHEN {_OK} THEN CASE WHEN c >= o THEN 1 ELSE 0 END END",
    "is_bearish": f"CASE WHEN {_OK} THEN CASE WHEN c < o THEN 1 ELSE 0 END END",
    "is_inside": "coalesce(h < {h:1} AND l > {l:1}, FALSE)",
    "is_outside": "coalesce(h > {h:1} AND l < {l:1}, FALSE)",
    "log_return": "round(CASE WHEN c > 0 AND {c:1} > 0 THEN ln(c / {c:1}) END, 8)",
    "hour": "cast(floor(open_ms / 3600000D) % 24 AS int)",
    "weekday": "cast((floor(open_ms / 86400000D) + 3) % 7 AS int)",
}
TR = "greatest(h - l, abs(h - {c:1}), abs(l - {c:1}))"


def _z(x: str, n: int, digits: int = 4) -> str:
    """(x - mean) / population deviation over n bars; 0 for a flat series."""
    return f"CASE WHEN n >= {n} THEN CASE WHEN stddev_pop({x}) OVER {{{n}}} < 1e-12 THEN 0.0 ELSE round(({x} - avg({x}) OVER {{{n}}}) / stddev_pop({x}) OVER {{{n}}}, {digits}) END END"


#: Exact sums: products of prices and volumes as decimals, so that the order of adding does not show.
_PV = "(cast(h AS decimal(16,6)) + cast(l AS decimal(16,6)) + cast(c AS decimal(16,6))) * cast(v AS decimal(18,4))"
TRAILING = {
    "true_range": f"CASE WHEN {{c:1}} IS NOT NULL AND {_OK} THEN round({TR}, 8) END",
    "sma_20": "CASE WHEN n >= 20 THEN round(avg(c) OVER {20}, 9) END",
    "return_1": "CASE WHEN n > 20 THEN round(c / nullif({c:1}, 0) - 1, 8) END",
    "return_5": "CASE WHEN n > 20 THEN round(c / nullif({c:5}, 0) - 1, 8) END",
    "return_20": "CASE WHEN n > 20 THEN round(c / nullif({c:20}, 0) - 1, 8) END",
    "vwap_20": f"CASE WHEN n >= 20 THEN round(cast(sum({_PV}) OVER {{20}} AS double) / nullif(cast(sum(cast(v AS decimal(18,4))) OVER {{20}} AS double) * 3, 0), 9) END",
    "volume_z": _z("v", 20),
    "volume_ratio_prev": "CASE WHEN n > 20 THEN round(v / nullif(avg(v) OVER {-20}, 0), 4) END",
    "range_z": _z("(h - l)", 20),
    "slope_20": "CASE WHEN n >= 20 THEN round(cast(2 * sum(cast(n AS decimal(15,0)) * cast(c AS decimal(16,6))) OVER {20} - (2 * n - 19) * sum(cast(c AS decimal(16,6))) OVER {20} AS double) / 1330, 8) END",
    "r2_20": "CASE WHEN n >= 20 THEN round(regr_r2(c, n) OVER {20}, 6) END",
    "oi_delta": "round(oi - {oi:1}, 8)",
    "roc_10": "round((c / nullif({c:10}, 0) - 1) * 100, 6)",
    "stochastic_k": "CASE WHEN n >= 14 THEN CASE WHEN max(h) OVER {14} = min(l) OVER {14} THEN 50.0 ELSE round((c - min(l) OVER {14}) / nullif(max(h) OVER {14} - min(l) OVER {14}, 0) * 100, 6) END END",
    "price_volume_corr": "CASE WHEN n >= 48 THEN round(covar_pop(c, v) OVER {48} / nullif(stddev_pop(CASE WHEN v IS NOT NULL THEN c END) OVER {48} * stddev_pop(v) OVER {48}, 0), 6) END",
    "bollinger_width": "CASE WHEN n >= 20 THEN round(4 * stddev_pop(c) OVER {20} / nullif(avg(c) OVER {20}, 0), 8) END",
    "hl2_channel_high": "CASE WHEN n > 20 THEN max(h) OVER {-20} END",
    "hl2_channel_low": "CASE WHEN n > 20 THEN min(l) OVER {-20} END",
}
_POS = "least(o, h, l, c) > 0"
#: Every bar of the last 20 has four positive prices.
_ALL = "n >= 20 AND min(least(o, h, l, c)) OVER {20} > 0"
_RS = f"(CASE WHEN {_POS} THEN ln(h / c) * ln(h / o) + ln(l / c) * ln(l / o) END)"
_GK = f"(CASE WHEN {_POS} THEN 0.5 * power(ln(h / l), 2) - (2 * ln(2D) - 1) * power(ln(c / o), 2) END)"
_HL = f"(CASE WHEN {_POS} THEN power(ln(h / l), 2) END)"
_K30 = "(0.34D / (1.34D + 31D / 29D))"
VOLATILITY = {
    "parkinson": f"CASE WHEN {_ALL} THEN round(sqrt(sum({_HL}) OVER {{20}} / (4 * 20 * ln(2D))), 8) END",
    "garman_klass": f"CASE WHEN {_ALL} AND avg({_GK}) OVER {{20}} >= 0 THEN round(sqrt(avg({_GK}) OVER {{20}}), 8) END",
    "garman_klass_floored": f"CASE WHEN n >= 20 THEN round(sqrt(avg(CASE WHEN {_POS} THEN greatest(0D, {_GK}) END) OVER {{20}}), 8) END",
    "rogers_satchell": f"CASE WHEN {_ALL} AND avg({_RS}) OVER {{20}} >= 0 THEN round(sqrt(avg({_RS}) OVER {{20}}), 8) END",
    "yang_zhang_30": f"CASE WHEN n > 30 THEN round(sqrt(coalesce(avg(g * g) OVER {{30}}, 0D) + {_K30} * coalesce(avg(d * d) OVER {{30}}, 0D) + (1 - {_K30}) * greatest(0D, avg({_RS}) OVER {{30}})), 8) END",
    "parkinson_adjusted_30": f"CASE WHEN n > 30 THEN round(sqrt(coalesce(avg(g * g) OVER {{30}}, 0D) + coalesce(sum({_HL}) OVER {{30}}, 0D) / (4 * ln(2D) * 30)), 8) END",
    "realized_var_30": "CASE WHEN n > 30 THEN round(sum(r * r) OVER {30}, 10) END",
    "hv_30": "CASE WHEN n > 30 THEN round(sqrt(sum(r * r) OVER {30} * 31536000000D / len_ms), 8) END",
    "overnight_var": "CASE WHEN n > 20 THEN round(avg(g * g) OVER {20}, 10) END",
    "open_close_var": "CASE WHEN n >= 20 THEN round(avg(d * d) OVER {20}, 10) END",
    "volatility_ratio": "CASE WHEN n > 50 THEN round(avg(tr) OVER {10} / nullif(avg(tr) OVER {50}, 0), 6) END",
    "atr_14": "CASE WHEN n > 14 AND avg(tr) OVER {14} >= 1e-8 THEN round(avg(tr) OVER {14}, 8) END",
    "normalized_range": f"CASE WHEN n > 14 AND {_OK} THEN round((h - l) / greatest(avg(tr) OVER {{14}}, 1e-12), 4) END",
    "compression": "coalesce(n > 50 AND avg(tr) OVER {10} < 0.75 * avg(tr) OVER {50}, FALSE)",
}
EVENTS = {
    "swing_high": "coalesce(n > 2 AND h > max(h) OVER {-2} AND h >= max(h) OVER {+2} AND count(*) OVER {+2} = 2, FALSE)",
    "swing_low": "coalesce(n > 2 AND l < min(l) OVER {-2} AND l <= min(l) OVER {+2} AND count(*) OVER {+2} = 2, FALSE)",
    "gap_open": "coalesce(n > 14 AND abs(o - {c:1}) > 1.8 * avg(tr) OVER {-14}, FALSE)",
    "fvg": "CASE WHEN n > 14 AND l - {h:2} >= 0.2 * avg(tr) OVER {14} THEN 'UP' WHEN n > 14 AND {l:2} - h >= 0.2 * avg(tr) OVER {14} THEN 'DOWN' END",
    "fvg_lower": "CASE WHEN l > {h:2} THEN {h:2} WHEN {l:2} > h THEN h END",
    "fvg_upper": "CASE WHEN l > {h:2} THEN l WHEN {l:2} > h THEN {l:2} END",
    "fvg_fill": "CASE WHEN l > {h:2} THEN round(least(1.0, greatest(0.0, (l - min(l) OVER {+96}) / nullif(l - {h:2}, 0))), 6) WHEN {l:2} > h THEN round(least(1.0, greatest(0.0, (max(h) OVER {+96} - h) / nullif({l:2} - h, 0))), 6) END",
    "sweep_low": "coalesce(n > 20 AND l < min(l) OVER {-20} AND c > min(l) OVER {-20}, FALSE)",
    "sweep_high": "coalesce(n > 20 AND h > max(h) OVER {-20} AND c < max(h) OVER {-20}, FALSE)",
    "break_up": "coalesce(n > 20 AND c > max(h) OVER {-20} AND c - max(h) OVER {-20} >= 0.3 * avg(tr) OVER {14}, FALSE)",
    "break_down": "coalesce(n > 20 AND c < min(l) OVER {-20} AND min(l) OVER {-20} - c >= 0.3 * avg(tr) OVER {14}, FALSE)",
    "climax": "coalesce(n > 20 AND v > 3 * avg(v) OVER {-20} AND h - l > 2 * avg(h - l) OVER {-20}, FALSE)",
    "range_12": "coalesce(n >= 12 AND max(h) OVER {12} - min(l) OVER {12} < 1.5 * avg(tr) OVER {14}, FALSE)",
    "forward_return_48": "CASE WHEN {slot:-48} = slot + 48 THEN round({c:-48} / nullif(c, 0) - 1, 8) END",
    "wash_like": "coalesce(n > 20 AND v > 3 * avg(v) OVER {-20} AND abs((h - l - avg(h - l) OVER {-20}) / nullif(stddev_pop(h - l) OVER {-20}, 0)) < 0.5 AND abs(c - o) / nullif(h - l, 0) < 0.1, FALSE)",
}


def _past(x: str, n: int) -> str:
    """Score of x among the n values before it; 0 where they are all equal."""
    return f"CASE WHEN n > {n} THEN CASE WHEN stddev_pop({x}) OVER {{-{n}}} < 1e-12 THEN 0D ELSE ({x} - avg({x}) OVER {{-{n}}}) / stddev_pop({x}) OVER {{-{n}}} END END"


_VZ, _RZ = _past("v", 50), _past("(h - l)", 50)
_OZ = "CASE WHEN doi IS NOT NULL AND count(doi) OVER {-20} = 20 AND stddev_pop(doi) OVER {-20} >= 1e-12 THEN (doi - avg(doi) OVER {-20}) / stddev_pop(doi) OVER {-20} END"
_SIDE, _PLACE = "signum(c - o)", "CASE WHEN h > l THEN 2 * (c - l) / (h - l) - 1 ELSE 0D END"
PARTICIPATION = {
    "volume_z_prior": f"round({_VZ}, 4)",
    "range_z_prior": f"round({_RZ}, 4)",
    "oi_change_z": f"round({_OZ}, 4)",
    "effort_result": f"round(({_VZ}) * ({_RZ}) * signum(c - {{c:1}}), 6)",
    "accumulation": f"CASE WHEN n > 50 THEN round((0.25D * tanh({_SIDE}) + 0.25D * tanh({_PLACE}) + 0.15D * tanh(({_RZ}) / 2) + 0.2D * tanh(({_VZ}) / 2) + coalesce(0.15D * tanh(({_OZ}) / 2), 0D)) / CASE WHEN ({_OZ}) IS NULL THEN 0.85D ELSE 1D END, 6) END",
    "is_climax": f"coalesce(n > 50 AND v >= 2.5 * avg(v) OVER {{-20}} AND ({_RZ}) >= 2, FALSE)",
    "is_dry": "coalesce(n > 20 AND v <= 0.4 * avg(v) OVER {-20}, FALSE)",
    "effort_without_result": f"coalesce(n > 50 AND ({_VZ}) > 1.5 AND abs({_RZ}) < 0.5, FALSE)",
    "effort_with_result": f"coalesce(n > 50 AND ({_VZ}) > 1.5 AND abs({_RZ}) > 1.5, FALSE)",
    "oi_state": "CASE WHEN oi IS NULL THEN 'MISSING' WHEN count(oi) OVER {5} = 5 AND max(oi) OVER {5} = min(oi) OVER {5} THEN 'STALE' ELSE 'AVAILABLE' END",
    "volume_effort_corr": "CASE WHEN n > 20 AND count(v) OVER {20} = 20 THEN round(covar_pop(v, abs(r)) OVER {20} / nullif(stddev_pop(CASE WHEN r IS NOT NULL THEN v END) OVER {20} * stddev_pop(CASE WHEN v IS NOT NULL THEN abs(r) END) OVER {20}, 0), 6) END",
}

#: Features of a group, and the bars of history and of future that they may look at.
GROUPS = {"candle": (CANDLE, 1, 0), "trailing": (TRAILING, 48, 0), "volatility": (VOLATILITY, 51, 0), "events": (EVENTS, 21, 96), "participation": (PARTICIPATION, 51, 0)}
#: Helper columns some features build on.
DERIVED = {
    "tr": f"CASE WHEN {{c:1}} IS NOT NULL THEN {TR} END",
    "r": "CASE WHEN c > 0 AND {c:1} > 0 THEN ln(c / {c:1}) END",
    "g": "CASE WHEN o > 0 AND {c:1} > 0 THEN ln(o / {c:1}) END",
    "d": "CASE WHEN c > 0 AND o > 0 THEN ln(c / o) END",
    "doi": "oi - {oi:1}",
}


def expand(text: str, partition: str) -> str:
    """The feature's text with its frames written out over ``PARTITION BY partition ORDER BY n``."""
    base = f"PARTITION BY {partition} ORDER BY n"

    def frame(m: re.Match) -> str:
        x = m.group(1)
        if ":" in x:
            col, k = x.split(":")
            return f"lead({col}, {k[1:]}) OVER ({base})" if k[0] == "-" else f"lag({col}, {k}) OVER ({base})"
        if x[0] == "-":
            return f"({base} ROWS BETWEEN {x[1:]} PRECEDING AND 1 PRECEDING)"
        if x[0] == "+":
            return f"({base} ROWS BETWEEN 1 FOLLOWING AND {x[1:]} FOLLOWING)"
        return f"({base} ROWS BETWEEN {int(x) - 1} PRECEDING AND CURRENT ROW)"

    return re.sub(r"\{([^}]+)\}", frame, text)
