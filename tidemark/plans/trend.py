"""Recursive indicators over a cell's whole history, trend per scale, momentum and its divergences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import hurst_exponent, mann_kendall, trend_slope
from tidemark.functions.structure import trailing
from tidemark.operators.folds import chunk_fold, ema, seeded, wilder
from tidemark.operators.scan import with_halo
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL

#: Bars of the four scales of a trend.
SCALES = {"MICRO": 5, "SHORT": 20, "INTER": 60, "MACRO": 240}
PIVOT, WINDOW = 5, 20


def directional(h: np.ndarray, l: np.ndarray, c: np.ndarray, n: int = 14) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """DI+, DI- and ADX: Wilder averages of the movements over that of the range, then of their contrast.

    NaN until ``n`` movements are known; until ``2n`` the ADX is the mean of the contrasts so far.
    """
    up, down = np.diff(h), -np.diff(l)
    tr = np.maximum(h[1:] - l[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    a, p, m = wilder(tr, n), wilder(plus, n), wilder(minus, n)
    with np.errstate(all="ignore"):
        dp, dm = (np.where(a >= 1e-12, 100 * x / a, np.where(np.isnan(a), np.nan, 0.0)) for x in (p, m))
        dx = np.where(dp + dm > 1e-12, 100 * np.abs(dp - dm) / (dp + dm), np.where(np.isnan(dp), np.nan, 0.0))
    known = dx[n - 1 :]
    adx = np.full(len(dx), np.nan)
    if len(known):
        first = np.cumsum(known[:n]) / np.arange(1, min(n, len(known)) + 1)
        adx[n - 1 : n - 1 + len(first)] = first
        if len(known) > n:
            adx[n - 1 :][n:] = wilder(known, n)[n:]
    return tuple(np.concatenate([[np.nan], x]) if len(h) else x for x in (dp, dm, adx))


def indicator_rows(p: pd.DataFrame) -> pd.DataFrame:
    """Indicators of one run; each is NaN until its own length is reached."""
    h, l, c = (p[k].to_numpy(float) for k in "hlc")  # noqa: E741
    tr = np.maximum(h[1:] - l[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1])))
    move = np.diff(c)
    lead = lambda x: np.concatenate([[np.nan], x]) if len(c) else x
    gain, loss = lead(wilder(np.maximum(move, 0), 14)), lead(wilder(np.maximum(-move, 0), 14))
    with np.errstate(all="ignore"):
        rsi = np.where(loss == 0, 100.0, 100 - 100 / (1 + gain / np.where(loss == 0, 1.0, loss)))
        rsi = np.where(np.isnan(loss), np.nan, rsi)
        neutral = np.where((loss == 0) & (gain == 0), 50.0, rsi)
    macd = ema(c, 12) - ema(c, 26)
    signal = np.full(len(c), np.nan)
    if len(c) > 25:
        signal[25:] = seeded(macd[25:], 9, 0.8)
    dp, dm, adx = directional(h, l, c)
    out = {"ema_20": ema(c, 20), "rma_14": wilder(c, 14), "atr_wilder": lead(wilder(tr, 14)), "macd": macd, "macd_signal": signal, "macd_histogram": macd - signal, "rsi_14": rsi, "rsi_14_neutral": neutral, "di_plus": dp, "di_minus": dm, "adx_14": adx}
    return pd.DataFrame({"n": p["n"], "open_ms": p["open_ms"], **out})


_INDICATORS = ("ema_20", "rma_14", "atr_wilder", "macd", "macd_signal", "macd_histogram", "rsi_14", "rsi_14_neutral", "di_plus", "di_minus", "adx_14")


def indicators(spark: SparkSession, sf: str) -> DataFrame:
    """EMA, RMA, Wilder ATR, MACD with signal and histogram, RSI (flat 100, and flat 50), DI and ADX of every bar."""
    d = numbered_bars(spark, sf).select(*CELL, "n", "open_ms", "h", "l", "c")
    out = chunk_fold(d, CELL, "n", indicator_rows, "open_ms long, " + ", ".join(f"{c} double" for c in _INDICATORS))
    # means of prices fall on ties of the sixth digit; moved off by 1e-9 they round alike however they were added up
    return out.select(*CELL, "open_ms", *[F.when(~F.isnan(c), F.round(F.col(c) + (1e-9 if c in ("ema_20", "rma_14") else 0.0), 6)).alias(c) for c in _INDICATORS])


# ---------------------------------------------------------------- trend


def trend_rows(p: pd.DataFrame, scale: int) -> pd.DataFrame:
    """Direction, strength and quality of the last ``scale`` bars at every bar that has as many."""
    h, l, c = (p[k].to_numpy(float) for k in "hlc")  # noqa: E741
    _, _, adx = directional(h, l, c)
    atr = trailing(np.maximum(h[1:] - l[1:], np.maximum(np.abs(h[1:] - c[:-1]), np.abs(l[1:] - c[:-1]))), 14, lead=1)
    rows = []
    logs = np.log(np.maximum(c, 1e-300))
    for t in range(scale - 1, len(c)):
        y = logs[t - scale + 1 : t + 1]
        slope, error, r2 = trend_slope(y)
        s, _, z = mann_kendall(y, 1e-12)
        place = (c[t] - (h[t - scale + 1 : t + 1].max() + l[t - scale + 1 : t + 1].min()) / 2) / max(atr[t] if atr[t] == atr[t] else np.inf, 1e-12)
        slope_z = slope / max(error, 1e-12)
        hurst = hurst_exponent(c[max(0, t - 127) : t + 1]) if scale >= 60 else math.nan
        score = 0.35 * math.tanh(slope_z / 1.5) + 0.25 * math.tanh(place) + 0.4 * math.tanh(z / 1.96)
        quality = max(0.0, r2) * (adx[t] if adx[t] == adx[t] else 0.0) / 100 * (1.0 if hurst != hurst else min(hurst, 1.2))
        rows.append((p["n"].iloc[t], p["open_ms"].iloc[t], slope_z, r2, s, z, place, adx[t], hurst, 0 if abs(score) < 0.05 else int(np.sign(score)), abs(score), quality))
    return pd.DataFrame(rows, columns=["n", "open_ms", "slope_z", "r2", "mk_s", "mk_z", "position", "adx", "hurst", "direction", "strength", "quality"])


def trend_scales(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar of 1h and coarser and scale (5, 20, 60, 240 bars): Newey-West slope z, R2, Mann-Kendall, position, ADX, Hurst, direction, strength and quality.

    Finer timeframes are left to :func:`trend_last`: a trend of five minutes is read off at its end.
    """
    return _trend(numbered_bars(spark, sf).filter("timeframe IN ('1h', '2h', '4h', '6h', '8h', '12h', '1d', '1w', '1mo')"))


def trend_last(spark: SparkSession, sf: str) -> DataFrame:
    """The trend of every cell at its last bar, per scale, and the bias over the scales that there are."""
    d = numbered_bars(spark, sf)
    top = d.groupBy(*CELL).agg(F.max("n").alias("top"))
    t = _trend(d.join(top, CELL).filter(F.col("n") > F.col("top") - 512).withColumn("n", F.col("n") - F.greatest(F.col("top") - 512, F.lit(0))).drop("top"))
    w = Window.partitionBy(*CELL, "scale").orderBy(F.desc("open_ms"))
    t = t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    bias = F.avg(F.col("direction") * F.col("strength")).over(Window.partitionBy(*CELL))
    alike = F.abs(F.sum("direction").over(Window.partitionBy(*CELL))) == F.count("*").over(Window.partitionBy(*CELL))
    return t.withColumn("bias", F.round(bias, 6)).withColumn("is_aligned", alike)


def _trend(bars: DataFrame) -> DataFrame:
    d = bars.select(*CELL, "n", "open_ms", "h", "l", "c")
    names = ("slope_z", "r2", "mk_z", "position", "adx", "hurst", "strength", "quality")
    parts = None
    for scale, n in SCALES.items():
        rows = chunk_fold(d, CELL, "n", lambda p, n=n: trend_rows(p, n), "open_ms long, slope_z double, r2 double, mk_s long, mk_z double, position double, adx double, hurst double, direction int, strength double, quality double", before=512, chunk=2048)
        rows = rows.select(*CELL, F.lit(scale).alias("scale"), "open_ms", "mk_s", "direction", *[F.when(~F.isnan(c), F.round(c, 6)).alias(c) for c in names])
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


# ---------------------------------------------------------------- momentum


def _score(x: np.ndarray, n: int) -> np.ndarray:
    """Standard score among the last ``n`` values; NaN before, 0 for a flat window."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        dev = w.std(axis=1)
        out[n - 1 :] = np.where(dev < 1e-12, 0.0, (x[n - 1 :] - w.mean(axis=1)) / np.maximum(dev, 1e-12))
    return out


def momentum_rows(p: pd.DataFrame) -> pd.DataFrame:
    """Momentum scores, impulse and exhaustion, and divergences of price from RSI on slopes and pivots."""
    c, v = p["c"].to_numpy(float), np.nan_to_num(p["v"].to_numpy(float))
    n = len(c)
    with np.errstate(all="ignore"):
        rate = np.concatenate([np.full(min(14, n), np.nan), c[14:] / np.where(c[:-14] == 0, np.nan, c[:-14]) - 1]) if n > 14 else np.full(n, np.nan)
    clean = np.nan_to_num(rate)
    score = np.where(np.isnan(rate), np.nan, _score(clean, 50))
    velocity = ema(clean, 14)
    speed = ema(np.nan_to_num(np.concatenate([[0.0], np.diff(np.nan_to_num(velocity))])) if n else clean, 5)
    accel, flow = _score(np.nan_to_num(speed), 50), _score(v, 50)
    flow_before = np.concatenate([[np.nan], flow[:-1]]) if n else flow
    rsi = indicator_rows(p.assign(open_ms=p["open_ms"]))["rsi_14"].to_numpy()
    with np.errstate(invalid="ignore"):
        flag = np.select([
            (score >= 2) & (accel >= 0.5) & (flow > 0), (score <= -2) & (accel <= -0.5) & (flow < 0), (score >= 2) & (accel < -0.5) & (flow < flow_before), (score <= -2) & (accel > 0.5) & (flow > flow_before), np.abs(score) < 0.5,
        ], ["IMPULSE_UP", "IMPULSE_DOWN", "EXHAUSTED_UP", "EXHAUSTED_DOWN", "NEUTRAL"], default="")
    x = np.arange(WINDOW) - (WINDOW - 1) / 2
    slope = lambda y: np.concatenate([np.full(min(WINDOW - 1, n), np.nan), np.lib.stride_tricks.sliding_window_view(y, WINDOW) @ x / (x @ x)]) if n >= WINDOW else np.full(n, np.nan)
    price_slope, rsi_slope = slope(c) / np.where(c == 0, np.nan, c), slope(rsi)
    with np.errstate(invalid="ignore"):
        by_slope = (np.sign(price_slope) * np.sign(rsi_slope) < 0) & (np.abs(price_slope) > 1e-5)
    by_pivot = np.full(n, "", dtype=object)
    for side, name in ((1, ("REGULAR_BEARISH", "HIDDEN_BEARISH")), (-1, ("REGULAR_BULLISH", "HIDDEN_BULLISH"))):
        y = side * (p["h"] if side > 0 else p["l"]).to_numpy(float)
        last = -1
        if n < 2 * PIVOT + 1:
            continue
        near = np.lib.stride_tricks.sliding_window_view(y, 2 * PIVOT + 1).max(axis=1)
        for t in np.flatnonzero(y[PIVOT : n - PIVOT] >= near) + PIVOT:
            if last >= 0 and rsi[t] == rsi[t] and rsi[last] == rsi[last]:
                farther, weaker = y[t] > y[last] + 0.001 * abs(y[last]), side * (rsi[t] - rsi[last]) < -0.5
                nearer, stronger = y[t] < y[last] - 0.001 * abs(y[last]), side * (rsi[t] - rsi[last]) > 0.5
                if farther and weaker:
                    by_pivot[t + PIVOT] = name[0]  # known when the pivot is
                elif nearer and stronger:
                    by_pivot[t + PIVOT] = name[1]
            last = t
    return pd.DataFrame({"n": p["n"], "open_ms": p["open_ms"], "momentum_z": score, "acceleration_z": accel, "volume_z_50": flow, "state": np.where(flag == "", None, flag), "slope_divergence": by_slope, "pivot_divergence": np.where(by_pivot == "", None, by_pivot)})


def momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar: momentum, acceleration and volume scores over 50 bars, state, and divergences from RSI."""
    d = numbered_bars(spark, sf).select(*CELL, "n", "open_ms", "h", "l", "c", "v")
    out = chunk_fold(d, CELL, "n", momentum_rows, "open_ms long, momentum_z double, acceleration_z double, volume_z_50 double, state string, slope_divergence boolean, pivot_divergence string")
    return out.select(*CELL, "open_ms", *[F.when(~F.isnan(c), F.round(c, 6)).alias(c) for c in ("momentum_z", "acceleration_z", "volume_z_50")], "state", "slope_divergence", "pivot_divergence")


def open_interest_z(spark: SparkSession, sf: str) -> DataFrame:
    """Score of the last known open interest among the last 20 known ones, at bars that know it; 0 when flat."""
    d = numbered_bars(spark, sf).filter("oi IS NOT NULL").select(*CELL, F.col("n").alias("bar"), "open_ms", "oi")
    from tidemark.operators.implausible import numbered

    d = numbered(d, CELL, ["bar"], F.floor(F.col("bar") / F.lit(2048.0)).cast("long"), {"n": "oi"})
    d = with_halo(d, CELL, "n", before=20)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n").rowsBetween(-19, 0)
    dev = F.stddev_pop("oi").over(w)
    z = F.when(dev < 1e-12, F.lit(0.0)).otherwise(F.round((F.col("oi") - F.avg("oi").over(w)) / dev, 4))
    return d.withColumn("z", F.when(F.col("n") >= 20, z)).filter("_own = _chunk AND z IS NOT NULL").select(*CELL, "open_ms", F.col("z").alias("oi_z"))


QUERIES = {"indicators": indicators, "trend_scales": trend_scales, "trend_last": trend_last, "momentum": momentum, "open_interest_z": open_interest_z}
