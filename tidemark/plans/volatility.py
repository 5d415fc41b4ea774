"""Volatility of each cell: recursive state per bar, GARCH refits, HAR regression, clustering and direction tests."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import chi2_tail
from tidemark.functions.statistics import garch_fits as fit_windows
from tidemark.functions.timegrid import DAY, length_ms
from tidemark.operators.folds import chunk_fold, linear_recursion, wilder
from tidemark.operators.scan import with_halo
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL
from tidemark.sources.tables import materialize, small_side

HV, LAMBDA, REGIME_DAYS, REFIT, FIT_ON, LEAST_FIT = 30, 0.94, 180, 20, 200, 100
#: Quantiles of earlier volatility that separate the regimes, and their names.
QUANTILES, REGIMES = (15, 35, 75, 95), ("VERY_LOW", "LOW", "NORMAL", "ELEVATED", "EXTREME")
WINSOR, CLUSTER = 10.0, 200


def winsorised(tr: np.ndarray) -> np.ndarray:
    """True ranges in which one over ten times the median of the 20 before it gives way to their 99th percentile.

    The window holds ranges already treated; under five of them nothing is treated.
    """
    out = tr.astype(float).copy()
    for i in range(5, len(out)):
        window = out[max(0, i - 20) : i]
        middle = np.partition(window, len(window) // 2)[len(window) // 2]
        if out[i] > WINSOR * max(middle, 1e-12):
            both = np.sort(np.append(window, out[i]))
            out[i] = both[max(0, math.ceil(0.99 * len(both)) - 1)]
    return out


def regimes(hv: np.ndarray, window: int) -> np.ndarray:
    """Regime of each value among the ``window`` values before it; NORMAL until there are more of them."""
    return ranked(hv, window)[0]


def ranked(hv: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`regimes`, and each value's mid-rank among the up to ``window`` before it, NaN under 50 of these."""
    held: list[float] = []
    out, rank = np.full(len(hv), 2, dtype=np.int64), np.full(len(hv), np.nan)
    for i, x in enumerate(hv):
        if i > window:
            cuts = []
            for q in QUANTILES:
                at = q / 100 * (window - 1)
                lo = int(at)
                cuts.append(held[lo] + (held[min(lo + 1, window - 1)] - held[lo]) * (at - lo))
            out[i] = sum(x >= c for c in cuts)
        if len(held) >= 50:
            rank[i] = (bisect_left(held, x) + bisect_right(held, x)) / 2 / len(held)
        insort(held, x)
        if len(held) > window:
            del held[bisect_left(held, hv[i - window])]
    return out, rank


def squeezes(vr: np.ndarray, bw: np.ndarray) -> np.ndarray:
    """Hysteresis: on after three tight bars in a row (ratio under 0.7, width under 0.12), off over 0.8 or 0.15."""
    on, streak, out = False, 0, np.zeros(len(vr), dtype=bool)
    for i, (a, b) in enumerate(zip(vr, bw)):
        streak = streak + 1 if a < 0.7 and b < 0.12 else 0
        if on and (a > 0.8 or b > 0.15):
            on = False
        elif not on and streak >= 3:
            on = True
        out[i] = on
    return out


def _rolling(x: np.ndarray, n: int, fn) -> np.ndarray:
    """``fn`` over axis 1 of the last ``n`` values of each row; NaN before there are as many."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = fn(np.lib.stride_tricks.sliding_window_view(x, n), axis=1)
    return out


def bar_state(p: pd.DataFrame) -> pd.DataFrame:
    """Volatility columns of one run of bars (n, o, h, l, c, len_ms), bars with high below low as they are."""
    h, l, c = (p[k].to_numpy(float) for k in "hlc")  # noqa: E741
    before = np.concatenate([[np.nan], c[:-1]])
    tr = np.fmax(h - l, np.fmax(np.abs(h - before), np.abs(l - before)))
    tr = winsorised(tr)
    short, long = wilder(tr, 14), wilder(tr, 50)
    with np.errstate(all="ignore"):
        vr = np.where(long >= 1e-12, short / long, np.nan)
        mean, dev = _rolling(c, 20, np.mean), _rolling(c, 20, np.std)
        bw = 4 * dev / np.maximum(mean, 1e-12)
        span = h - l
        prior_mean, prior_dev = (np.concatenate([[np.nan], _rolling(span, 20, f)[:-1]]) for f in (np.mean, np.std))
        rz = (span - prior_mean) / np.maximum(prior_dev, 1e-12)
        r = np.where((c > 0) & (before > 0), np.log(c / before), 0.0)
    sq = r * r
    sq[0] = 0.0
    total = np.concatenate([[0.0], np.cumsum(sq)])
    rv = total[1:] - total[np.maximum(np.arange(1, len(sq) + 1) - HV, 0)]
    # sums of a window of squares, not their mean, as the annualised figure is defined on them
    hv = np.sqrt(np.maximum(rv, 0) * 365.0 * DAY / p["len_ms"].to_numpy(float))
    ewma = np.full(len(sq), np.nan)
    if len(sq) > 1:
        ewma[1] = sq[1]
        ewma[2:] = linear_recursion(sq[2:], LAMBDA, 1 - LAMBDA, sq[1])
    window = max(30, round(REGIME_DAYS * DAY / float(p["len_ms"].iloc[0])))
    kind, rank = ranked(hv[1:], window)
    regime, rank = (np.concatenate([[a], b]) if len(hv) else b for a, b in ((2, kind), (np.nan, rank)))
    tight = (vr <= 0.75) & (bw <= 0.12) & (rz <= -0.5)
    return pd.DataFrame({
        "n": p["n"], "tr_winsorised": tr, "atr_14": short, "atr_50": long, "volatility_ratio": vr, "bollinger_width": bw, "range_z": rz, "hv_30": np.where(np.arange(len(hv)) > 0, hv, np.nan),
        "ewma_vol": np.sqrt(ewma), "hv_rank": rank, "regime": np.array(REGIMES, dtype=object)[regime], "is_tight": tight, "in_squeeze": squeezes(vr, bw), "is_extreme": rz >= 3.5,
    })


_STATE = "tr_winsorised double, atr_14 double, atr_50 double, volatility_ratio double, bollinger_width double, range_z double, hv_30 double, ewma_vol double, hv_rank double, regime string, is_tight boolean, in_squeeze boolean, is_extreme boolean"
#: Bars of a chunk: twice the longest regime window, that of 1m.
SPAN = 1 << 19


def states(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar: winsorised true range, Wilder averages, ratio, band width, range z, volatilities, regime and squeeze.

    A window of 180 days is 259,200 bars of 1m; chunks are twice that and start that much earlier.
    """
    d = numbered_bars(spark, sf).withColumn("len_ms", length_ms(F.col("timeframe")))
    d = d.select(*CELL, "n", "open_ms", "o", "h", "l", "c", "len_ms")
    out = chunk_fold(d, CELL, "n", lambda p: bar_state(p).assign(open_ms=p["open_ms"].to_numpy()), "open_ms long, " + _STATE, before=SPAN // 2, chunk=SPAN)
    number = ("tr_winsorised", "atr_14", "atr_50", "volatility_ratio", "bollinger_width", "range_z", "hv_30", "ewma_vol", "hv_rank")
    clean = [F.when(~F.isnan(c), F.round(c, 8)).alias(c) for c in number]
    return out.select(*CELL, "open_ms", *clean, "regime", "is_tight", "in_squeeze", "is_extreme")


def regime_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and regime: bars, changes up and down into it, and how often it persists ((same + 1) / (left + 2))."""
    d = with_halo(numbered_bars(spark, sf).select(*CELL, "open_ms", "n").join(states(spark, sf).select(*CELL, "open_ms", "regime"), [*CELL, "open_ms"]), CELL, "n", before=1)
    rank = F.array_position(F.array(*[F.lit(r) for r in REGIMES]), F.col("regime"))
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    d = d.withColumn("rank", rank).withColumn("was", F.lag("rank").over(w)).withColumn("then", F.lag("regime").over(w)).filter("_own = _chunk")
    into = d.groupBy(*CELL, "regime").agg(F.count("*").alias("bars"), F.count(F.when(F.col("rank") > F.col("was"), 1)).alias("ups"), F.count(F.when(F.col("rank") < F.col("was"), 1)).alias("downs"))
    left = d.filter("then IS NOT NULL").groupBy(*CELL, F.col("then").alias("regime")).agg(F.count("*").alias("left"), F.count(F.when(F.col("then") == F.col("regime"), 1)).alias("same"))
    j = into.join(left, [*CELL, "regime"], "left").fillna(0, ["left", "same"])
    return j.select(*CELL, "regime", "bars", "ups", "downs", F.round(F.when(F.col("left") > 0, (F.col("same") + 1) / (F.col("left") + 2)).otherwise(0.5), 6).alias("persistence"))


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    """Log returns per cell, numbered from 1: symbol, timeframe, n, open_ms, r."""
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=1)
    before = F.lag("c").over(Window.partitionBy(*CELL, "_chunk").orderBy("n"))
    d = d.withColumn("r", F.when((F.col("c") > 0) & (before > 0), F.log(F.col("c") / before)).otherwise(F.lit(0.0)))
    return d.filter("_own = _chunk AND n > 1").select(*CELL, (F.col("n") - 1).alias("n"), "open_ms", "r")


def garch_fits(spark: SparkSession, sf: str) -> DataFrame:
    """GARCH(1,1) of the last 200 returns at every 20th bar, from 100 returns on: omega, alpha, beta, long_var, cost.

    Refits are apart from one another, so each is a row that carries its window; a task fits many.
    """
    d = with_halo(_returns(spark, sf), CELL, "n", before=FIT_ON)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n").rowsBetween(-(FIT_ON - 1), 0)
    d = d.withColumn("window", F.when((F.col("n") + 1) % REFIT == 0, F.collect_list("r").over(w))).filter(f"_own = _chunk AND (n + 1) % {REFIT} = 0 AND n >= {LEAST_FIT}")
    d = d.select(*CELL, "open_ms", "window").repartition(*CELL, "open_ms")

    def fit(batches):
        for b in batches:
            fits = [f or (math.nan,) * 4 for f in fit_windows([np.asarray(x, dtype=float) for x in b["window"]], LEAST_FIT)]
            out = pd.DataFrame(fits, columns=["omega", "alpha", "beta", "cost"])
            out["long_var"] = out["omega"] / (1 - out["alpha"] - out["beta"])
            yield pd.concat([b[[*CELL, "open_ms"]].reset_index(drop=True), out], axis=1)

    return d.mapInPandas(fit, "symbol string, timeframe string, open_ms long, omega double, alpha double, beta double, cost double, long_var double")


def har_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: the next squared return on the last, the mean of 5 and of 22, with Newey-West errors (lag 5).

    Normal equations and the lagged products of the residuals are sums over bars, taken chunk by
    chunk and added up; only sums of a cell meet in one task.
    """
    lag = 5
    d = with_halo(_returns(spark, sf).select(*CELL, "n", F.pow("r", F.lit(2.0)).alias("v")), CELL, "n", before=22 + lag, after=1)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    mean = lambda k: F.avg("v").over(w.rowsBetween(-(k - 1), 0))
    d = d.select(*CELL, "n", "_own", "_chunk", F.lit(1.0).alias("x0"), F.col("v").alias("x1"), mean(5).alias("x2"), mean(22).alias("x3"), F.lead("v").over(w).alias("y"))
    d = materialize(d.filter("n > 22 AND y IS NOT NULL"), "har")
    names = [f"x{i}" for i in range(4)]
    own = d.filter("_own = _chunk")
    gram = own.groupBy(*CELL).agg(F.count("*").alias("rows"), *[F.sum(F.col(a) * F.col(b)).alias(f"g_{a}{b}") for i, a in enumerate(names) for b in names[i:]], *[F.sum(F.col(a) * F.col("y")).alias(f"b_{a}") for a in names])

    def solve(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                g = np.array([[r.get(f"g_{a}{c}", r.get(f"g_{c}{a}")) for c in names] for a in names])
                ok = r["rows"] >= lag + 5 and np.linalg.matrix_rank(g, tol=1e-18) == 4
                beta = np.linalg.solve(g, [r[f"b_{a}"] for a in names]) if ok else np.full(4, np.nan)
                inverse = np.linalg.inv(g).ravel() if ok else np.full(16, np.nan)
                rows.append((r["symbol"], r["timeframe"], r["rows"], list(beta), list(inverse)))
            yield pd.DataFrame(rows, columns=[*CELL, "rows", "beta", "inverse"])

    fits = materialize(gram.mapInPandas(solve, "symbol string, timeframe string, rows long, beta array<double>, inverse array<double>"), "betas")
    fitted = F.expr("x0 * beta[0] + x1 * beta[1] + x2 * beta[2] + x3 * beta[3]")
    u = d.join(small_side(fits), CELL).withColumn("u", F.col("y") - fitted)
    back = lambda c, k: F.lag(c, k).over(w) if k else F.col(c)
    u = u.select(*CELL, "n", "_own", "_chunk", *[(F.col(a) * F.col("u")).alias(f"u{i}") for i, a in enumerate(names)])
    products = [(k, i, j) for k in range(lag + 1) for i in range(4) for j in range(4)]
    u = u.select(*CELL, "_own", "_chunk", *[(F.col(f"u{i}") * back(f"u{j}", k)).alias(f"p_{k}_{i}_{j}") for k, i, j in products]).filter("_own = _chunk")
    sums = u.groupBy(*CELL).agg(*[F.sum(f"p_{k}_{i}_{j}").alias(f"p_{k}_{i}_{j}") for k, i, j in products])

    def errors(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                inverse, meat = np.array(r["inverse"], dtype=float).reshape(4, 4), np.zeros((4, 4))
                for k in range(lag + 1):
                    g = np.array([[r[f"p_{k}_{i}_{j}"] or 0.0 for j in range(4)] for i in range(4)])
                    meat += g if not k else (1 - k / (lag + 1)) * (g + g.T)
                se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
                rows.append((r["symbol"], r["timeframe"], r["rows"], *r["beta"], *se))
            yield pd.DataFrame(rows, columns=[*CELL, "rows", "b0", "b_day", "b_5", "b_22", "se0", "se_day", "se_5", "se_22"])

    return fits.filter("NOT isnan(beta[0])").join(sums, CELL).mapInPandas(errors, "symbol string, timeframe string, rows long, b0 double, b_day double, b_5 double, b_22 double, se0 double, se_day double, se_5 double, se_22 double")


def clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: Ljung-Box statistic of squared returns at lag 20 with its p-value.

    The autocovariances are sums of lagged products, over chunks with a halo of 20.
    """
    m = 20
    d = with_halo(_returns(spark, sf).select(*CELL, "n", F.pow("r", F.lit(2.0)).alias("v")), CELL, "n", before=m)
    means = materialize(d.filter("_own = _chunk").groupBy(*CELL).agg(F.count("*").alias("rows"), F.avg("v").alias("mean")), "means")
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    d = d.join(small_side(means), CELL).withColumn("v", F.col("v") - F.col("mean"))
    d = d.select(*CELL, "rows", "_own", "_chunk", "v", *[(F.col("v") * F.lag("v", k).over(w)).alias(f"p{k}") for k in range(1, m + 1)]).filter("_own = _chunk")
    g = d.groupBy(*CELL, "rows").agg(F.sum(F.col("v") * F.col("v")).alias("total"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(1, m + 1)])
    q = F.col("rows") * (F.col("rows") + 2) * sum((F.pow(F.col(f"p{k}") / F.nullif("total", F.lit(0.0)), F.lit(2.0)) / (F.col("rows") - k) for k in range(1, m + 1)), F.lit(0.0))
    g = g.filter(F.col("rows") > m + 1).select(*CELL, "rows", F.when(F.col("total") >= 1e-12, q).otherwise(F.lit(0.0)).alias("q"))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi2_tail(v, m))

    return g.select(*CELL, "rows", F.round("q", 6).alias("q"), F.round(tail("q"), 6).alias("p"))


def direction_test(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: correlation of the next return with the smoothed volatility, t, p and Fisher bounds.

    From sums over bars; the exponential smoothing restarts ahead of each chunk.
    """
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        r = p["r"].to_numpy(float)
        sigma = np.sqrt(np.concatenate([[r[0] ** 2], linear_recursion(r[1:] ** 2, LAMBDA, 1 - LAMBDA, r[0] ** 2)]))
        return pd.DataFrame({"n": p["n"], "x": np.append(r[1:], np.nan), "s": sigma})

    d = chunk_fold(_returns(spark, sf), CELL, "n", fold, "x double, s double", after=1).filter("NOT isnan(x)")
    g = d.groupBy(*CELL).agg(F.count("*").alias("rows"), F.corr("x", "s").alias("r")).filter("rows >= 30")

    @F.pandas_udf("struct<t double, p double, low double, high double>")
    def judge(r: pd.Series, n: pd.Series) -> pd.DataFrame:
        from tidemark.functions.statistics import t_tails

        out = []
        for a, k in zip(r.fillna(0.0).clip(-1 + 1e-12, 1 - 1e-12), n):
            t = a * math.sqrt((k - 2) / max(1 - a * a, 1e-12))
            z, half = math.atanh(a), 1.96 / math.sqrt(k - 3)
            out.append((t, t_tails(t, k - 2), math.tanh(z - half), math.tanh(z + half)))
        return pd.DataFrame(out, columns=["t", "p", "low", "high"])

    g = g.withColumn("x", judge("r", "rows"))
    return g.select(*CELL, "rows", F.round("r", 6).alias("r"), *[F.round(f"x.{c}", 6).alias(c) for c in ("t", "p", "low", "high")])


QUERIES = {"volatility_states": states, "volatility_regimes": regime_changes, "garch_fits": garch_fits, "har_regression": har_regression, "volatility_clustering": clustering, "direction_test": direction_test}
