"""Calendar of a bar, time-of-day profiles with Fourier smoothing, rank tests, regimes and turbulence."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.folds import chunk_fold, typed
from tidemark.operators.scan import with_halo
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL

#: Activity windows of the UTC day in hours, their overlap, and the core parts of two of them.
WINDOWS = {"W0": (0.0, 7.0), "W1": (7.0, 12.5), "W2": (12.5, 21.0), "W3": (21.0, 24.0)}
OVERLAP, CORES = (12.5, 16.0), ((7.0, 11.0), (12.5, 16.0))
BINS, HARMONICS = 48, 4


def _hour(at: str):
    return (F.col(at) % 86_400_000) / F.lit(3_600_000.0)


def calendar(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar, at its opening: activity window with phase and progress, overlap, core, bin of the day, type of day."""
    d = numbered_bars(spark, sf).select(*CELL, "open_ms", _hour("open_ms").alias("h"))
    window, lo, hi = (F.coalesce(*[F.when((F.col("h") >= a) & (F.col("h") < b), v) for (n, (a, b)) in WINDOWS.items() for v in [F.lit(x(n, a, b))]]) for x in (lambda n, a, b: n, lambda n, a, b: a, lambda n, a, b: b))
    d = d.select("*", window.alias("window"), lo.alias("lo"), hi.alias("hi"))
    early = ((F.col("window") == "W1") & (F.col("h") < 8)) | ((F.col("window") == "W2") & (F.col("h") < 13))
    late = ((F.col("window") == "W1") & (F.col("h") >= 11.5)) | ((F.col("window") == "W2") & (F.col("h") >= 20.5))
    day = (F.floor(F.col("open_ms") / F.lit(86_400_000.0)) + 3) % 7
    core = F.lit(False)
    for a, b in CORES:
        core = core | ((F.col("h") >= a) & (F.col("h") < b))
    return d.select(
        *CELL, "open_ms", "window", F.when(early, "EARLY").when(late, "LATE").otherwise("MID").alias("phase"), F.round((F.col("h") - F.col("lo")) / (F.col("hi") - F.col("lo")), 6).alias("progress"),
        ((F.col("h") >= OVERLAP[0]) & (F.col("h") < OVERLAP[1])).alias("is_overlap"), core.alias("is_core"), F.floor(F.col("h") * BINS / 24).cast("int").alias("day_bin"),
        F.when(day == 4, "FRIDAY").when(day > 4, "WEEKEND").otherwise("WEEKDAY").alias("day_type"),
    )


def _moves(spark: SparkSession, sf: str) -> DataFrame:
    """Log return of each bar below a day with its bin and window."""
    d = with_halo(numbered_bars(spark, sf).filter("timeframe NOT IN ('1d', '1w', '1mo')"), CELL, "n", before=1)
    before = F.lag("c").over(Window.partitionBy(*CELL, "_chunk").orderBy("n"))
    d = d.withColumn("r", F.when((F.col("c") > 0) & (before > 0), F.log(F.col("c") / before))).filter("_own = _chunk AND r IS NOT NULL")
    h = _hour("open_ms")
    name = F.when(h < 7, "W0").when(h < 12.5, "W1").when(h < 21, "W2").otherwise("W3")
    return d.select(*CELL, "n", "open_ms", "r", F.floor(h * BINS / 24).cast("int").alias("day_bin"), name.alias("window"))


def day_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and half hour of the day: bars, squared return against the cell's mean (within 0.1 and 10, mean 1) and
    its smooth curve of four harmonics, where at least nine bins are known."""
    g = _moves(spark, sf).groupBy(*CELL, "day_bin").agg(F.count("*").alias("bars"), F.sum(F.col("r") * F.col("r")).alias("s"))

    def smooth(p: pd.DataFrame) -> pd.DataFrame:  # at most 48 rows
        p = p.sort_values("day_bin")
        grand = p["s"].sum() / max(int(p["bars"].sum()), 1)
        f = (p["s"] / p["bars"] / max(grand, 1e-12)).clip(0.1, 10).to_numpy(float)
        f = f / f.mean() if p["bars"].sum() >= 10 else np.ones(len(f))
        curve = np.full(len(f), np.nan)
        if len(f) >= 2 * HARMONICS + 1:
            angle = 2 * math.pi * p["day_bin"].to_numpy(float) / BINS
            x = np.stack([np.ones(len(f)), *[fn(k * angle) for k in range(1, HARMONICS + 1) for fn in (np.cos, np.sin)]], axis=1)
            curve = x @ np.linalg.lstsq(x, f, rcond=None)[0]
        return typed(p.assign(factor=np.round(f, 6), curve=np.round(curve, 6)), kinds)

    kinds = "symbol string, timeframe string, day_bin int, bars long, factor double, curve double"
    out = g.groupBy(*CELL).applyInPandas(smooth, kinds)
    return out.withColumn("curve", F.when(~F.isnan("curve"), F.col("curve")))


#: Returns are taken to this much before they are ranked, so that a cell has boundedly many distinct ones.
GRAIN = 1e-6


def window_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: Kruskal-Wallis statistic of the absolute returns over the activity windows, corrected for ties.

    Values are counted by grain before they are ranked, so no cell's bars meet in one task: a window
    over the cell's distinct values gives their mid-ranks.
    """
    d = _moves(spark, sf).select(*CELL, "window", F.round(F.abs("r") / GRAIN).cast("long").alias("v"))
    g = d.groupBy(*CELL, "window", "v").agg(F.count("*").alias("k"))
    per = g.groupBy(*CELL, "v").agg(F.sum("k").alias("t"))
    upto = F.sum("t").over(Window.partitionBy(*CELL).orderBy("v"))
    per = per.withColumn("rank", upto - (F.col("t") - 1) / 2)
    ties = per.groupBy(*CELL).agg(F.sum("t").alias("n"), F.sum((F.pow(F.col("t").cast("double"), F.lit(3.0)) - F.col("t"))).alias("ties"))
    r = g.join(per.select(*CELL, "v", "rank"), [*CELL, "v"]).groupBy(*CELL, "window").agg(F.sum(F.col("k") * F.col("rank")).alias("sum"), F.sum("k").alias("m"))
    h = r.groupBy(*CELL).agg(F.sum(F.col("sum") * F.col("sum") / F.col("m")).alias("q"), F.count("*").alias("groups")).join(ties, CELL)
    n = F.col("n").cast("double")
    raw = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    return h.filter("groups > 1 AND n > 2").select(*CELL, "groups", "n", F.round(F.when(fix > 1e-12, raw / fix).otherwise(0.0), 5).alias("h"))


def opening_momentum(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: slope of the return over the next four bars on the return of the day's first bar, from 20 days on."""
    d = with_halo(_moves(spark, sf), CELL, "n", before=1, after=4)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    day = F.floor(F.col("open_ms") / F.lit(86_400_000.0))
    d = d.withColumn("later", F.sum("r").over(w.rowsBetween(1, 4))).withColumn("k", F.count("r").over(w.rowsBetween(1, 4))).withColumn("is_first", day != F.lag(day).over(w))
    g = d.filter("_own = _chunk AND is_first AND k = 4").groupBy(*CELL).agg(F.count("*").alias("days"), F.regr_slope("later", "r").alias("b"))
    return g.filter("days >= 20").select(*CELL, "days", F.round("b", 6).alias("slope"))


# ---------------------------------------------------------------- regimes

#: Forgetting of means and covariances, regularisation, bars that confirm a state, turbulence alert.
FORGETTING, RIDGE, CONFIRM, ALERT = 0.94, 1e-6, 3, 15.5073
_STATES = ("CALM", "UP", "DOWN", "WILD")


def regime_rows(p: pd.DataFrame) -> pd.DataFrame:
    """Turbulence, filtered state probabilities, their entropy and the state confirmed by three bars.

    Features are return, range and volume, each against its last 50 bars. Turbulence is the squared
    distance from an exponentially weighted mean and covariance of the bars before. A filter over four
    states with sticky transitions weighs normal likelihoods around typical features.
    """
    c, h, l, v = (np.nan_to_num(p[k].to_numpy(float)) for k in ("c", "h", "l", "v"))  # noqa: E741
    n = len(c)
    with np.errstate(all="ignore"):
        r = np.concatenate([[0.0], np.where((c[1:] > 0) & (c[:-1] > 0), np.log(c[1:] / c[:-1]), 0.0)]) if n else c
    x = np.stack([_against_past(y) for y in (np.nan_to_num(r), h - l, v)], axis=1) if n else np.zeros((0, 3))
    typical = np.array([[0, -0.5, -0.3], [0.8, 0.2, 0.2], [-0.8, 0.2, 0.2], [0, 2.0, 1.5]])
    sticky = np.full((4, 4), 0.03) + np.eye(4) * (1 - 4 * 0.03)
    mean, cov, belief = np.zeros(3), np.eye(3), np.full(4, 0.25)
    state, run, last, rows = 0, 0, -1, []
    for k in range(n):
        d = x[k] - mean
        turbulence = float(d @ np.linalg.solve(cov + RIDGE * np.eye(3), d))
        cov = FORGETTING * cov + (1 - FORGETTING) * np.outer(d, d)
        mean = FORGETTING * mean + (1 - FORGETTING) * x[k]
        prior = belief @ sticky
        like = np.exp(-0.5 * np.minimum(((x[k] - typical) ** 2).sum(axis=1), 600))
        belief = prior * like
        belief = belief / belief.sum() if belief.sum() > 1e-300 else prior
        now = int(belief.argmax())
        run, last = (run + 1 if now == last else 1), now
        state = now if run >= CONFIRM else state
        rows.append((turbulence, *belief, float(-(belief * np.log(np.maximum(belief, 1e-300))).sum() / math.log(4)), _STATES[now], _STATES[state]))
    out = pd.DataFrame(rows, columns=["turbulence", "p_calm", "p_up", "p_down", "p_wild", "entropy", "raw_state", "state"])
    return out.assign(n=p["n"].to_numpy(), open_ms=p["open_ms"].to_numpy())


def _against_past(y: np.ndarray, n: int = 50) -> np.ndarray:
    """Standard score against the ``n`` values before; 0 until there are ten."""
    total, square, i = np.concatenate([[0.0], np.cumsum(y)]), np.concatenate([[0.0], np.cumsum(y * y)]), np.arange(len(y))
    lo = np.maximum(i - n, 0)
    k = np.maximum(i - lo, 1)
    mean = (total[i] - total[lo]) / k
    dev = np.sqrt(np.maximum((square[i] - square[lo]) / k - mean**2, 0))
    return np.where((i >= 10) & (dev > 1e-12), np.clip((y - mean) / np.maximum(dev, 1e-12), -8, 8), 0.0)


def regimes(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar: turbulence with its alert, state probabilities, entropy, raw and confirmed state."""
    number = ("turbulence", "p_calm", "p_up", "p_down", "p_wild", "entropy")
    d = numbered_bars(spark, sf).select(*CELL, "n", "open_ms", "c", "h", "l", "v")
    out = chunk_fold(d, CELL, "n", regime_rows, "open_ms long, " + ", ".join(f"{c} double" for c in number) + ", raw_state string, state string")
    return out.select(*CELL, "open_ms", *[F.round(c, 6).alias(c) for c in number], (F.col("turbulence") >= ALERT).alias("is_turbulent"), "raw_state", "state")


def regime_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe and state: how often the state 48 bars later is which, smoothed by 0.1 (contiguous bars only)."""
    d = regimes(spark, sf).join(numbered_bars(spark, sf).select(*CELL, "open_ms", "n", "slot"), [*CELL, "open_ms"])
    d = with_halo(d, CELL, "n", before=0, after=48)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    d = d.withColumn("later", F.when(F.lead("slot", 48).over(w) == F.col("slot") + 48, F.lead("state", 48).over(w))).filter("_own = _chunk AND later IS NOT NULL")
    g = d.groupBy("timeframe", "state", "later").agg(F.count("*").alias("n"))
    return g.select("timeframe", "state", "later", "n", F.round((F.col("n") + 0.1) / (F.sum("n").over(Window.partitionBy("timeframe", "state")) + 0.1 * len(_STATES)), 6).alias("rate"))


QUERIES = {f.__name__: f for f in (calendar, day_profile, window_ranks, opening_momentum, regimes, regime_labels)}
