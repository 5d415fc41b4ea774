"""Market structure per cell: swings, breaks and how they went, gaps, order blocks, liquidity."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import structure
from tidemark.functions.statistics import poisson_tail
from tidemark.functions.timegrid import DAY
from tidemark.operators.folds import chunk_fold, typed
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL

#: Bars after an object by which its life is over: a block's, its breaker's, and a breaker's again.
AHEAD = 512


def _bars(spark: SparkSession, sf: str) -> DataFrame:
    return numbered_bars(spark, sf).select(*CELL, "n", "open_ms", "o", "h", "l", "c", F.coalesce("v", F.lit(0.0)).alias("v"))


def _run(p: pd.DataFrame) -> structure.Bars:
    return structure.Bars(*(p[k].to_numpy(float) for k in "ohlcv"))


def _rows(p: pd.DataFrame, rows: list[dict], columns: list[str], places: tuple[str, ...] = ()) -> pd.DataFrame:
    """Rows with ``at`` as number and opening; ``places`` become openings too, null where there is none."""
    d = pd.DataFrame(rows, columns=["at", *columns])
    opened = p["open_ms"].to_numpy()
    at = d["at"].to_numpy(dtype=int)
    d["n"], d["open_ms"] = p["n"].to_numpy()[at] if len(d) else [], opened[at] if len(d) else []
    for c in places:
        d[c] = [int(opened[int(k)]) if k is not None and k >= 0 else None for k in d[c].fillna(-1)]
        d[c] = d[c].astype("Int64")
    return d


def _swings(b: structure.Bars) -> list[structure.Swing]:
    return structure.merged_swings(b, structure.fractal_swings(b), structure.turn_swings(b))


def swing_points(spark: SparkSession, sf: str) -> DataFrame:
    """Swings of both methods: kind, price, method, depth in average ranges, state, when each was confirmed."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        rows = [{"at": s.at, "kind": s.kind, "price": s.price, "method": s.method, "depth": round(s.depth, 6), "state": s.state, "confirmed_ms": s.confirmed} for s in _swings(_run(p))]
        return _rows(p, rows, ["kind", "price", "method", "depth", "state", "confirmed_ms"], ("confirmed_ms",))

    return chunk_fold(_bars(spark, sf), CELL, "n", fold, "open_ms long, kind string, price double, method string, depth double, state string, confirmed_ms long", after=AHEAD).drop("n")


def structure_events(spark: SparkSession, sf: str) -> DataFrame:
    """Breaks of structure with strength and outcome, changes of character, wick rejections."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        b = _run(p)
        swings = _swings(b)
        broken = structure.breaks(b, swings)
        rows = [*broken, *structure.reversals(b, swings, broken)]
        d = _rows(p, rows, ["event", "level", "rank", "magnitude", "strength", "outcome", "outcome_at"], ("outcome_at",))
        return d.assign(magnitude=d["magnitude"].astype(float).round(6), strength=d["strength"].astype(float).round(6), rank=d["rank"].astype("Int64"))

    return chunk_fold(_bars(spark, sf), CELL, "n", fold, "open_ms long, event string, level double, rank long, magnitude double, strength double, outcome string, outcome_at long", after=AHEAD).drop("n")


def gap_zones(spark: SparkSession, sf: str) -> DataFrame:
    """Fair value gaps with type, salience and life (touched, half filled, filled, ended)."""
    columns = ["direction", "lower", "upper", "kind", "salience", "fate", "depth", "merged", "touched", "mitigated", "filled", "ended"]

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        d = _rows(p, structure.gap_zones(_run(p)), columns, ("touched", "mitigated", "filled", "ended"))
        return d.assign(salience=d["salience"].astype(float).round(6), depth=d["depth"].astype(float).round(6))

    kinds = "open_ms long, direction string, lower double, upper double, kind string, salience double, fate string, depth double, merged int, touched long, mitigated long, filled long, ended long"
    return chunk_fold(_bars(spark, sf), CELL, "n", fold, kinds, after=AHEAD).drop("n")


def order_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Order blocks and breakers with quality, salience and life."""
    columns = ["direction", "lower", "upper", "kind", "quality", "salience", "displacement", "fate", "confirmed", "retested", "mitigated", "ended"]

    def fold(p: pd.DataFrame) -> pd.DataFrame:
        b = _run(p)
        rows = structure.order_blocks(b, structure.breaks(b, _swings(b)), structure.gap_zones(b))
        d = _rows(p, rows, columns, ("confirmed", "retested", "mitigated", "ended"))
        return d.assign(salience=d["salience"].astype(float).round(6), displacement=d["displacement"].astype(float).round(6))

    kinds = "open_ms long, direction string, lower double, upper double, kind string, quality string, salience double, displacement double, fate string, confirmed long, retested long, mitigated long, ended long"
    return chunk_fold(_bars(spark, sf), CELL, "n", fold, kinds, after=AHEAD).drop("n")


def liquidity_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and UTC week: groups of equal swing prices and the density pools they form.

    A group's tolerance is 0.15 of the week's average true range, a pool's radius twice that; ``weight`` is
    the sum over a pool's groups of type score, square root of members and closeness to the middle;
    ``significance`` is the Poisson tail of the group's size against an even spread.
    A week of 1m holds 10,080 bars, which bounds a task.
    """
    d = _bars(spark, sf).withColumn("week", F.floor((F.col("open_ms") + 3 * DAY) / F.lit(7.0 * DAY)).cast("long"))

    def levels(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        b = _run(p)
        out = []
        a = float(np.nanmean(b.tr)) if len(b) > 1 else math.nan
        swings = structure.fractal_swings(b)
        for kind in ("HIGH", "LOW"):
            prices = np.array([s.price for s in swings if s.kind == kind])
            if not len(prices) or not a > 1e-12:
                continue
            groups = structure.equal_levels(prices, 0.15 * a)
            mids = np.array([float(np.median(g)) for g in groups])
            least = max(2, math.ceil(math.log(len(groups) + 1)))
            pools = structure.density_pools(mids, 0.3 * a, least)
            expected = len(prices) * 0.3 * a / max(float(prices.max() - prices.min()), 0.3 * a)
            for g, m, k in zip(groups, mids, pools):
                mates = [(x, y) for x, y, z in zip(mids, groups, pools) if z == k] if k >= 0 else [(m, g)]
                centre = sorted(x for x, _ in mates)[len(mates) // 2]
                weight = sum((0.3 + 0.3 * min(len(y) / 3, 1)) * math.sqrt(len(y)) * math.exp(-abs(x - centre) / (0.3 * a)) for x, y in mates)
                out.append((p["symbol"].iloc[0], p["timeframe"].iloc[0], int(p["week"].iloc[0]), kind, m, len(g), float(g[-1] - g[0]), int(k), round(weight, 6), round(poisson_tail(len(g), expected), 6)))
        return typed(pd.DataFrame(out, columns=[*CELL, "week", "kind", "price", "touches", "diameter", "pool", "weight", "significance"]), kinds)

    kinds = "symbol string, timeframe string, week long, kind string, price double, touches int, diameter double, pool int, weight double, significance double"
    return d.groupBy(*CELL, "week").applyInPandas(levels, kinds)


def order_flow(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and UTC week: volume imbalance over 50 buckets, half spread, jump rate and the chance to move one range in 100 bars."""
    d = _bars(spark, sf).withColumn("week", F.floor((F.col("open_ms") + 3 * DAY) / F.lit(7.0 * DAY)).cast("long"))

    def flow(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("n")
        b = _run(p)
        if len(b) < 3 or b.c.min() <= 0:
            return typed(pd.DataFrame([], columns=[*CELL, "week", "imbalance", "half_spread", "sigma", "jump_rate", "hit_100"]), kinds)
        r = np.diff(np.log(b.c))
        sigma = max(float(r.std()), 1e-12)
        jumps = r[np.abs(r) > 3 * sigma]
        mean, spread = (float(jumps.mean()), max(float(jumps.std()), 1e-12)) if len(jumps) > 1 else (0.0, 0.02)
        share = structure.volume_imbalance(b.c, b.v, max(float(b.v.sum()) / 50, 1e-12))
        hit = structure.hit_probability(float(np.nanmean(b.tr)) / float(b.c[-1]), sigma, 100, len(jumps) / len(r), mean, spread)
        row = (p["symbol"].iloc[0], p["timeframe"].iloc[0], int(p["week"].iloc[0]), *(round(x, 8) for x in (share, share * sigma, sigma, len(jumps) / len(r), hit)))
        return typed(pd.DataFrame([row], columns=[*CELL, "week", "imbalance", "half_spread", "sigma", "jump_rate", "hit_100"]), kinds)

    kinds = "symbol string, timeframe string, week long, imbalance double, half_spread double, sigma double, jump_rate double, hit_100 double"
    return d.groupBy(*CELL, "week").applyInPandas(flow, kinds)


QUERIES = {f.__name__: f for f in (swing_points, structure_events, gap_zones, order_blocks, liquidity_levels, order_flow)}
