"""Studies of replayed trades: walk-forward, bootstrap, deflated Sharpe ratio, overfitting, stress, benchmark."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import normal_cdf, normal_quantile
from tidemark.operators.folds import typed
from tidemark.operators.implausible import numbered
from tidemark.plans.bars import bars, numbered_bars
from tidemark.plans.market import CELL
from tidemark.plans.research import one_at_a_time, replay
from tidemark.sources.tables import materialize, small_side

TRAIN, FOLDS, PATHS, LEVEL = 0.7, 8, 1000, 0.95


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    """Non-overlapping trades with their order in time per timeframe: symbol, timeframe, n, open_ms, r, number."""
    b = numbered_bars(spark, sf)
    t = one_at_a_time(replay(b).select(*CELL, "n", "held", "reason", "r")).join(b.select(*CELL, "n", "open_ms"), [*CELL, "n"])
    t = t.select(*CELL, "n", "open_ms", F.col("r").cast("decimal(18,6)").alias("r")).withColumn("trade", F.concat_ws(":", "symbol", F.col("n").cast("string")))
    # an order over all symbols of a timeframe, counted in spans of 90 days
    return materialize(numbered(t, ["timeframe"], ["open_ms", "symbol"], F.floor(F.col("open_ms") / F.lit(7_776_000_000.0)).cast("long"), {"number": "trade"}).drop("trade"), "trades")


def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe: trades, mean, profit factor and mean to deviation of the first 70 % and of the rest, and whether the rest
    would be taken on (ratio over 1 and profit factor over 1.2)."""
    t = _trades(spark, sf)
    size = t.groupBy("timeframe").agg(F.max("number").alias("size"))
    part = F.when(F.col("number") <= F.floor(F.col("size") * TRAIN), "TRAIN").otherwise("TEST")
    g = t.join(F.broadcast(size), "timeframe").filter("size >= 10").groupBy("timeframe", part.alias("part")).agg(
        F.count("*").alias("trades"), F.sum("r").cast("double").alias("total"), F.stddev_samp(F.col("r").cast("double")).alias("sd"),
        F.sum(F.when(F.col("r") > 0, F.col("r"))).cast("double").alias("up"), F.sum(F.when(F.col("r") < 0, -F.col("r"))).cast("double").alias("down"),
    )
    mean, factor = F.col("total") / F.col("trades"), F.col("up") / F.nullif("down", F.lit(0.0))
    ratio = mean / F.nullif("sd", F.lit(0.0)) * F.sqrt("trades")
    ok = (F.col("part") == "TEST") & F.coalesce(ratio > 1, F.lit(False)) & F.coalesce(factor > 1.2, F.lit(False))
    return g.select("timeframe", "part", "trades", F.round(mean, 6).alias("mean"), F.round(factor, 6).alias("profit_factor"), F.round(ratio, 6).alias("ratio"), ok.alias("is_promoted"))


def bootstrap(spark: SparkSession, sf: str, seed: int = 1) -> DataFrame:
    """Per timeframe: 1,000 resampled totals (mean, deviation, 5 %, median, 95 %) and the mean of the worst 5 % of means.

    Each trade enters each path a Poisson number of times, drawn from its own number; so paths add up
    over tasks in any order and no task holds all trades.
    """
    t = _trades(spark, sf).select("timeframe", "number", F.col("r").cast("double").alias("r"), F.floor(F.col("number") / F.lit(4096.0)).cast("long").alias("chunk"))

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("number")
        sums, counts = np.zeros(PATHS), np.zeros(PATHS)
        for number, r in zip(p["number"], p["r"]):
            k = np.random.default_rng([seed, int(number)]).poisson(1.0, PATHS)
            sums += k * r
            counts += k
        return typed(pd.DataFrame({"timeframe": p["timeframe"].iloc[0], "path": np.arange(PATHS), "total": sums, "trades": counts.astype(int)}), kinds)

    kinds = "timeframe string, path int, total double, trades long"
    g = t.groupBy("timeframe", "chunk").applyInPandas(draw, kinds).groupBy("timeframe", "path").agg(F.sum("total").alias("total"), F.sum("trades").alias("trades"))
    q = F.percentile("total", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    mean = F.col("total") / F.greatest("trades", F.lit(1))
    w = Window.partitionBy("timeframe").orderBy("mean", "path")
    g = g.withColumn("mean", mean).withColumn("place", F.row_number().over(w))
    g = g.groupBy("timeframe").agg(F.avg("total").alias("m"), F.stddev_pop("total").alias("sd"), q.alias("q"), F.avg(F.when(F.col("place") <= int(PATHS * (1 - LEVEL) + 1e-9), F.col("mean"))).alias("tail"))
    return g.select("timeframe", *[F.round(c, 6).alias(n) for c, n in (("m", "mean_total"), ("sd", "deviation"), (F.col("q")[0], "p5"), (F.col("q")[1], "median"), (F.col("q")[2], "p95"), ("tail", "cvar_95"))])


def deflated_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe: mean-to-deviation ratio of the trades, the greatest ratio chance would show among as many cells, and the
    p-value of exceeding it, with skewness and kurtosis."""
    t = _trades(spark, sf).withColumn("r", F.col("r").cast("double"))
    cells = t.groupBy(*CELL).agg((F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("s")).filter("s IS NOT NULL").groupBy("timeframe").agg(F.count("*").alias("cells"), F.var_samp("s").alias("v"))
    g = t.groupBy("timeframe").agg(F.count("*").alias("n"), F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("skew"), (F.kurtosis("r") + 3).alias("kurt")).join(cells, "timeframe").filter("n >= 2 AND sd > 0 AND v > 0")

    def judge(batches):
        for b in batches:
            rows = []
            for r in b.to_dict("records"):
                ratio, k = r["m"] / r["sd"], r["cells"]
                best = 0.0 if k < 2 else math.sqrt(r["v"]) * ((1 - np.euler_gamma) * normal_quantile(1 - 1 / k) + np.euler_gamma * normal_quantile(1 - 1 / (k * math.e)))
                under = 1 - r["skew"] * ratio + (r["kurt"] - 1) / 4 * ratio**2
                z = (ratio - best) * math.sqrt(r["n"] - 1) / math.sqrt(under) if under > 0 else math.nan
                rows.append((r["timeframe"], r["n"], k, round(ratio, 6), round(best, 6), round(1 - normal_cdf(z), 6) if z == z else None))
            yield typed(pd.DataFrame(rows, columns=["timeframe", "trades", "cells", "ratio", "chance_ratio", "p"]), kinds)

    kinds = "timeframe string, trades long, cells long, ratio double, chance_ratio double, p double"
    return g.mapInPandas(judge, kinds)


def overfitting(spark: SparkSession, sf: str) -> DataFrame:
    """Probability that the best symbol of one eighth of the trades ranks in the lower half of another, per timeframe.

    Only folds x symbols sums are compared: one row per fold, symbol and timeframe.
    """
    t = _trades(spark, sf)
    size = t.groupBy("timeframe").agg(F.max("number").alias("size"))
    t = t.join(F.broadcast(size), "timeframe").withColumn("fold", F.floor((F.col("number") - 1) * FOLDS / F.col("size")).cast("int"))
    g = t.groupBy("timeframe", "fold", "symbol").agg(F.sum("r").cast("double").alias("s"))
    best = g.groupBy("timeframe", "fold").agg(F.max_by("symbol", F.struct("s", "symbol")).alias("winner"), F.count("*").alias("k"))
    other = g.withColumnRenamed("fold", "seen")
    own = best.join(other.select("timeframe", "seen", F.col("symbol").alias("winner"), F.col("s").alias("got")), ["timeframe", "winner"]).filter("fold <> seen")
    ranks = own.join(other.select("timeframe", "seen", "s"), ["timeframe", "seen"]).groupBy("timeframe", "fold", "seen").agg((F.count(F.when(F.col("s") <= F.col("got"), 1)) / F.count("*")).alias("rank"))
    return ranks.groupBy("timeframe").agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("rank") <= 0.5, 1.0).otherwise(0.0)), 6).alias("pbo"), F.round(F.avg("rank"), 6).alias("mean_rank"))


#: Transformations of a result under stress.
STRESS = {"CRASH": "-0.5 + 5 * r", "VOLATILITY": "5 * r", "VOLUME": "0.1 * r", "CORRELATION": "3 * r", "FILLS": "r - 0.01 - 0.5 * abs(r)", "TAIL": "least(r, -abs(r) - 0.5)"}


def stress(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe and scenario: total, mean and worst result of the stressed trades."""
    t = _trades(spark, sf)
    pairs = F.array(*[F.struct(F.lit(n).alias("scenario"), F.expr(f"cast({x} AS decimal(20,7))").alias("x")) for n, x in STRESS.items()])
    g = t.select("timeframe", F.explode(pairs).alias("p")).groupBy("timeframe", "p.scenario").agg(F.count("*").alias("trades"), F.sum("p.x").cast("double").alias("total"), F.min("p.x").cast("double").alias("worst"))
    return g.select("timeframe", "scenario", "trades", F.round("total", 6).alias("total"), F.round(F.col("total") / F.col("trades"), 6).alias("mean"), "worst")


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: return of holding from the first open to the last close, and the range it went through."""
    d = bars(spark, sf).groupBy(*CELL).agg(F.min_by("o", "slot").alias("first"), F.max_by("c", "slot").alias("last"), F.max("h").alias("top"), F.min("l").alias("bottom"))
    return d.select(*CELL, F.round(F.col("last") / F.nullif("first", F.lit(0.0)) - 1, 8).alias("held_return"), F.round(F.col("top") / F.nullif("bottom", F.lit(0.0)) - 1, 8).alias("span"))


def shrunken_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: win rate, drawn to its timeframe's by n / (n + 30), and whether Wilson's lower bound of the pool passes a third from 30 trades on."""
    t = _trades(spark, sf)
    cell = t.groupBy(*CELL).agg(F.count("*").alias("n"), F.count(F.when(F.col("r") > 0, 1)).alias("wins"))
    pool = materialize(cell.groupBy("timeframe").agg(F.sum("n").alias("pool_n"), F.sum("wins").alias("pool_wins")), "pools")
    j = cell.join(small_side(pool), "timeframe")
    p, n, z2 = F.col("pool_wins") / F.col("pool_n"), F.col("pool_n"), 1.96**2
    lower = (p + z2 / (2 * n) - 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    weight = F.col("n") / (F.col("n") + 30.0)
    return j.select(*CELL, "n", F.round(F.col("wins") / F.col("n"), 6).alias("rate"), F.round(weight * F.col("wins") / F.col("n") + (1 - weight) * p, 6).alias("shrunken"), F.round(lower, 6).alias("pool_lower"), ((F.col("pool_n") >= 30) & (lower > 1 / 3)).alias("is_eligible"))


QUERIES = {f.__name__: f for f in (walk_forward, bootstrap, deflated_sharpe, overfitting, stress, benchmark, shrunken_rates)}
