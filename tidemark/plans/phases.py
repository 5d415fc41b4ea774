"""Range phases, false moves and block sweeps per cell; runs of bars; outcomes, calibration and conflicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import phases
from tidemark.functions.timegrid import length_ms
from tidemark.operators.folds import chunk_fold
from tidemark.operators.scan import with_halo
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL, READING, observations
from tidemark.plans.structure import _bars, _rows, _run, structure_events
from tidemark.sources.tables import materialize, read_table


def phase_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events around ranges with bounds and the likeliest phase."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        d = _rows(p, phases.phase_events(_run(p)), ["event", "lower", "upper", "phase", "probability", "entropy"])
        return d.assign(probability=d["probability"].astype(float).round(6), entropy=d["entropy"].astype(float).round(6))

    return chunk_fold(_bars(spark, sf), CELL, "n", fold, "open_ms long, event string, lower double, upper double, phase string, probability double, entropy double").drop("n")


def range_events(spark: SparkSession, sf: str) -> DataFrame:
    """Tight ranges, false moves and block sweeps."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        b = _run(p)
        d = _rows(p, [*phases.tight_ranges(b), *phases.false_moves(b), *phases.block_sweeps(b)], ["event", "size", "turn"])
        return d.assign(size=d["size"].astype(float).round(6), turn=d["turn"].astype(float).round(6))

    return chunk_fold(_bars(spark, sf), CELL, "n", fold, "open_ms long, event string, size double, turn double").drop("n")


def break_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and direction: breaks, how many were retested and invalidated, and Wilson's bounds of the false ones."""
    e = structure_events(spark, sf).filter("event LIKE 'BREAK%'")
    g = e.groupBy(*CELL, "event").agg(F.count("*").alias("breaks"), F.count(F.when(F.col("outcome") == "RETEST", 1)).alias("retested"), F.count(F.when(F.col("outcome") == "INVALIDATION", 1)).alias("invalidated"))
    z2, n = 1.96**2, F.col("breaks")
    p = F.col("invalidated") / n
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), 1.96 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return g.select(*CELL, "event", "breaks", "retested", "invalidated", F.round(p, 6).alias("false_rate"), F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def contiguous_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of bars without a lacking slot: cell, first and last opening, length.

    A run's number is slot minus bar number, which is constant within it.
    """
    d = numbered_bars(spark, sf).withColumn("run", F.col("slot") - F.col("n"))
    return d.groupBy(*CELL, "run").agg(F.min("open_ms").alias("first_ms"), F.max("open_ms").alias("last_ms"), F.count("*").alias("bars")).drop("run")


def window_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 bars of each cell that were closed and retrieved by the latest snapshot's as_of."""
    at = read_table(spark, sf, "snapshot_pit").agg(F.max(F.unix_millis("as_of")).alias("as_of"))
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot", "close_ms"), values=("close_price",))
    d = d.filter("slot IS NOT NULL AND close_ms IS NOT NULL AND retrieved_ms IS NOT NULL AND close_price IS NOT NULL").join(F.broadcast(at), F.greatest("close_ms", "retrieved_ms") <= F.col("as_of"))
    d = d.groupBy(*CELL, "slot").agg(F.max(F.struct("retrieved_ms", "observation_id", "close_price", "close_ms")).alias("x")).select(*CELL, "slot", "x.close_ms", F.col("x.close_price").alias("c"))
    d = materialize(d, "known")
    # the 50th latest slot of a cell lies within its last buckets of 64; only these are ranked
    per = d.groupBy(*CELL, F.floor(F.col("slot") / F.lit(64.0)).alias("b")).agg(F.count("*").alias("k"))
    after = F.coalesce(F.sum("k").over(Window.partitionBy(*CELL).orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = per.withColumn("after", after).filter("after < 50").select(*CELL, "b")
    d = d.withColumn("b", F.floor(F.col("slot") / F.lit(64.0))).join(kept, [*CELL, "b"], "left_semi")
    return d.withColumn("age", F.row_number().over(Window.partitionBy(*CELL).orderBy(F.desc("slot"))) - 1).filter("age < 50").select(*CELL, "close_ms", "age", "c")


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe and tenth: a forecast that the next bar rises (share of the last 50, drawn to a half by one of each), how often it did, Brier score and log loss."""
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=51, after=1)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    d = d.withColumn("up", (F.col("c") > F.lag("c").over(w)).cast("int"))
    d = d.withColumn("p", (F.sum("up").over(w.rowsBetween(-49, 0)) + 1) / 52.0).withColumn("y", F.lead("up").over(w)).filter("_own = _chunk AND n > 50 AND y IS NOT NULL")
    d = d.withColumn("bin", F.floor(F.col("p") * 10 + 1e-9).cast("int"))
    loss = -F.when(F.col("y") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))
    g = d.groupBy("timeframe", "bin").agg(F.count("*").alias("bars"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("b"), F.avg(loss).alias("l"))
    return g.select("timeframe", "bin", "bars", *[F.round(c, 6).alias(n) for c, n in (("p", "forecast"), ("y", "reached"), ("b", "brier"), ("l", "log_loss"))])


def evidence_conflict(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot: gap between the strongest and weakest confidence, share of events five bars old or more, and engines."""
    e = read_table(spark, sf, "evidence_event").filter("snapshot_id <> '' AND evidence_id IS NOT NULL").groupBy("evidence_id", "snapshot_id", "timeframe").agg(F.min("timestamp_utc").alias("at"), F.max("confidence").alias("confidence"), F.min("engine_id").alias("engine_id"))
    s = read_table(spark, sf, "snapshot_pit").filter("as_of IS NOT NULL").groupBy("snapshot_id").agg(F.min("as_of").alias("as_of"))
    age = (F.unix_millis("as_of") - F.unix_millis("at")) / length_ms(F.col("timeframe"))
    j = e.join(s, "snapshot_id").withColumn("stale", (age >= 5).cast("int"))
    g = j.groupBy("snapshot_id").agg(F.count("*").alias("events"), F.countDistinct("engine_id").alias("engines"), (F.max("confidence") - F.min("confidence")).alias("gap"), F.avg("stale").alias("stale"))
    return g.select("snapshot_id", "events", "engines", F.round("gap", 6).alias("quality_gap"), F.round("stale", 6).alias("stale_share"))


def veto_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How often each veto of the plans' JSON lists applied, per decision; a plan stored twice counts once."""
    d = read_table(spark, sf, "trade_plan").filter("proposal_id IS NOT NULL").groupBy("proposal_id").agg(F.min(F.struct("decision", "vetoes_applied")).alias("x"))
    v = F.explode(F.from_json("x.vetoes_applied", "array<string>"))
    return d.select(F.col("x.decision").alias("decision"), v.alias("veto")).groupBy("decision", "veto").agg(F.count("*").alias("plans"))


def price_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Per bar: candle ratios over a range of at least 1e-9 average true ranges, quarantined where high lies below low."""
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=15)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    pc = F.lag("c").over(w)
    d = d.withColumn("tr", F.when(pc.isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - pc), F.abs(F.col("l") - pc))))
    d = d.withColumn("atr", F.when(F.col("n") > 14, F.avg("tr").over(w.rowsBetween(-13, 0)))).filter("_own = _chunk AND atr IS NOT NULL")
    eps = F.greatest(F.lit(1e-10), 1e-9 * F.col("atr"))
    guard, ok = F.greatest(F.col("h") - F.col("l"), eps), F.col("h") >= F.col("l")
    value = lambda e, k: F.when(ok, F.round(e, k))
    return d.select(
        *CELL, "open_ms", F.when(ok, "VALID").otherwise("QUARANTINED").alias("state"), value(F.abs(F.col("c") - F.col("o")) / guard, 6).alias("body_ratio"), value((F.col("h") - F.greatest("o", "c")) / guard, 6).alias("upper_wick"),
        value((F.least("o", "c") - F.col("l")) / guard, 6).alias("lower_wick"), value((F.col("c") - F.col("l")) / guard, 4).alias("close_position"), value((F.col("h") - F.col("l")) / F.greatest("atr", eps), 4).alias("normalized_range"),
    )


QUERIES = {f.__name__: f for f in (phase_events, range_events, break_outcomes, contiguous_runs, window_as_of, calibration, evidence_conflict, veto_counts, price_contract)}
