"""Chart patterns per cell and ratio ladders of its last swing leg."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import patterns, structure
from tidemark.operators.folds import chunk_fold
from tidemark.plans.market import CELL
from tidemark.plans.structure import AHEAD, _bars, _rows, _run, swing_points


def chart_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns at the bar whose close completes them: pattern, direction, line, first and last pivot."""
    def fold(p: pd.DataFrame) -> pd.DataFrame:
        b = _run(p)
        rows = patterns.chart_patterns(b, structure.fractal_swings(b))
        return _rows(p, rows, ["pattern", "direction", "line", "first", "last"], ("first", "last"))

    kinds = "open_ms long, pattern string, direction string, line double, first long, last long"
    return chunk_fold(_bars(spark, sf), CELL, "n", fold, kinds, after=AHEAD).drop("n").distinct()


def ratio_ladders(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: retracements, projections and extensions of the leg between its last high and its last low."""
    s = swing_points(spark, sf).filter("state = 'ACTIVE' AND method = 'FRACTAL'")
    last = s.groupBy(*CELL, "kind").agg(F.max(F.struct("open_ms", "price")).alias("x"))
    g = last.groupBy(*CELL).agg(F.max(F.when(F.col("kind") == "HIGH", F.col("x"))).alias("hi"), F.max(F.when(F.col("kind") == "LOW", F.col("x"))).alias("lo")).filter("hi IS NOT NULL AND lo IS NOT NULL AND hi.price > lo.price")
    rises = F.col("lo.open_ms") < F.col("hi.open_ms")
    a, b = F.when(rises, F.col("lo.price")).otherwise(F.col("hi.price")), F.when(rises, F.col("hi.price")).otherwise(F.col("lo.price"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r).alias("ratio")) for k, rs in (("RETRACE", patterns.RETRACE), ("PROJECT", patterns.PROJECT), ("EXTEND", patterns.EXTEND)) for r in rs])
    g = g.select(*CELL, F.when(rises, "UP").otherwise("DOWN").alias("leg"), a.alias("a"), b.alias("b"), F.explode(kinds).alias("k"))
    # a retracement is measured back from the leg's end
    start, end = F.when(F.col("k.kind") == "RETRACE", F.col("b")).otherwise(F.col("a")), F.when(F.col("k.kind") == "RETRACE", F.col("a")).otherwise(F.col("b"))
    price = F.when(F.col("k.kind") == "EXTEND", F.col("b") - F.col("k.ratio") * (F.col("b") - F.col("a"))).otherwise(start + F.col("k.ratio") * (end - start))
    return g.select(*CELL, "leg", "k.kind", "k.ratio", F.round(price, 8).alias("price"))


QUERIES = {f.__name__: f for f in (chart_patterns, ratio_ladders)}
