"""Irregular readings of a cumulative counter onto a regular grid.

Positions are grid coordinates: cell ``k`` of the grid is ``[k, k + 1)``. A fixed timeframe, a week
and a calendar month all become unit cells that way, so shares by overlap need no calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counter_segments(df: DataFrame, keys: list[str], *, start: str, end: str, counter: str, chunk: str) -> DataFrame:
    """Difference consecutive readings of a counter, one segment per reading.

    ``end`` is the grid position at which ``counter`` was read, ``start`` the position from which
    the reading itself vouches (null: from the previous reading). ``chunk`` is a column that grows
    with ``end`` and bounds what one task holds of one key, such as the day.

    Result: keys, from_pos, to_pos, gap_from, increment, is_reset. The increment belongs to
    (from_pos, to_pos]; nothing vouches for [gap_from, from_pos), null where there is no gap. A
    reading below its predecessor is a reset and its whole value is the increment; so is the first
    reading of a key with a ``start``. A null counter adds null and the next difference is taken
    against the last known one. Readings at equal positions are differenced in counter order.
    Rows with a null key or position are left out. Empty in, empty out.

    The reading before a chunk's first one is carried in by a window over one row per chunk. An input
    already partitioned by keys and chunk is not shuffled again.
    """
    d = df.select(*keys, F.col(chunk).alias("_c"), F.col(start).cast("double").alias("_s"), F.col(end).cast("double").alias("_e"), F.col(counter).cast("double").alias("_v"))
    d = d.dropna(subset=[*keys, "_c", "_e"])
    last = d.groupBy(*keys, "_c").agg(F.max("_e").alias("_le"), F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_e"))).alias("_lv"), F.max("_s").alias("_ls"))
    over = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = last.select(*keys, "_c", F.max("_le").over(over).alias("_pe0"), F.last("_lv", ignorenulls=True).over(over).alias("_pv0"), (F.col("_ls") > 0).alias("_t"))
    inside = Window.partitionBy(*keys, "_c").orderBy("_e", "_v")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(carry, [*keys, "_c"], "left").select(
        *keys, "_s", "_e", "_v",
        F.coalesce(F.lag("_e").over(inside), "_pe0").alias("_pe"),
        F.coalesce(F.last("_v", ignorenulls=True).over(before), "_pv0").alias("_pv"),
    )
    begin = F.coalesce(F.greatest("_s", "_pe"), "_pe", "_s")
    reset = F.col("_pv").isNull() & F.col("_s").isNotNull() | (F.col("_v") < F.col("_pv"))
    return d.filter(begin.isNotNull()).select(
        *keys,
        begin.alias("from_pos"),
        F.col("_e").alias("to_pos"),
        F.when(F.col("_pe") < begin, F.col("_pe")).alias("gap_from"),
        F.when(reset, F.col("_v")).otherwise(F.col("_v") - F.col("_pv")).alias("increment"),
        F.coalesce(reset & F.col("_pv").isNotNull(), F.lit(False)).alias("is_reset"),
    )


#: Cells that one row makes at once; longer spans are cut and spread over the tasks first.
SPAN = 4096


def _explode_cells(df: DataFrame, keys: list[str], lo, hi) -> DataFrame:
    """One row per grid cell ``slot`` from ``lo`` to ``hi``, for spans of any length."""
    parts = df.withColumn("_lo", F.explode(F.sequence(lo, hi, F.lit(SPAN).cast("long")))).withColumn("_hi", F.least(hi, F.col("_lo") + SPAN - 1))
    return parts.withColumn("slot", F.explode(F.sequence("_lo", "_hi"))).drop("_lo", "_hi")


def uncovered_cells(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Grid cells that lie wholly in a gap between two readings: keys, slot."""
    lo, hi = F.ceil("gap_from").cast("long"), F.floor("from_pos").cast("long") - 1
    gaps = segments.filter(F.col("gap_from").isNotNull() & (lo <= hi)).select(*keys, lo.alias("_from"), hi.alias("_to"))
    return _explode_cells(gaps, keys, F.col("_from"), F.col("_to")).select(*keys, "slot")


def spread_on_grid(segments: DataFrame, keys: list[str]) -> DataFrame:
    """One row per grid cell between a key's first and last reading.

    Result: keys, slot, amount, coverage, n_resets, status. Each increment is shared among the cells
    its span overlaps, in proportion to the overlap; ``coverage`` is the part of the cell that
    readings vouch for (1 at most); status is ``measured``, or ``lacking`` for a cell no reading
    reaches into (amount null, coverage 0). A segment of no length gives its cell the whole amount.
    """
    span = F.col("to_pos") - F.col("from_pos")
    first = F.floor("from_pos").cast("long")
    share = _explode_cells(segments, keys, first, F.greatest(F.ceil("to_pos").cast("long") - 1, first))
    overlap = F.least("to_pos", F.col("slot") + 1.0) - F.greatest("from_pos", F.col("slot").cast("double"))
    measured = (
        share.select(*keys, "slot", (F.col("increment") * F.when(span > 0, overlap / span).otherwise(1.0)).alias("_a"), overlap.alias("_o"), F.col("is_reset").cast("int").alias("_r"))
        .groupBy(*keys, "slot")
        .agg(F.sum("_a").alias("amount"), F.least(F.sum("_o"), F.lit(1.0)).alias("coverage"), F.sum("_r").alias("n_resets"), F.lit("measured").alias("status"))
    )
    lacking = uncovered_cells(segments, keys).select(*keys, "slot", F.lit(None).cast("double").alias("amount"), F.lit(0.0).alias("coverage"), F.lit(0).cast("long").alias("n_resets"), F.lit("lacking").alias("status"))
    return measured.unionByName(lacking)
