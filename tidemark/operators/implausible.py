"""Implausible spikes, stuck and impossible values, judged per source.

Quantile sketches per source and hour-of-day context are built with map-side merging and rolled up
to the source; fences come from them. Exact quantiles, where needed, are found by narrowing a
bracket that the sketch gives, so that no source's values are ever sorted in one task. Neighbourhood
tests (runs of equal values, centred medians) work on chunks of consecutive values with a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import with_halo
from tidemark.sources.tables import materialize, small_side

#: Sketch size; the rank error is about 0.2 %, far inside the bracket's margin.
SKETCH_K = 2048
MARGIN = 0.02
#: Values of one source that one task may sort to finish an exact quantile.
EXACT_ROWS = 500_000
#: Consecutive values per chunk.
CHUNK = 4096


def source_sketches(values: DataFrame, keys: list[str], value: str, context: Column | None = None) -> DataFrame:
    """One KLL sketch per key and context: keys, context, n, sketch. Null values are skipped."""
    d = values.filter(F.col(value).isNotNull()).select(*keys, (context if context is not None else F.lit(None).cast("int")).alias("context"), F.col(value).cast("double").alias("_v"))
    return d.groupBy(*keys, "context").agg(F.count("*").alias("n"), F.kll_sketch_agg_double("_v", SKETCH_K).alias("sketch"))


def merge_sketches(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge the contexts' sketches to one per key."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("sketch"))


def fences(sketches: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Expanded interquartile fences: keys, n, q1, q3, low, high with low = q1 - factor * (q3 - q1)."""
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p))
    d = sketches.select(*keys, "n", q(0.25).alias("q1"), q(0.75).alias("q3"))
    width = (F.col("q3") - F.col("q1")) * factor
    return d.select("*", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def exact_medians(values: DataFrame, keys: list[str], value: str, sketches: DataFrame) -> DataFrame:
    """Exact median per key: keys, n, median. ``sketches`` has one row per key (keys, n, sketch).

    The sketch brackets the middle ranks; one pass counts the values below and inside the bracket.
    While a bracket holds more than ``EXACT_ROWS`` values it is narrowed by a sketch of its inside.
    Then the distinct values inside are ranked by their counts. A bracket that misses the middle
    (beyond the sketch's error) fails the query instead of giving a wrong median.
    """
    q = lambda p: F.kll_sketch_get_quantile_double("sketch", p)
    bracket = sketches.select(*keys, "n", q(F.lit(0.5 - MARGIN)).alias("lo"), q(F.lit(0.5 + MARGIN)).alias("hi"))
    v = F.col(value)
    for _ in range(12):
        bracket = materialize(bracket, "bracket")
        d = values.filter(v.isNotNull()).select(*keys, v.cast("double").alias("_v")).join(small_side(bracket), keys)
        inside = F.col("_v").between(F.col("lo"), F.col("hi"))
        counted = d.groupBy(*keys, "n", "lo", "hi").agg(F.count(F.when(F.col("_v") < F.col("lo"), 1)).alias("below"), F.count(F.when(inside, 1)).alias("inside"), F.kll_sketch_agg_double(F.when(inside, F.col("_v")), SKETCH_K).alias("sketch"))
        counted = materialize(counted, "counted")
        if (counted.filter("lo < hi").agg(F.max("inside")).first()[0] or 0) <= EXACT_ROWS:
            break
        at = (F.col("n") / 2 - F.col("below")) / F.col("inside")
        big = (F.col("inside") > EXACT_ROWS) & (F.col("lo") < F.col("hi"))
        # ranks must be constants: of a grid of percentiles, the last below and the first above the middle
        grid = F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(k / 100) for k in range(101)]))
        down = F.greatest(F.floor((at - MARGIN) * 100), F.lit(0)).cast("int") + 1
        up = F.least(F.ceil((at + MARGIN) * 100), F.lit(100)).cast("int") + 1
        bracket = counted.withColumn("_g", F.when(big, grid)).select(*keys, "n", F.when(big, F.element_at("_g", down)).otherwise(F.col("lo")).alias("lo"), F.when(big, F.element_at("_g", up)).otherwise(F.col("hi")).alias("hi"))
    stats = counted.select(*keys, "n", "lo", "hi", "below")
    tally = values.filter(v.isNotNull()).select(*keys, v.cast("double").alias("_v")).join(small_side(stats), keys).filter(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "n", "below", "_v").agg(F.count("*").alias("_k"))
    upto = F.col("below") + F.sum("_k").over(Window.partitionBy(*keys).orderBy("_v"))
    ranked = tally.withColumn("_to", upto).withColumn("_from", upto - F.col("_k"))
    middle = lambda rank: F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_to")), F.col("_v")))
    out = ranked.groupBy(*keys, "n").agg(((middle(F.floor((F.col("n") - 1) / 2)) + middle(F.floor(F.col("n") / 2))) / 2).alias("median"))
    return out.select(*keys, "n", F.when(F.col("median").isNull(), F.raise_error(F.lit("the sketch's bracket misses the median")).cast("double")).otherwise(F.col("median")).alias("median"))


def numbered(rows: DataFrame, keys: list[str], order: list[str], block: Column, counted: dict[str, str]) -> DataFrame:
    """Add running counts over a key's rows in ``order`` without gathering a key in one task.

    ``counted`` maps a new column to the column whose non-null values it counts (the current row
    included). ``block`` must not decrease along ``order`` and bounds what one task holds of a key;
    a window over one row per block supplies the counts of earlier blocks.
    """
    d = rows.withColumn("_b", block).repartition(*keys, "_b")
    sizes = d.groupBy(*keys, "_b").agg(*[F.count(c).alias(f"_s_{n}") for n, c in counted.items()], *[F.count(c).alias(f"_t_{i}") for i, c in enumerate(d.columns) if c not in (*keys, "_b")])
    touched = sum((F.col(c) for c in sizes.columns if c.startswith("_t_")), F.lit(0))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", *[F.coalesce(F.sum(F.when(touched >= 0, F.col(f"_s_{n}"))).over(past), F.lit(0)).alias(f"_o_{n}") for n in counted])
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(offsets, [*keys, "_b"]).select(*rows.columns, *[(F.col(f"_o_{n}") + F.count(c).over(inside)).alias(n) for n, c in counted.items()])


def neighbourhoods(rows: DataFrame, keys: list[str], number: str, value: str, *, reach: int, run: int) -> DataFrame:
    """Add ``is_stuck`` and ``local_median`` from the successive values around each row.

    ``number`` counts a key's rows from 1 in order, all values non-null. Rows are cut into chunks of
    consecutive numbers; rows within ``max(reach, run - 1)`` of a border are copied into the chunk
    across it as halo, used there as neighbours and dropped again. ``is_stuck``: the row belongs to
    ``run`` or more successive equal values. ``local_median``: median of the 2 * reach + 1 values
    centred on the row, fewer at a key's ends.
    """
    halo = max(reach, run - 1)
    d = with_halo(rows, keys, number, before=halo, after=halo, chunk=CHUNK)
    w = Window.partitionBy(*keys, "_chunk").orderBy(number)
    back = w.rowsBetween(-(run - 1), 0)
    ends = (F.count(value).over(back) == run) & (F.min(value).over(back) == F.max(value).over(back))
    d = d.withColumn("_ends", ends)
    near = F.sort_array(F.collect_list(value).over(w.rowsBetween(-reach, reach)))
    d = d.withColumn("is_stuck", F.max("_ends").over(w.rowsBetween(0, run - 1))).withColumn("_near", near)
    size = F.size("_near")
    median = (F.element_at("_near", F.floor((size + 1) / 2).cast("int")) + F.element_at("_near", F.floor(size / 2).cast("int") + 1)) / 2
    return d.filter(F.col("_own") == F.col("_chunk")).withColumn("local_median", median).drop("_own", "_chunk", "_ends", "_near")


def flag_by_fences(values: DataFrame, keys: list[str], value: str, order: str, context: Column, *, factor: float, rate: float, number: str | None = None) -> DataFrame:
    """Flag each value against its own source's behaviour in its context.

    Result: keys, ``order``, ``value``, context, is_outside, is_jump, is_flat. Fences are those of
    the context where it has 30 values or more, else those of the whole source. ``is_jump``: the
    value differs from the preceding value of its source by more than ``rate`` times the source's
    normal change, the third quartile of its absolute changes. ``is_flat``: the context's quartiles
    are equal and so is the value (zero variance). Null values are left out.

    ``number`` names the column that counts a key's non-null values from 1 in order; the preceding
    value is met in chunks with a halo. Without it the values are counted along ``order``, a key in
    one task.
    """
    d = values.filter(F.col(value).isNotNull()).withColumn("context", context)
    if number is None:
        number = "_number"
        d = numbered(d, keys, [order], F.lit(0), {number: value})
    d = with_halo(d.select(*keys, order, value, "context", number), keys, number, before=1, chunk=CHUNK)
    before = F.lag(value).over(Window.partitionBy(*keys, "_chunk").orderBy(number))
    d = d.withColumn("_change", F.abs(F.col(value) - before)).filter("_own = _chunk")
    d = materialize(d.select(*keys, order, value, "context", "_change"), "changes")
    by_context = materialize(source_sketches(d, keys, value, F.col("context")), "sketches")
    whole = fences(merge_sketches(by_context, keys), keys, factor).select(*keys, *[F.col(c).alias(f"w_{c}") for c in ("q1", "q3", "low", "high")])
    own = fences(by_context.filter("n >= 30"), [*keys, "context"], factor)
    normal = source_sketches(d, keys, "_change").select(*keys, F.kll_sketch_get_quantile_double("sketch", F.lit(0.75)).alias("normal"))
    both = materialize(by_context.select(*keys, "context").join(own, [*keys, "context"], "left").join(whole, keys).join(normal, keys, "left"), "fences")
    for c in ("q1", "q3", "low", "high"):
        both = both.withColumn(c, F.coalesce(c, f"w_{c}"))
    both = materialize(both.select(*keys, "context", "q1", "q3", "low", "high", "normal"), "fences")
    j = d.join(small_side(both), [*keys, "context"])
    v = F.col(value)
    return j.select(
        *keys, order, value, "context",
        ((v < F.col("low")) | (v > F.col("high"))).alias("is_outside"),
        F.coalesce(F.col("_change") > rate * F.col("normal"), F.lit(False)).alias("is_jump"),
        ((F.col("q1") == F.col("q3")) & (v == F.col("q1"))).alias("is_flat"),
    )
