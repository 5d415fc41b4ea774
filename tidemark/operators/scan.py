"""Running maxima along time that never gather a whole key in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize, small_side


#: Rows of one key and bucket from which its instants are reduced before they are walked.
HEAVY_ROWS = 4_000_000


def running_max(df: DataFrame, keys: list[str], t: str, value: str, out: str, *, bucket: int, strict: bool, heavy: int = HEAVY_ROWS) -> DataFrame:
    """Add ``out``: the greatest ``value`` of the same keys at earlier ``t``.

    ``strict`` leaves out rows at the same ``t``; otherwise they count. ``bucket`` is the span of
    ``t`` that one task may hold of one key. The rows are written once. A first pass reduces each (keys,
    bucket) to its maximum; a window over these few totals carries the maximum of all earlier buckets
    in; a second window runs inside each bucket. A key that holds a third of all rows is thus spread
    over its buckets.

    A bucket of over ``heavy`` rows (a backfill that gave many rows one instant) is not walked row by
    row: it is reduced to its instants, with a map-side pass, the window runs over these, and rows
    meet their instant in a join, whose skew adaptive execution splits.

    Rows with a null key or null ``t`` are left out; null values never win; an empty frame gives an
    empty frame.
    """
    b = "_bucket"
    d = df.dropna(subset=[*keys, t]).withColumn(b, F.floor(F.col(t) / F.lit(float(bucket))).cast("long"))
    d = materialize(d, "walk")
    totals = materialize(d.groupBy(*keys, b).agg(F.max(value).alias("_top"), F.count("*").alias("_n")), "totals")
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, b, "_n", F.max("_top").over(before).alias("_carry"))
    frame = Window.partitionBy(*keys, b).orderBy(t).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    crowded = totals.filter(F.col("_n") > heavy).select(*keys, b)
    if crowded.isEmpty():
        d = d.repartition(*keys, b).withColumn("_local", F.max(value).over(frame))
    else:
        crowded = small_side(materialize(crowded, "crowded"))
        light = d.join(crowded, [*keys, b], "left_anti").repartition(*keys, b).withColumn("_local", F.max(value).over(frame))
        full = d.join(crowded, [*keys, b], "left_semi")
        instants = full.groupBy(*keys, b, t).agg(F.max(value).alias("_v")).withColumn("_local", F.max("_v").over(frame)).drop("_v")
        d = light.unionByName(full.join(instants, [*keys, b, t]).select(*light.columns))
    d = d.join(carry.drop("_n"), [*keys, b], "left")
    return d.withColumn(out, F.greatest("_local", "_carry")).drop(b, "_local", "_carry")


def with_halo(df: DataFrame, keys: list[str], number: str, *, before: int, after: int = 0, chunk: int = 4096) -> DataFrame:
    """Cut each key's rows, numbered from 1 by ``number``, into chunks for bounded windows.

    Adds ``_chunk`` and ``_own``. A chunk also holds copies of the ``before`` rows ahead of it and the
    ``after`` rows behind it (each at most ``chunk``), so any frame within those bounds, partitioned
    by keys and ``_chunk`` and ordered by ``number``, sees what it would see over the whole key. Keep
    the rows with ``_own = _chunk`` afterwards. A key that holds a third of all rows is spread over
    its chunks; each row is copied at most twice.
    """
    n = F.col(number) - 1
    own = F.floor(n / F.lit(float(chunk))).cast("long")
    at = n % chunk
    copies = F.array_compact(F.array(own, F.when((at < after) & (own > 0), own - 1), F.when(at >= chunk - before, own + 1)))
    return df.withColumn("_own", own).withColumn("_chunk", F.explode(copies)).repartition(*keys, "_chunk")


def running_sum(df: DataFrame, keys: list[str], number: str, value: str, out: str, *, chunk: int = 4096) -> DataFrame:
    """Add ``out``: the sum of ``value`` over a key's rows up to this one, rows numbered by ``number``.

    Null values add nothing; rows with a null key or number are left out. As in :func:`running_max`
    a window over one total per chunk carries earlier chunks in.
    """
    d = df.dropna(subset=[*keys, number]).withColumn("_b", F.floor(F.col(number) / F.lit(float(chunk))).cast("long")).repartition(*keys, "_b")
    totals = d.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    carry = totals.select(*keys, "_b", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    inside = F.sum(value).over(Window.partitionBy(*keys, "_b").orderBy(number).rowsBetween(Window.unboundedPreceding, 0))
    zero = F.lit(0)
    return d.withColumn("_in", inside).join(carry, [*keys, "_b"], "left").withColumn(out, F.coalesce("_in", zero) + F.coalesce("_carry", zero)).drop("_b", "_in", "_carry")
