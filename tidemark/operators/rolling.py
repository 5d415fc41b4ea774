"""Rolling totals over trailing periods by binary doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_days(daily: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Every day between a key's first and last, with the key's daily rows joined on."""
    span = daily.groupBy(*keys).agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    days = span.select(*keys, F.explode(F.sequence("_lo", "_hi")).alias(day))
    return days.join(daily, [*keys, day], "left")


def trailing_totals(daily: DataFrame, keys: list[str], day: str, values: list[str], windows: tuple[int, ...]) -> DataFrame:
    """Add ``<value>_<w>`` for each window of ``w`` days that ends with the row's day.

    ``daily`` has at most one row per key and day (dates); missing days between a key's first and
    last are added. Null values count as nothing; days before the first count as nothing, so early
    windows are partial. Sums keep the column's type; give decimals at most 37 digits, so that adding
    two keeps their scale.

    Binary doubling: block sums of 1, 2, 4, 8, 16, ... days are built each from two shifted blocks
    of half the length; a window is the sum of the blocks of its binary digits, each shifted past
    the ones before it. A window of w days takes log2(w) additions per row whatever w is, and all
    shifts share one sort per key, whose rows are days of the calendar, not events.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    d = dense_days(daily.select(*keys, day, *values), keys, day)
    kinds = dict(d.dtypes)
    zero = {v: F.lit(0).cast(kinds[v]) for v in values}
    shifted = lambda c, v, n: F.coalesce(F.lag(c, n).over(w), zero[v]) if n else F.col(c)
    block = 1
    d = d.select(*keys, day, *[F.coalesce(v, zero[v]).alias(f"{v}__1") for v in values])
    while block * 2 <= max(windows):
        d = d.select("*", *[(F.col(f"{v}__{block}") + shifted(f"{v}__{block}", v, block)).cast(kinds[v]).alias(f"{v}__{2 * block}") for v in values])
        block *= 2
    out = []
    for n in windows:
        for v in values:
            total, past = zero[v], 0
            for bit in sorted((1 << i for i in range(n.bit_length()) if n >> i & 1), reverse=True):
                total, past = (total + shifted(f"{v}__{bit}", v, past)).cast(kinds[v]), past + bit
            out.append(total.cast(kinds[v]).alias(f"{v}_{n}"))
    return d.select(*keys, day, *out)
