"""Attributes as known at event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running_max


def known_at(events: DataFrame, changes: DataFrame, keys: list[str], *, at: str, available: str, rank: list[str], keep: str, bucket: int) -> DataFrame:
    """For each event the change of its entity that ranks highest among those available by then.

    ``events``: keys, ``at`` and ``keep`` (the event's id); ``changes``: keys, ``available`` and the
    ``rank`` columns, compared left to right, nulls lowest. Events and changes are united and walked
    in order of entity and time; at equal times changes come before events, and the best change so
    far is carried forward. A change that becomes available later is never seen.

    Result: keys, ``keep``, ``at`` and the rank columns, null where nothing was known yet. Events or
    changes with a null key or time are left out. Repeated events give repeated rows.
    """
    best = F.struct(*rank)
    left = events.select(*keys, F.col(at).alias("_t"), F.col(keep).alias("_keep"), F.lit(True).alias("_is_event"))
    right = changes.select(*keys, F.col(available).alias("_t"), F.lit(True).alias("_is_change"), best.alias("_best"))
    both = left.unionByName(right, allowMissingColumns=True)
    both = running_max(both, keys, "_t", "_best", "_known", bucket=bucket, strict=False)
    return both.filter("_is_event").select(*keys, F.col("_keep").alias(keep), F.col("_t").alias(at), *[F.col(f"_known.{c}").alias(c) for c in rank])
