"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize

#: A key is heavy from this share of all references on; at most its inverse many keys are.
HEAVY_SHARE = 0.001
HEAVY_LEAST = 1_000


def count_references(child: DataFrame, ref: str, period: Column) -> DataFrame:
    """References per key and period: ref_key, period, n. Null and empty references are none."""
    d = child.select(F.col(ref).alias("ref_key"), period.alias("period"))
    return d.filter(F.col("ref_key").isNotNull() & (F.col("ref_key") != "")).groupBy("ref_key", "period").agg(F.count("*").alias("n"))


def dangling(counts: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """The rows of ``counts`` whose key no row of ``parent`` has, with ``is_heavy``.

    Keys compare exactly, by bytes. ``counts`` is written once; its total gives the weight from which
    a key is heavy, so there are at most ``1 / HEAVY_SHARE`` heavy keys and broadcasting them is
    bounded. They are checked by a broadcast semi-join over the parents, without a shuffle of their
    rows; the remaining keys, none of which is large, meet the distinct parent keys in a shuffled
    anti-join. Both parts are united. An empty parent leaves all references dangling.
    """
    counts = materialize(counts, "refs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    per_key = counts.groupBy("ref_key").agg((F.sum("n") > least).alias("is_heavy"))
    keys = parent.select(F.col(key).alias("ref_key"))
    heavy = per_key.filter("is_heavy")
    present = keys.join(F.broadcast(heavy.select("ref_key")), "ref_key", "left_semi").distinct()
    heavy_gone = heavy.join(F.broadcast(present), "ref_key", "left_anti")
    light_gone = per_key.filter("NOT is_heavy").join(keys.distinct(), "ref_key", "left_anti")
    gone_heavy = counts.join(F.broadcast(heavy_gone), "ref_key")
    gone_light = counts.join(light_gone, "ref_key")
    return gone_heavy.unionByName(gone_light).select("ref_key", "period", "n", "is_heavy")


def dangling_rows(child: DataFrame, child_id: str, ref: str, gone: DataFrame) -> DataFrame:
    """Distinct (child_id, ref_key) of the child rows behind :func:`dangling`'s result."""
    d = child.select(F.col(child_id).alias("child_id"), F.col(ref).alias("ref_key")).distinct()
    keys = gone.select("ref_key", "is_heavy").distinct()
    by_heavy = d.join(F.broadcast(keys.filter("is_heavy").select("ref_key")), "ref_key", "left_semi")
    by_light = d.join(keys.filter("NOT is_heavy").select("ref_key"), "ref_key", "left_semi")
    return by_heavy.unionByName(by_light).select("child_id", "ref_key")
