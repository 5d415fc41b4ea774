"""Per-period aggregates by event time, corrected as late records arrive, with a cut-off.

Lambda views: a fast layer adds each arriving batch to provisional totals of its periods; a
scheduled batch layer recomputes the periods that are still open from the full log and replaces
them; periods past the cut-off are frozen. :class:`LambdaView` keeps the three on tables, and
:func:`replay_log` drives it over a whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.scan import running_max
from tidemark.sources.tables import materialize

#: Span of arrival that one task holds of one key: at most 2^22 distinct arrival instants.
ARRIVAL_BUCKET = 1 << 22


def with_frontier(records: DataFrame, keys: list[str], *, event: str, arrival: str, bucket: int = ARRIVAL_BUCKET) -> DataFrame:
    """Add ``frontier``: the latest event time among records of the keys that arrived strictly earlier.

    Null for the first arrivals. Records with a null key, event time or arrival are left out.
    """
    d = records.dropna(subset=[event])
    return running_max(d, keys, arrival, event, "frontier", bucket=bucket, strict=True)


def beyond_cutoff(records: DataFrame, keys: list[str], *, event: str, arrival: str, allowed: str, bucket: int = ARRIVAL_BUCKET) -> DataFrame:
    """``records`` with ``is_late``: the event lies more than ``allowed`` behind the frontier."""
    d = with_frontier(records, keys, event=event, arrival=arrival, bucket=bucket)
    return d.withColumn("is_late", F.coalesce(F.col("frontier") - F.col(event) > F.col(allowed), F.lit(False)))


def totals(records: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Mergeable totals per period: n and the sum of each column (null if none is known)."""
    return records.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in sums])


def merge_totals(views: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Add up totals of the same period."""
    return views.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])


class LambdaView:
    """Totals per key and period under late arrival.

    ``frozen`` and ``provisional`` are tables of totals; ``log`` holds all accepted records of periods
    that are not frozen. Each call writes its tables and returns a new view, so that no lineage grows
    and a lost executor costs one step; nothing is collected.
    """

    def __init__(self, frozen: DataFrame, provisional: DataFrame, log: DataFrame, *, by: list[str], sums: list[str]) -> None:
        self.frozen, self.provisional, self.log, self.by, self.sums = frozen, provisional, log, by, sums

    @classmethod
    def empty(cls, like: DataFrame, *, by: list[str], sums: list[str]) -> LambdaView:
        none = totals(like.limit(0), by, sums)
        return cls(none, none, like.limit(0), by=by, sums=sums)

    def fast(self, batch: DataFrame) -> LambdaView:
        """Fast layer: a batch of accepted records increments the provisional periods.

        Frozen periods are closed: records of theirs are left out.
        """
        batch = batch.join(self.frozen.select(*self.by), self.by, "left_anti").select(*self.log.columns)
        more = self.provisional.unionByName(totals(batch, self.by, self.sums))
        return LambdaView(self.frozen, materialize(merge_totals(more, self.by, self.sums), "fast"), self.log.unionByName(batch), by=self.by, sums=self.sums)

    def recompute(self, closed: DataFrame) -> LambdaView:
        """Batch layer: recompute all open periods from the log, replace the provisional ones and
        freeze those in ``closed`` (a frame of the period columns)."""
        fresh = materialize(totals(self.log, self.by, self.sums), "fresh")
        frozen = materialize(self.frozen.unionByName(fresh.join(closed, self.by, "left_semi")), "frozen")
        log = materialize(self.log.join(closed, self.by, "left_anti"), "log")
        return LambdaView(frozen, fresh.join(closed, self.by, "left_anti"), log, by=self.by, sums=self.sums)

    def view(self) -> DataFrame:
        """All periods with ``state`` frozen or provisional."""
        return self.frozen.withColumn("state", F.lit("frozen")).unionByName(self.provisional.withColumn("state", F.lit("provisional")))


def split_log(records: DataFrame, keys: list[str], *, event: str, arrival: str, allowed: str, bucket: int = ARRIVAL_BUCKET) -> tuple[DataFrame, DataFrame]:
    """The log's accepted records and those beyond the cut-off, which no view takes in."""
    d = beyond_cutoff(records, keys, event=event, arrival=arrival, allowed=allowed, bucket=bucket)
    return d.filter("NOT is_late").drop("is_late"), d.filter("is_late").drop("is_late")


def replay_log(records: DataFrame, keys: list[str], *, event: str, arrival: str, allowed: str, period: str, period_end: str, sums: list[str], batches: int = 3, bucket: int = ARRIVAL_BUCKET) -> DataFrame:
    """Run a log through a :class:`LambdaView` in ``batches`` of arrival: keys, period, n, sums, n_late, state.

    Each batch goes through the fast layer; then the open periods are recomputed and those frozen
    whose end lies more than ``allowed`` behind the key's latest event so far. The result does not depend
    on the number of batches: a record that comes for a frozen period is beyond the cut-off by then.
    Records beyond the cut-off count in ``n_late`` only; a period that has no others gets n = 0.
    """
    by = [*keys, period]
    d = materialize(beyond_cutoff(records, keys, event=event, arrival=arrival, allowed=allowed, bucket=bucket), "judged")
    lo, hi = d.agg(F.min(arrival), F.max(arrival)).first()
    view = LambdaView.empty(d, by=by, sums=sums)
    ends = lambda rows: rows.groupBy(*by).agg(F.max(period_end).alias("_end"), F.max(allowed).alias("_allowed"))
    latest = lambda rows: rows.groupBy(*keys).agg(F.max(event).alias("_latest"))
    overdue = F.col("_latest") - F.col("_end") > F.col("_allowed")
    for k in range(batches if lo is not None else 0):
        since, until = lo + (hi - lo) * k // batches, lo + (hi - lo) * (k + 1) // batches
        view = view.fast(d.filter((F.col(arrival) > since) if k else F.lit(True)).filter((F.col(arrival) <= until) & ~F.col("is_late")))
        closed = ends(view.log).join(latest(d.filter(F.col(arrival) <= until)), keys).filter(overdue).select(*by)
        view = view.recompute(closed)
    late = d.filter("is_late")
    late = late.groupBy(*by).agg(F.count("*").alias("n_late"), F.max(period_end).alias("_end"), F.max(allowed).alias("_allowed")).join(latest(d), keys)
    late = late.select(*by, "n_late", F.when(overdue, "frozen").otherwise("provisional").alias("_state"))
    zero = F.lit(0).cast("long")
    out = view.view().join(late, by, "full")
    return out.select(*by, F.coalesce("n", zero).alias("n"), *sums, F.coalesce("n_late", zero).alias("n_late"), F.coalesce("state", "_state").alias("state"))
