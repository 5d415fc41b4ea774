"""Views of market_observation that several queries start from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timegrid import LENGTH_MS, instant_ms, number, row_slot

CELL = ["symbol", "timeframe"]
READING = ("CLOSED", "CORRECTED")
KNOWN = ("CLOSED", "CORRECTED", "SUPERSEDED")
FAR = 2**62


def observations(df: DataFrame, *, status: tuple[str, ...] | None = None, values: tuple[str, ...] = (), times: tuple[str, ...] = ("open_ms", "close_ms")) -> DataFrame:
    """market_observation with equal ids counted once, at their earliest retrieved_at.

    Gives observation_id, symbol, timeframe, retrieved_ms, the asked ``times`` (open_ms, close_ms,
    slot) and the asked ``values`` as doubles. An id is counted within its cell. Rows without a
    symbol or of an unknown timeframe lie on no grid and are left out, as are rows without an id;
    an unknown retrieved_at is later than any known one and comes out null.

    The payload is fixed-width, so the reduction is a hash aggregation with a map-side pass: a
    record delivered a million times reaches the shuffle once per task.
    """
    if status:
        df = df.filter(F.col("candle_status").isin(*status))
    df = df.filter(F.col("symbol").isNotNull() & F.col("timeframe").isin(*LENGTH_MS) & F.col("observation_id").isNotNull())
    wanted: dict[str, F.Column] = {}
    open_ms, close_ms = instant_ms(F.col("open_time")), instant_ms(F.col("close_time"))
    if "open_ms" in times:
        wanted["open_ms"] = open_ms
    if "close_ms" in times:
        wanted["close_ms"] = close_ms
    if "slot" in times:
        wanted["slot"] = row_slot(F.col("timeframe"), open_ms, close_ms)
    for v in values:
        wanted[v] = number(F.col(v))
    rows = df.select("observation_id", *CELL, F.coalesce(instant_ms(F.col("retrieved_at")), F.lit(FAR)).alias("_at"), *[e.alias(n) for n, e in wanted.items()])
    once = rows.groupBy("observation_id", *CELL).agg(F.min("_at").alias("retrieved_ms"), *[F.min_by(n, "_at").alias(n) for n in wanted])
    return once.withColumn("retrieved_ms", F.when(F.col("retrieved_ms") < FAR, F.col("retrieved_ms")))
