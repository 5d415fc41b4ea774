"""Structured Streaming counterparts: deduplicated bars with watermarks, lateness by cell, lambda sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.timegrid import LENGTH_MS, instant_ms, length_ms, number
from tidemark.operators.lateness import totals
from tidemark.plans.market import CELL, READING


def arrivals(stream: DataFrame) -> DataFrame:
    """Records of a market_observation stream: id, cell, event and arrival time, allowed lateness, volume.

    Rows without an id, symbol, known timeframe, close_time or retrieved_at are left out.
    """
    d = stream.filter(F.col("symbol").isNotNull() & F.col("timeframe").isin(*LENGTH_MS) & F.col("observation_id").isNotNull())
    d = d.select("observation_id", *CELL, "candle_status", instant_ms(F.col("close_time")).alias("event"), instant_ms(F.col("retrieved_at")).alias("arrival"), (length_ms(F.col("timeframe")) * 12).alias("allowed"), number(F.col("close_price")).alias("c"), number(F.col("volume")).alias("v"))
    return d.filter("event IS NOT NULL AND arrival IS NOT NULL")


def hourly(stream: DataFrame, *, lateness: str = "1 day", span: str = "1 hour") -> DataFrame:
    """Readings per symbol and ``span`` of their close, ids counted once within the watermark.

    Gives symbol, start, n, low, high and volume. Records later than ``lateness`` behind the stream's
    latest event are dropped by the watermark; state older than it is freed.
    """
    d = arrivals(stream).filter(F.col("candle_status").isin(*READING)).withColumn("ts", F.timestamp_millis("event")).withWatermark("ts", lateness)
    d = d.dropDuplicatesWithinWatermark(["observation_id"])
    g = d.groupBy("symbol", F.window("ts", span).alias("w")).agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.sum("v").alias("volume"))
    return g.select("symbol", F.col("w.start").alias("start"), "n", "low", "high", "volume")


def judge_lateness(stream: DataFrame) -> DataFrame:
    """Each record of :func:`arrivals` with ``is_late``, judged against its cell's frontier.

    State per cell: the latest event and the arrival up to which it counts. Within a micro-batch
    records are taken in order of arrival; records with equal arrival do not judge one another.
    Micro-batches must come in order of arrival; a record arriving out of that order is judged
    against all that came before it. Repeated ids are judged each time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        d = pd.concat(list(batches), ignore_index=True).sort_values("arrival", kind="stable")
        frontier, pending, at = state.get if state.exists else (None, None, None)
        late = []
        for event, arrival, allowed in zip(d["event"], d["arrival"], d["allowed"]):
            if at is None or arrival > at:
                frontier = pending if frontier is None else frontier if pending is None else max(frontier, pending)
                pending, at = None, int(arrival)
            late.append(frontier is not None and frontier - event > allowed)
            pending = int(event) if pending is None else max(pending, int(event))
        state.update((frontier, pending, at))
        yield pd.DataFrame({"observation_id": d["observation_id"], "symbol": key[0], "timeframe": key[1], "event": d["event"], "arrival": d["arrival"], "is_late": late})

    out = "observation_id string, symbol string, timeframe string, event long, arrival long, is_late boolean"
    return stream.groupBy(*CELL).applyInPandasWithState(step, out, "frontier long, pending long, at long", "append", GroupStateTimeout.NoTimeout)


def fast_sink(path: str, by: list[str], sums: list[str]):
    """A ``foreachBatch`` function of the fast layer: every micro-batch adds one file set of totals.

    Batches are written under their number, so one that is run again after a failure replaces itself.
    """

    def write(batch: DataFrame, number_: int) -> None:
        totals(batch, by, sums).write.mode("overwrite").parquet(f"{path}/batch={number_}")

    return write
