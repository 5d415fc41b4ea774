"""Streams give what batches give."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import lateness
from tidemark.streaming import records

BASE = 1_700_000_000_000 // 60_000 * 60_000


def iso(ms):
    from datetime import datetime, timezone

    return datetime.fromtimestamp(ms / 1000, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.000Z")


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Three files in order of arrival; the record `late` closes twenty minutes behind."""
    path = tmp_path_factory.mktemp("feed")
    data = [(f"o{i}", "AAA", "1m", BASE + i * 60_000, BASE + i * 60_000 + 2_000) for i in range(30)]
    data.append(("late", "AAA", "1m", BASE + 5 * 60_000, BASE + 29 * 60_000 + 500))
    data.sort(key=lambda r: r[4])
    rows = [(i, s, tf, "CLOSED", iso(c), iso(a), "10.5", "2", "x") for i, s, tf, c, a in data] + [("n", None, "1m", "CLOSED", iso(BASE), iso(BASE), "1", "1", "x")]
    cols = "observation_id string, symbol string, timeframe string, candle_status string, close_time string, retrieved_at string, close_price string, volume string, event string"
    for k in range(3):
        spark.createDataFrame(rows[k * 11 : k * 11 + 11], cols).coalesce(1).write.mode("append").parquet(str(path))
    return str(path), cols


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_lateness_of_stream_equals_batch(spark, feed):
    path, cols = feed
    run(records.judge_lateness(records.arrivals(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path))), "judged")
    got = sorted(r[0] for r in spark.table("judged").filter("is_late").collect())
    batch = lateness.beyond_cutoff(records.arrivals(spark.read.parquet(path)), ["symbol", "timeframe"], event="event", arrival="arrival", allowed="allowed")
    assert got == sorted(r[0] for r in batch.filter("is_late").select("observation_id").collect()) == ["late"]


def test_hourly_and_fast_layer(spark, feed, tmp_path):
    path, cols = feed
    run(records.hourly(spark.readStream.schema(cols).parquet(path)), "hours", "complete")
    assert spark.table("hours").agg(F.sum("n"), F.sum("volume")).first() == (31, 62.0)
    out = str(tmp_path / "fast")
    s = records.arrivals(spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(path))
    s.writeStream.foreachBatch(records.fast_sink(out, ["symbol"], ["v"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start().awaitTermination(120)
    merged = lateness.merge_totals(spark.read.parquet(out), ["symbol"], ["v"]).first()
    assert merged["n"] == 31 and merged["v"] == 62.0
