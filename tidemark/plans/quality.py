"""Quality of observations, duplicate content, retention, reconciliation, and evidence by age and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import instant_ms, length_ms, number
from tidemark.plans.market import CELL, READING, observations
from tidemark.sources.tables import materialize, read_table

_VALUES = ("open_price", "high_price", "low_price", "close_price", "volume", "open_interest")
#: Fixed values by timeframe: seconds after the close until a bar is stale, until its open interest is, and least quality.
FRESH_S = {"1m": 5, "3m": 8, "5m": 10, "15m": 20, "30m": 25, "1h": 30, "2h": 60, "4h": 120, "6h": 180, "8h": 240, "12h": 300, "1d": 300, "1w": 3600, "1mo": 14400}
OI_LAG_S = {"1m": 10, "3m": 15, "5m": 20, "15m": 30, "30m": 45, "1h": 60, "2h": 90, "4h": 120, "6h": 180, "8h": 240, "12h": 300, "1d": 300, "1w": 3600, "1mo": 14400}
Q_MIN = {"1m": 0.60, "3m": 0.58, "5m": 0.56, "15m": 0.54, "30m": 0.52, "1h": 0.50, "2h": 0.48, "4h": 0.46, "6h": 0.45, "8h": 0.44, "12h": 0.42, "1d": 0.40, "1w": 0.40, "1mo": 0.40}
#: Fixed values by timeframe: weights of schema, time, sequence, OHLC, volume, open interest and source.
WEIGHTS = {
    "1m": (0.20, 0.20, 0.15, 0.20, 0.10, 0.10, 0.05), "3m": (0.19, 0.19, 0.15, 0.21, 0.11, 0.10, 0.05), "5m": (0.18, 0.18, 0.15, 0.22, 0.12, 0.10, 0.05), "15m": (0.17, 0.17, 0.15, 0.23, 0.13, 0.10, 0.05),
    "30m": (0.16, 0.16, 0.15, 0.24, 0.14, 0.10, 0.05), "1h": (0.15, 0.15, 0.15, 0.25, 0.15, 0.10, 0.05), "2h": (0.14, 0.14, 0.14, 0.26, 0.15, 0.11, 0.06), "4h": (0.13, 0.13, 0.13, 0.27, 0.15, 0.12, 0.07),
    "6h": (0.12, 0.12, 0.12, 0.28, 0.15, 0.13, 0.08), "8h": (0.12, 0.12, 0.12, 0.28, 0.15, 0.13, 0.08), "12h": (0.11, 0.11, 0.11, 0.29, 0.15, 0.14, 0.09), "1d": (0.10, 0.10, 0.10, 0.30, 0.15, 0.15, 0.10),
    "1w": (0.10, 0.10, 0.10, 0.30, 0.15, 0.15, 0.10), "1mo": (0.10, 0.10, 0.10, 0.30, 0.15, 0.15, 0.10),
}
PARTS = ("schema", "time", "seq", "ohlc", "volume", "oi", "source")


def by_timeframe(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])[F.col("timeframe")]


def oi_state(oi: Column, lag_s: Column, limit_s: Column) -> Column:
    """MISSING (never 0), INVALID, AVAILABLE, STALE up to five limits, DEGRADED."""
    return F.when(oi.isNull(), "MISSING").when(oi < 0, "INVALID").when(lag_s.isNull(), "MISSING").when(lag_s <= limit_s, "AVAILABLE").when(lag_s <= 5 * limit_s, "STALE").otherwise("DEGRADED")


def quality_states(spark: SparkSession, sf: str) -> DataFrame:
    """Per reading: open interest state, the seven parts, their weighted sum, and the first gate that fails or VALID.

    Delay is retrieval after close, and the open interest's lag with it; the sequence part is the share of
    slots since the cell's reading before that have one. Readings without a close or a retrieval fail the
    timestamp gate. Previous readings come from a window inside slot buckets with the last slot of the bucket before.
    """
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot", "close_ms"), values=_VALUES).filter("slot IS NOT NULL")
    block = F.floor(F.col("slot") / F.lit(2048.0)).cast("long")
    d = materialize(d.withColumn("_b", block), "rated")
    last = d.groupBy(*CELL, "_b").agg(F.max("slot").alias("_last"))
    last = last.withColumn("_before", F.max("_last").over(Window.partitionBy(*CELL).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    inside = F.max("slot").over(Window.partitionBy(*CELL, "_b").orderBy("slot").rangeBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", inside).join(last, [*CELL, "_b"])
    d = d.withColumn("step", F.col("slot") - F.coalesce("_in", "_before")).withColumn("delay", (F.col("retrieved_ms") - F.col("close_ms")) / 1000.0)
    limit, oi_limit = by_timeframe(FRESH_S), by_timeframe(OI_LAG_S)
    state = oi_state(F.col("open_interest"), F.col("delay"), oi_limit)
    ok = (F.col("high_price") >= F.greatest("open_price", "close_price")) & (F.col("low_price") <= F.least("open_price", "close_price")) & (F.col("high_price") >= F.col("low_price"))
    unknown = F.col("open_price").isNull() | F.col("high_price").isNull() | F.col("low_price").isNull() | F.col("close_price").isNull()
    parts = {
        "schema": F.when(unknown, 0.0).otherwise(1.0), "time": F.when(F.col("delay").isNotNull(), 1 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("delay") / limit))), "seq": F.coalesce(1 / F.col("step").cast("double"), F.lit(1.0)), "ohlc": F.when(ok, 1.0).otherwise(0.0),
        "volume": F.when(F.col("volume") > 0, 1.0).when(F.col("volume") == 0, 0.5).otherwise(0.0), "oi": F.when(state == "AVAILABLE", 1.0).when(state == "STALE", 0.5).when(state == "DEGRADED", 0.2).otherwise(0.0), "source": F.lit(1.0),
    }
    d = d.select("*", state.alias("oi_state"), *[p.alias(f"q_{k}") for k, p in parts.items()])
    raw = sum((by_timeframe({t: w[i] for t, w in WEIGHTS.items()}) * F.col(f"q_{k}") for i, k in enumerate(PARTS)), F.lit(0.0))
    gate = (
        F.when(unknown, "SCHEMA").when(F.col("delay").isNull(), "TIMESTAMP").when(~ok, "OHLC").when(F.col("volume") < 0, "VOLUME_NEGATIVE").when(F.col("delay") > limit, "FRESHNESS")
        .when(F.col("oi_state") == "DEGRADED", "OI_LAG").when(F.col("step") > 1, "COMPLETENESS").when(raw < by_timeframe(Q_MIN), "Q_MIN").otherwise("VALID")
    )
    # 1e-9 moves shares of whole milliseconds off the ties of the sixth digit
    return d.select("observation_id", *CELL, "oi_state", *[F.round(F.col(f"q_{k}") + 1e-9, 6).alias(f"q_{k}") for k in PARTS], F.round(raw + 1e-9, 6).alias("q_raw"), gate.alias("state"))


def _plain_number(c: str) -> Column:
    """Decimal text of a number, without exponent and trailing zeros."""
    text = F.col(c).cast("decimal(28,8)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def content_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes that several observation ids share: cell, hash, ids.

    The hash is SHA-256 over a JSON object of close, open, symbol, timeframe, timestamp and volume with sorted
    keys and no blanks. Rows that lack one of the values have no hash.
    """
    d = observations(read_table(spark, sf, "market_observation"), times=("close_ms",), values=("open_price", "close_price", "volume")).dropna(subset=["close_ms", "open_price", "close_price", "volume"])
    text = F.concat(
        F.lit('{"close":"'), _plain_number("close_price"), F.lit('","open":"'), _plain_number("open_price"), F.lit('","symbol":"'), F.col("symbol"), F.lit('","timeframe":"'), F.col("timeframe"),
        F.lit('","timestamp":"'), F.date_format(F.timestamp_millis("close_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('","volume":"'), _plain_number("volume"), F.lit('"}'),
    )
    return d.groupBy(*CELL, F.sha2(text, 256).alias("content_hash")).agg(F.count("*").alias("ids"), F.min("observation_id").alias("first_id")).filter("ids > 1")


#: Months that raw observations, snapshots and evidence are kept.
KEEP = {"market_observation": 12, "snapshot_pit": 6, "evidence_event": 6}


def retention_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per table and month of their time, and whether the month is past what is kept, behind the table's latest row."""
    out = None
    for table, at in (("market_observation", None), ("snapshot_pit", "as_of"), ("evidence_event", "timestamp_utc")):
        d = read_table(spark, sf, table)
        at = F.timestamp_millis(instant_ms(F.coalesce("close_time", "open_time"))) if at is None else F.col(at)
        g = d.select(F.trunc(at, "month").alias("month")).filter("month IS NOT NULL").groupBy("month").agg(F.count("*").alias("n"))
        top = F.max("month").over(Window.partitionBy(F.lit(0)))  # months of a table, not rows
        g = g.select(F.lit(table).alias("table_name"), "month", "n", (F.months_between(top, "month") > KEEP[table]).alias("is_past"))
        out = g if out is None else out.unionByName(g)
    return out


def cursor_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Latest saved cursor of each cell against its last close: both sides outer, MATCH, BEHIND, AHEAD, NO_CURSOR, NO_BARS."""
    b = read_table(spark, sf, "research_bootstrap_progress").filter("cell_id <> '' AND cursor_ms IS NOT NULL").groupBy("cell_id").agg(F.max("cursor_ms").alias("cursor_ms"))
    m = observations(read_table(spark, sf, "market_observation"), status=READING, times=("close_ms",)).groupBy(F.concat_ws(":", *CELL).alias("cell_id")).agg(F.max("close_ms").alias("close_ms"))
    j = b.join(m, "cell_id", "full")
    kind = F.when(F.col("close_ms").isNull(), "NO_BARS").when(F.col("cursor_ms").isNull(), "NO_CURSOR").when(F.col("cursor_ms") == F.col("close_ms"), "MATCH").when(F.col("cursor_ms") < F.col("close_ms"), "BEHIND").otherwise("AHEAD")
    return j.select("cell_id", "cursor_ms", "close_ms", (F.col("cursor_ms") - F.col("close_ms")).alias("delta_ms"), kind.alias("state"))


#: Decay of evidence per bar of its age, and the age in bars at which it expires.
DECAY, EXPIRES = 0.1, 5


def evidence_freshness(spark: SparkSession, sf: str) -> DataFrame:
    """Each event at its snapshot's time: age in bars, freshness exp(-0.1 age), ACTIVE, EXPIRED, FUTURE or UNKNOWN."""
    e = read_table(spark, sf, "evidence_event").filter("evidence_id IS NOT NULL").groupBy("evidence_id", "timeframe", "snapshot_id").agg(F.min("timestamp_utc").alias("at"))
    s = read_table(spark, sf, "snapshot_pit").filter("snapshot_id <> ''").groupBy("snapshot_id").agg(F.min("as_of").alias("as_of"))
    age = (F.unix_millis("as_of") - F.unix_millis("at")) / length_ms(F.col("timeframe"))
    j = e.join(s, "snapshot_id", "left").withColumn("age", age)
    state = F.when(F.col("age").isNull(), "UNKNOWN").when(F.col("age") < 0, "FUTURE").when(F.col("age") >= EXPIRES, "EXPIRED").otherwise("ACTIVE")
    return j.select("evidence_id", "timeframe", F.round("age", 6).alias("age_bars"), F.when(F.col("age") >= 0, F.round(F.exp(-DECAY * F.col("age")), 6)).alias("freshness"), state.alias("state"))


#: Greatest distance of a level from a price, relative to the price.
TOLERANCE = 0.005


def nearest_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The evidence price level of the same symbol nearest to each setup's entry, within half a percent.

    Prices fall into logarithmic buckets as wide as the tolerance; a setup meets its bucket and the two
    beside it, so there is no range join. Levels are reduced to distinct ones first. Ties: the lower level.
    """
    bucket = lambda c: F.floor(F.log(c) / F.log(F.lit(1 + TOLERANCE))).cast("long")
    lv = read_table(spark, sf, "evidence_event").select("symbol", number(F.col("price_level")).alias("level")).filter("level > 0 AND symbol IS NOT NULL").distinct().withColumn("b", bucket(F.col("level")))
    s = read_table(spark, sf, "setup_candidate").select("setup_id", "symbol", number(F.col("entry_price")).alias("entry")).filter("entry > 0 AND setup_id IS NOT NULL").distinct()
    s = s.withColumn("b", F.explode(F.array(*[bucket(F.col("entry")) + k for k in (-1, 0, 1)])))
    away = F.abs(F.col("level") - F.col("entry"))
    j = s.join(lv, ["symbol", "b"]).withColumn("away", away).filter(F.col("away") <= TOLERANCE * F.col("entry"))
    return j.groupBy("setup_id", "symbol", "entry").agg(F.min(F.struct("away", "level")).alias("x")).select("setup_id", "symbol", "entry", F.col("x.level").alias("level"), F.round(F.col("x.away") / F.col("entry"), 8).alias("distance"))


QUERIES = {f.__name__: f for f in (quality_states, content_duplicates, retention_report, cursor_reconcile, evidence_freshness, nearest_levels)}
