"""Queries over bars: one clean bar per cell and slot, and what is computed from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.features import DERIVED, GROUPS, expand
from tidemark.functions.timegrid import DAY, LENGTH_MS, length_ms, slot_start_ms
from tidemark.operators.implausible import numbered
from tidemark.operators.scan import with_halo
from tidemark.plans.market import CELL, FAR, READING, observations
from tidemark.sources.tables import materialize, read_table

_VALUES = ("open_price", "high_price", "low_price", "close_price", "volume", "open_interest")
_SHORT = ("o", "h", "l", "c", "v", "oi")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One bar per cell and slot: the reading retrieved last, with all of o, h, l, c known.

    Columns symbol, timeframe, slot, open_ms, o, h, l, c, v, oi. Unknown open interest stays null.
    """
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot",), values=_VALUES)
    d = d.filter("slot IS NOT NULL AND open_price IS NOT NULL AND high_price IS NOT NULL AND low_price IS NOT NULL AND close_price IS NOT NULL")
    at = F.coalesce("retrieved_ms", F.lit(FAR))
    # equal retrieval times: the greatest id; the payload is carried in one struct, as ids are not numbers
    best = F.max(F.struct(at.alias("at"), "observation_id", *_VALUES)).alias("x")
    d = d.groupBy(*CELL, "slot").agg(best).select(*CELL, "slot", *[F.col(f"x.{a}").alias(b) for a, b in zip(_VALUES, _SHORT)])
    return d.withColumn("open_ms", slot_start_ms(F.col("timeframe"), F.col("slot")))


def numbered_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars with ``n``, their number in the cell from 1 on, counted without gathering a cell."""
    return numbered(bars(spark, sf), CELL, ["slot"], F.floor(F.col("slot") / F.lit(2048.0)).cast("long"), {"n": "slot"})


def features(d: DataFrame, group: str) -> DataFrame:
    """All features of a group for numbered bars, over chunks with a halo."""
    exprs, before, after = GROUPS[group]
    part = "symbol, timeframe, _chunk"
    d = with_halo(d, CELL, "n", before=before + 1, after=after)
    if group in ("volatility", "events", "participation"):
        d = d.withColumn("len_ms", length_ms(F.col("timeframe"))).selectExpr("*", *[f"{expand(x, part)} AS {n}" for n, x in DERIVED.items()])
    d = d.selectExpr("symbol", "timeframe", "open_ms", "_own", "_chunk", *[f"{expand(x, part)} AS {n}" for n, x in exprs.items()])
    return d.filter("_own = _chunk").drop("_own", "_chunk")


def _group(name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return features(numbered_bars(spark, sf), name)

    return query


# ---------------------------------------------------------------- bounded folds


def folds(spark: SparkSession, sf: str) -> DataFrame:
    """Recursive indicators seeded at the start of a bounded window of 60 bars: EMA, RMA, RSI, ATR, MACD.

    The recursion runs inside the JVM as a fold over the window's array.
    """
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=61)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    d = d.withColumn("pc", F.lag("c").over(w))
    d = d.withColumn("tr", F.when(F.col("pc").isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("pc")), F.abs(F.col("l") - F.col("pc")))))
    d = d.withColumn("ch", F.col("c") - F.col("pc"))
    w60 = w.rowsBetween(-59, 0)
    d = d.select(*CELL, "open_ms", "n", "_own", "_chunk", F.collect_list("c").over(w60).alias("cs"), F.collect_list("tr").over(w60).alias("ts"), F.collect_list("ch").over(w60).alias("ds"))
    d = d.filter("_own = _chunk AND n > 60")
    d = d.withColumn("ups", F.expr("transform(ds, x -> greatest(x, 0D))")).withColumn("downs", F.expr("transform(ds, x -> greatest(-x, 0D))"))
    seed = lambda a, n: f"aggregate(slice({a}, 1, {n}), 0D, (s, x) -> s + x) / {n}"
    ema = lambda a, n: f"aggregate(slice({a}, {n + 1}, 60), {seed(a, n)}, (s, x) -> s * (1 - 2D / {n + 1}) + x * (2D / {n + 1}))"
    rma = lambda a, n: f"aggregate(slice({a}, {n + 1}, 60), {seed(a, n)}, (s, x) -> (s * {n - 1} + x) / {n})"
    up, down = rma("ups", 14), rma("downs", 14)
    return d.selectExpr(
        *CELL, "open_ms", f"round({ema('cs', 20)}, 6) AS ema_20", f"round({rma('cs', 14)}, 6) AS rma_14", f"round({rma('ts', 14)}, 8) AS atr_wilder",
        f"round({ema('cs', 12)} - {ema('cs', 26)}, 6) AS macd",
        f"round(CASE WHEN {down} = 0 AND {up} = 0 THEN 50D WHEN {down} = 0 THEN 100D ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END, 6) AS rsi_14",
    )


# ---------------------------------------------------------------- aggregates


def resample_1d(spark: SparkSession, sf: str) -> DataFrame:
    """Bars below a day rolled up to UTC days: first open, extremes, last close, total volume, completeness."""
    d = bars(spark, sf).withColumn("len", length_ms(F.col("timeframe"))).filter(F.col("len") < DAY)
    day = F.floor(F.col("open_ms") / F.lit(float(DAY))).cast("long")
    g = d.groupBy(*CELL, day.alias("day")).agg(F.min_by("o", "slot").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "slot").alias("c"), F.sum(F.col("v").cast("decimal(28,8)")).alias("v"), F.max_by("oi", F.when(F.col("oi").isNotNull(), F.col("slot"))).alias("oi"), F.count("*").alias("n"), F.max("len").alias("len"))
    return g.select(*CELL, F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "o", "h", "l", "c", F.round(F.col("v").cast("double"), 3).alias("v"), "oi", "n", F.round(F.col("n") * F.col("len") / F.lit(float(DAY)), 6).alias("completeness"))


def validation(spark: SparkSession, sf: str) -> DataFrame:
    """First failing check of every distinct observation, counted per cell; ``OK`` where none fails."""
    d = observations(read_table(spark, sf, "market_observation"), times=("open_ms", "close_ms"), values=_VALUES)
    null = F.col("open_price").isNull() | F.col("high_price").isNull() | F.col("low_price").isNull() | F.col("close_price").isNull()
    code = (
        F.when(null, "NO_PRICE").when(F.col("close_ms").isNull() & F.col("open_ms").isNull(), "NO_TIME").when(F.col("high_price") < F.greatest("open_price", "close_price", "low_price"), "HIGH_BELOW")
        .when(F.col("low_price") > F.least("open_price", "close_price"), "LOW_ABOVE").when(F.col("low_price") <= 0, "NOT_POSITIVE").when(F.col("volume").isNull(), "NO_VOLUME").when(F.col("volume") < 0, "NEGATIVE_VOLUME")
        .when(F.col("open_interest") < 0, "NEGATIVE_OI").when(F.col("open_ms") >= F.col("close_ms"), "TIME_ORDER").otherwise("OK")
    )
    return d.groupBy(*CELL, code.alias("code")).agg(F.count("*").alias("n"))


def frontier(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: latest retrieval and close, number of bars, of expected bars and the completeness between."""
    d = bars(spark, sf)
    return d.groupBy(*CELL).agg(F.max("open_ms").alias("last_open_ms"), F.count("*").alias("n_bars"), (F.max("slot") - F.min("slot") + 1).alias("n_expected"), F.round(F.count("*") / (F.max("slot") - F.min("slot") + 1), 6).alias("completeness"), F.count("oi").alias("n_oi"))


def last_window(spark: SparkSession, sf: str) -> DataFrame:
    """The last 50 bars of each cell, taken by number: no sort of a cell."""
    d = numbered_bars(spark, sf)
    top = d.groupBy(*CELL).agg(F.max("n").alias("top"))
    return d.join(top, CELL).filter(F.col("n") > F.col("top") - 50).select(*CELL, "open_ms", (F.col("top") - F.col("n")).alias("age"), "o", "h", "l", "c", "v")


def volume_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: volume by 50 equal price bins of the typical price, point of control and 70 % value area."""
    d = bars(spark, sf).filter("h >= l AND v >= 0 AND l > 0").withColumn("tp", (F.col("h") + F.col("l") + F.col("c")) / 3)
    span = d.groupBy(*CELL).agg(F.min("tp").alias("lo"), F.max("tp").alias("hi"))
    b = d.join(span, CELL).select(*CELL, F.least(F.floor((F.col("tp") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 50), F.lit(49)).cast("int").alias("bin"), F.col("v").cast("decimal(28,8)").alias("v"))
    g = b.filter("bin IS NOT NULL").groupBy(*CELL, "bin").agg(F.sum("v").cast("decimal(36,8)").alias("volume"))
    w = Window.partitionBy(*CELL).orderBy(F.desc("volume"), "bin")
    total = F.sum("volume").over(Window.partitionBy(*CELL))
    g = g.withColumn("rank", F.row_number().over(w)).withColumn("before", F.coalesce(F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")).withColumn("total", total.cast("double"))
    return g.select(*CELL, "bin", F.round(F.col("volume").cast("double"), 3).alias("volume"), (F.col("rank") == 1).alias("is_poc"), (F.col("before") < F.col("total") * 0.7).alias("in_value_area"))


def seasonal(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell and hour of day: mean squared log return relative to the cell's, within 0.1 and 10, with Wilson bounds of the up rate."""
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=1)
    pc = F.lag("c").over(Window.partitionBy(*CELL, "_chunk").orderBy("n"))
    d = d.withColumn("r", F.when((F.col("c") > 0) & (pc > 0), F.log(F.col("c") / pc))).filter("_own = _chunk AND r IS NOT NULL")
    hour = (F.floor(F.col("open_ms") / F.lit(3_600_000.0)) % 24).cast("int")
    g = d.groupBy(*CELL, hour.alias("hour")).agg(F.count("*").alias("n"), F.sum(F.col("r") * F.col("r")).alias("s"), F.count(F.when(F.col("r") > 0, 1)).alias("ups"))
    w = Window.partitionBy(*CELL)
    grand = F.sum("s").over(w) / F.sum("n").over(w)
    z = 1.96
    p, n = F.col("ups") / F.col("n"), F.col("n")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    factor = F.least(F.greatest(F.col("s") / n / F.nullif(grand, F.lit(0.0)), F.lit(0.1)), F.lit(10.0))
    return g.select(*CELL, "hour", "n", F.round(factor, 6).alias("factor"), F.round(p, 6).alias("up_rate"), F.round(mid - half, 6).alias("up_low"), F.round(mid + half, 6).alias("up_high"))


def spreads(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: microstructure proxies Corwin-Schultz, Abdi-Ranaldo, Roll, Amihud and Kyle's lambda."""
    d = with_halo(numbered_bars(spark, sf).filter("h > 0 AND l > 0 AND c > 0 AND h >= l"), CELL, "n", before=2)
    w = Window.partitionBy(*CELL, "_chunk").orderBy("n")
    lag = lambda c: F.lag(c).over(w)
    d = d.select(*CELL, "n", "_own", "_chunk", "v", F.log(F.col("h") / F.col("l")).alias("hl"), F.log("c").alias("lc"), ((F.log("h") + F.log("l")) / 2).alias("eta"), F.greatest(F.col("h"), lag("h")).alias("h2"), F.least(F.col("l"), lag("l")).alias("l2"), lag("n").alias("pn"), lag("c").alias("pc"), "c")
    d = d.withColumn("r", F.col("lc") - F.log("pc")).withColumn("beta", F.pow("hl", F.lit(2.0)) + F.pow(lag("hl"), F.lit(2.0))).withColumn("gamma", F.pow(F.log(F.col("h2") / F.col("l2")), F.lit(2.0)))
    k = 3 - 2 * 2**0.5
    d = d.withColumn("alpha", (F.sqrt(2 * F.col("beta")) - F.sqrt("beta")) / k - F.sqrt(F.col("gamma") / k)).withColumn("pr", F.lag("r").over(w)).withColumn("mid", (F.lag("lc").over(w) - F.lag("eta").over(w)) * (F.lag("lc").over(w) - (F.lag("eta").over(w) + F.col("eta")) / 2))
    d = d.filter("_own = _chunk AND r IS NOT NULL")
    g = d.groupBy(*CELL).agg(
        F.count("*").alias("n"),
        F.avg(F.greatest(F.lit(0.0), 2 * (F.exp("alpha") - 1) / (1 + F.exp("alpha")))).alias("cs"),
        F.avg("mid").alias("ar"), F.covar_pop("r", "pr").alias("cov"),
        F.avg(F.when(F.col("v") > 0, F.abs("r") / F.col("v"))).alias("amihud"),
        F.regr_slope(F.col("c") - F.col("pc"), F.signum("r") * F.col("v")).alias("kyle"),
    )
    return g.select(*CELL, "n", F.round("cs", 8).alias("corwin_schultz"), F.round(F.sqrt(F.greatest(F.lit(0.0), 4 * F.col("ar"))), 8).alias("abdi_ranaldo"), F.round(2 * F.sqrt(F.greatest(F.lit(0.0), -F.col("cov"))), 8).alias("roll"), F.round(F.col("amihud") * 1e6, 6).alias("amihud_1e6"), F.round(F.col("kyle") * 1e6, 6).alias("kyle_1e6"))


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe: smoothed transition rates between down, flat and up bars ((n + 1) / (row + 3))."""
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=1)
    state = F.when(F.col("c") > F.col("o") * 1.0005, "UP").when(F.col("c") < F.col("o") * 0.9995, "DOWN").otherwise("FLAT")
    d = d.withColumn("state", state).withColumn("prev", F.lag("state").over(Window.partitionBy(*CELL, "_chunk").orderBy("n"))).filter("_own = _chunk AND prev IS NOT NULL")
    g = d.groupBy("timeframe", "prev", "state").agg(F.count("*").alias("n"))
    w = Window.partitionBy("timeframe", "prev")
    return g.select("timeframe", "prev", "state", "n", F.round((F.col("n") + 1) / (F.sum("n").over(w) + 3), 6).alias("rate"))


def coarser_asof(spark: SparkSession, sf: str) -> DataFrame:
    """Each 15m bar with the last 1h and 1d bar of its symbol that had closed when it closed."""
    from tidemark.operators.asof import known_at

    d = bars(spark, sf).withColumn("close_ms", F.col("open_ms") + length_ms(F.col("timeframe")))
    fine = d.filter("timeframe = '15m'").select("symbol", "close_ms", F.struct("open_ms", "c").alias("bar"))
    out = fine
    for tf in ("1h", "1d"):
        coarse = d.filter(F.col("timeframe") == tf).select("symbol", F.col("close_ms").alias("available"), F.col("open_ms").alias(f"open_{tf}"), F.col("c").alias(f"c_{tf}"))
        out = known_at(out.withColumn("keep", F.struct("bar", *[x for x in out.columns if x.startswith(("open_", "c_"))])), coarse, ["symbol"], at="close_ms", available="available", rank=[f"open_{tf}", f"c_{tf}"], keep="keep", bucket=30 * DAY)
        out = out.select("symbol", "close_ms", "keep.*", f"open_{tf}", f"c_{tf}")
    return out.select("symbol", "bar.open_ms", "bar.c", "open_1h", "c_1h", "open_1d", "c_1d")


def coarser_pair(timeframe: str) -> tuple[str | None, str | None]:
    """Intermediate and higher timeframe of one: two steps up (else one) and four (else the coarsest)."""
    order = list(LENGTH_MS)
    i, last = order.index(timeframe), len(order) - 1
    return (order[i + 2 if i + 2 <= last else last], order[min(i + 4, last)]) if i < last else (None, None)


def coarser_all(spark: SparkSession, sf: str) -> DataFrame:
    """Each bar of any timeframe with the last intermediate and the last higher bar of its symbol that had closed when it closed.

    A bar closes where the next slot starts; the coarsest timeframe has neither.
    """
    from tidemark.operators.asof import known_at

    d = bars(spark, sf).withColumn("close_ms", slot_start_ms(F.col("timeframe"), F.col("slot") + 1))
    d = materialize(d.select(*CELL, "open_ms", "close_ms", "c"), "bars")
    out = d
    for k, role in enumerate(("mid", "high")):
        # no wanted timeframe is a key that no bar has: such bars come out with nulls
        wanted = F.create_map(*[F.lit(x) for tf in LENGTH_MS for x in (tf, coarser_pair(tf)[k] or "")])[F.col("timeframe")]
        coarse = d.select("symbol", F.col("timeframe").alias("wanted"), F.col("close_ms").alias("available"), F.col("open_ms").alias(f"open_{role}"), F.col("c").alias(f"c_{role}"))
        events = out.select("symbol", wanted.alias("wanted"), "close_ms", F.struct(*out.columns).alias("keep"))
        out = known_at(events, coarse, ["symbol", "wanted"], at="close_ms", available="available", rank=[f"open_{role}", f"c_{role}"], keep="keep", bucket=30 * DAY)
        out = out.select("keep.*", F.nullif("wanted", F.lit("")).alias(f"tf_{role}"), f"open_{role}", f"c_{role}")
    return out.drop("close_ms")


def window_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol and timeframe: least and freshness-weighted quality of the rated readings, newest first."""
    d = numbered_bars(spark, sf).select(*CELL, "slot", "n")
    o = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot",)).select("observation_id", *CELL, "slot")
    q = read_table(spark, sf, "quality_vector").filter("q_raw IS NOT NULL AND NOT isnan(q_raw)").groupBy("quality_id", "observation_id").agg(F.min("q_raw").alias("q"))
    r = q.join(o, "observation_id").join(d, [*CELL, "slot"])
    top = d.groupBy(*CELL).agg(F.max("n").alias("top"))
    r = r.join(top, CELL).withColumn("wt", F.exp(-0.05 * (F.col("top") - F.col("n"))))
    return r.groupBy(*CELL).agg(F.count("*").alias("n"), F.min("q").alias("q_min"), F.round(F.sum(F.col("q") * F.col("wt")) / F.nullif(F.sum("wt"), F.lit(0.0)), 6).alias("q_window"), (F.min("q") < 0.5).alias("is_vetoed"))


def evidence_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Per snapshot: events, engines, mean confidence, quality spread and the share of the dominant event type."""
    e = read_table(spark, sf, "evidence_event").filter("snapshot_id <> '' AND validity = 1").select("evidence_id", "snapshot_id", "engine_id", "event_type", "confidence", "strength").distinct()
    per = e.groupBy("snapshot_id", "engine_id").agg(F.count("*").alias("k"), F.sum(F.col("confidence").cast("decimal(18,6)")).alias("s"), F.max("strength").alias("hi"), F.min("strength").alias("lo"))
    return per.groupBy("snapshot_id").agg(F.sum("k").alias("n"), F.count("*").alias("engines"), F.round(F.sum("s").cast("double") / F.sum("k"), 6).alias("mean_confidence"), (F.max("hi") - F.min("lo")).alias("strength_spread"), F.round(F.max("k") / F.sum("k"), 6).alias("dominant_share"))


QUERIES = {
    "bars_clean": lambda s, d: bars(s, d).select(*CELL, "open_ms", *_SHORT),
    **{f"features_{g}": _group(g) for g in GROUPS},
    "features_folds": folds, "bars_resample_1d": resample_1d, "bars_validation": validation, "bars_frontier": frontier, "bars_last_window": last_window,
    "volume_profile": volume_profile, "seasonal_factors": seasonal, "spread_proxies": spreads, "transition_matrix": transitions, "coarser_asof": coarser_asof, "coarser_all": coarser_all,
    "window_quality": window_quality, "evidence_agreement": evidence_agreement,
}
