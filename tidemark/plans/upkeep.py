"""Queries of the general data-upkeep problems over the domain tables (p1 to p7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.timegrid import DAY, instant_ms, length_ms, slot_start_ms
from tidemark.operators import asof, hierarchy, implausible, lateness, orphans, regular_grid, rolling
from tidemark.plans.market import CELL, FAR, KNOWN, READING, observations
from tidemark.sources.tables import materialize, read_table, small_side

# ---------------------------------------------------------------- 1 regular grid


#: Parts of a slot to which openings are taken: a power of two, so that positions and shares are exact.
PARTS = float(1 << 20)


def _volume_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of each cell's session volume counter, which restarts with the UTC day.

    A slot with several readings counts with the one retrieved last. The volume of a reading ticks
    the counter at its slot's end, from 0 at the session's first slot; the reading vouches for the time
    from its own opening, which need not lie on the grid, to its slot's end, so whatever lies between
    two readings is a gap, be it a part of a slot or many slots.
    """
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot", "open_ms"), values=("volume",)).filter("slot IS NOT NULL")
    begin, end = (slot_start_ms(F.col("timeframe"), F.col("slot") + k) for k in (0, 1))
    day = F.floor(begin / F.lit(float(DAY))).cast("long")
    part = F.coalesce((F.col("open_ms") - begin) / (end - begin).cast("double"), F.lit(0.0))
    opened = F.col("slot") + F.floor(part * PARTS) / PARTS
    best = F.max_by(F.struct("volume", "opened"), "at").alias("x")
    d = d.select(*CELL, day.alias("session"), "slot", F.coalesce("retrieved_ms", F.lit(FAR)).alias("at"), "volume", opened.alias("opened"))
    one = materialize(d.groupBy(*CELL, "session", "slot").agg(best).select(*CELL, "session", "slot", "x.*"), "slots")
    w = Window.partitionBy(*CELL, "session").orderBy("slot")
    ticks = F.struct(F.col("opened").alias("start"), (F.col("slot") + 1).alias("end"), F.sum(F.coalesce(F.greatest("volume", F.lit(0.0)), F.lit(0.0))).over(w).alias("counter"))
    opening = F.struct(F.col("opened").alias("start"), F.col("opened").alias("end"), F.lit(0.0).alias("counter"))
    both = one.repartition(*CELL, "session").select(*CELL, "session", ticks.alias("tick"), F.when(F.row_number().over(w) == 1, opening).alias("opening"))
    meter = both.select(*CELL, "session", F.explode(F.array_compact(F.array("opening", "tick"))).alias("x")).select(*CELL, "session", "x.*")
    return regular_grid.counter_segments(meter, CELL, start="start", end="end", counter="counter", chunk="session")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    lacking = regular_grid.uncovered_cells(_volume_segments(spark, sf), CELL)
    return lacking.select(*CELL, slot_start_ms(F.col("timeframe"), F.col("slot")).alias("open_ms"))


def p1_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = regular_grid.spread_on_grid(_volume_segments(spark, sf), CELL)
    return grid.select(*CELL, slot_start_ms(F.col("timeframe"), F.col("slot")).alias("open_ms"), F.round("amount", 3).alias("volume"), F.round("coverage", 6).alias("coverage"), "status")


# ---------------------------------------------------------------- 2 hierarchies

TREES = (("apex_risk_ladder_state", "revision_id", "parent_revision_id"), ("ops_recovery_log", "payload_hash", "parent_hash"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(reduce(DataFrame.unionByName, [hierarchy.parent_links(read_table(spark, sf, t), n, p, t) for t, n, p in TREES]), "links")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.resolve(_links(spark, sf)).select("tbl", "node_id", "root_id", "depth")


def p2_paths(spark: SparkSession, sf: str) -> DataFrame:
    paths = hierarchy.full_paths(_links(spark, sf))
    return paths.select("tbl", "node_id", "root_id", "depth", F.concat_ws("/", "path").alias("path"))


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Number of descendants and height below every node, without building pairs."""
    return hierarchy.descendant_counts(_links(spark, sf))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All descendants of every node, those on and under loops included."""
    return hierarchy.ancestor_pairs(hierarchy.upward_paths(_links(spark, sf))).select("tbl", "ancestor_id", "descendant_id", "distance")


def p2_loops(spark: SparkSession, sf: str) -> DataFrame:
    nodes = hierarchy.resolve(_links(spark, sf)).filter("depth = -1")
    return nodes.groupBy("tbl", F.col("root_id").alias("loop_id")).agg(F.count("*").alias("n_nodes"))


# ---------------------------------------------------------------- 3 rolling totals

FIELDS = ["close_price", "volume", "high_price"]
WINDOWS = (7, 30)


def p3_rolling(spark: SparkSession, sf: str) -> DataFrame:
    """Per symbol and UTC day of the reading's slot: totals and averages over 7 and 30 days.

    Timeframes overlap, so each is also given by itself; timeframe ``all`` is the symbol's total.
    """
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot",), values=tuple(FIELDS)).filter("slot IS NOT NULL")
    day = F.date_from_unix_date(F.floor(slot_start_ms(F.col("timeframe"), F.col("slot")) / F.lit(float(DAY))).cast("int"))
    exact = [F.sum(F.col(c).cast("decimal(28,8)")).cast("decimal(36,8)").alias(c) for c in FIELDS]
    daily = d.groupBy(*CELL, day.alias("day")).agg(F.count("*").alias("readings"), *exact, *[F.count(c).alias(f"n_{c}") for c in FIELDS])
    scopes = daily.withColumn("timeframe", F.explode(F.array("timeframe", F.lit("all"))))
    parts = ["readings", *FIELDS, *[f"n_{c}" for c in FIELDS]]
    kinds = dict(daily.dtypes)
    daily = materialize(scopes.groupBy(*CELL, "day").agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in parts]), "daily")
    r = rolling.trailing_totals(daily, CELL, "day", ["readings", *FIELDS, *[f"n_{c}" for c in FIELDS]], WINDOWS)
    cols = []
    for w in WINDOWS:
        cols.append(F.col(f"readings_{w}"))
        for c in FIELDS:
            total = F.col(f"{c}_{w}").cast("double")
            cols += [total.alias(f"{c}_sum_{w}"), F.when(F.col(f"n_{c}_{w}") > 0, total / F.col(f"n_{c}_{w}")).alias(f"{c}_avg_{w}")]
    return r.select(*CELL, "day", *cols)


# ---------------------------------------------------------------- 4 dangling references

#: child table, child id, reference, time of the child, parent table, parent key, time the parent is there
REFERENCES = (
    ("quality_vector", "quality_id", "observation_id", None, "market_observation", "observation_id"),
    ("evidence_event", "evidence_id", "snapshot_id", "timestamp_utc", "snapshot_pit", "snapshot_id"),
    ("trade_plan", "proposal_id", "setup_id", "created_utc", "setup_candidate", "setup_id"),
    ("cell_decision_cursor", "cell_id", "proposal_id", "decided_at", "trade_plan", "proposal_id"),
)


def _dangling(spark: SparkSession, sf: str):
    for child, cid, ref, when, parent, key in REFERENCES:
        c = read_table(spark, sf, child)
        period = F.date_format(F.date_trunc("week", F.col(when)), "yyyy-MM-dd") if when else F.lit("undated")
        counts = orphans.count_references(c, ref, F.coalesce(period, F.lit("undated")))
        yield child, cid, ref, c, counts, orphans.dangling(counts, read_table(spark, sf, parent), key)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [orphans.dangling_rows(c, cid, ref, gone).withColumn("child_table", F.lit(child)) for child, cid, ref, c, _, gone in _dangling(spark, sf)]
    return reduce(DataFrame.unionByName, parts).select("child_table", "child_id", "ref_key")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    parts = [gone.groupBy("period").agg(F.countDistinct("ref_key").alias("keys"), F.sum("n").alias("refs")).withColumn("child_table", F.lit(child)) for child, _, _, _, _, gone in _dangling(spark, sf)]
    return reduce(DataFrame.unionByName, parts).select("child_table", "period", "keys", "refs")


# ---------------------------------------------------------------- 5 implausible values

SPIKE, VOLUME_HIGH, VOLUME_LOW, LEVEL, LEAST, RUN, REACH = 20.0, 20.0, 0.01, 0.1, 12, 8, 7
#: Interquartile ranges beyond the quartiles at which a value becomes a candidate.
FENCE = 6.0
SLOTS_PER_BLOCK = 2048.0


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    d = observations(read_table(spark, sf, "market_observation"), status=READING, times=("slot",), values=("open_price", "high_price", "low_price", "close_price", "volume"))
    top, bottom = F.greatest("open_price", "close_price"), F.least("open_price", "close_price")
    both = F.col("open_price").isNotNull() & F.col("close_price").isNotNull()
    d = d.withColumn("upper", F.when(both & (top != 0), F.col("high_price") / top - 1)).withColumn("lower", F.when(both & (bottom != 0), 1 - F.col("low_price") / bottom))
    return d.select("observation_id", *CELL, "slot", F.coalesce("retrieved_ms", F.lit(FAR)).alias("at"), "high_price", "low_price", "volume", "upper", "lower")


def _long(d: DataFrame, fields: dict[str, str]) -> DataFrame:
    """One row per field: symbol, timeframe, field, hour, value (hour of day of the slot as context)."""
    hour = F.floor(slot_start_ms(F.col("timeframe"), F.col("slot")) / F.lit(3_600_000.0)) % 24
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value")) for f, c in fields.items()])
    return d.select(*CELL, hour.cast("int").alias("hour"), F.explode(pairs).alias("x")).select(*CELL, "hour", "x.field", "x.value").filter("value IS NOT NULL")


def _successive(d: DataFrame, rid: str, fields: list[str]) -> DataFrame:
    """Successive non-null values per cell and field with is_stuck and local_median: record_id, field, value."""
    counts = {f"n_{f}": f for f in fields}
    n = implausible.numbered(d.select(rid, *CELL, "slot", "at", *fields), CELL, ["slot", "at", rid], F.floor(F.col("slot") / F.lit(SLOTS_PER_BLOCK)).cast("long"), counts)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), F.col(f"n_{f}").alias("number")) for f in fields])
    rows = n.select(F.col(rid).alias("record_id"), *CELL, F.explode(pairs).alias("x")).select("record_id", *CELL, "x.*").filter("value IS NOT NULL")
    return implausible.neighbourhoods(rows, [*CELL, "field"], "number", "value", reach=REACH, run=RUN)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    d = materialize(_readings(spark, sf).filter("slot IS NOT NULL"), "readings")
    q = read_table(spark, sf, "quality_vector").select("quality_id", "observation_id", "q_ohlc").filter(F.col("quality_id").isNotNull() & F.col("q_ohlc").isNotNull() & ~F.isnan("q_ohlc"))
    q = q.groupBy("quality_id", "observation_id").agg(F.min("q_ohlc").alias("q_ohlc"))
    rated = materialize(q.join(d.select("observation_id", *CELL, "slot", "at"), "observation_id").drop("observation_id"), "rated")

    keys = [*CELL, "field"]
    long = _long(d, {"high_price": "upper", "low_price": "lower"}).unionByName(_long(rated, {"q_ohlc": "q_ohlc"}))
    sketches = materialize(implausible.source_sketches(long, keys, "value", F.col("hour")), "sketches")
    merged = materialize(implausible.merge_sketches(sketches, keys), "merged")
    medians = implausible.exact_medians(long, keys, "value", merged)
    # a value is a candidate outside the cell's fences or, where these are wide, beyond what the sketch allows
    medians = materialize(medians.join(implausible.fences(merged, keys, FENCE).select(*keys, "low", "high"), keys), "medians")
    cells = d.groupBy(*CELL).agg(F.count("high_price").alias("c_high"), F.count("low_price").alias("c_low"), F.count("volume").alias("c_volume"))
    pick = lambda f, c="median": F.max(F.when(F.col("field") == f, F.col(c)))
    edges = [F.least(pick(f, "high"), SPIKE * pick(f)).alias(f"f_{n}") for f, n in (("high_price", "high"), ("low_price", "low"))]
    wide = medians.groupBy(*CELL).agg(*edges, pick("high_price").alias("m_high"), pick("low_price").alias("m_low"), pick("q_ohlc").alias("m_q"), F.max(F.when(F.col("field") == "q_ohlc", F.col("n"))).alias("c_q"))
    norms = small_side(materialize(cells.join(wide, CELL, "full"), "norms"))

    j = d.join(norms, CELL)
    crossed = F.col("high_price") < F.col("low_price")
    bad_high = (F.col("high_price") <= 0) | crossed | ((F.col("c_high") >= LEAST) & (F.col("upper") > F.col("f_high")) & (F.col("upper") > SPIKE * F.col("m_high")))
    bad_low = (F.col("low_price") <= 0) | crossed | ((F.col("c_low") >= LEAST) & (F.col("lower") > F.col("f_low")) & (F.col("lower") > SPIKE * F.col("m_low")))
    flags = F.array_compact(F.array(F.when(bad_high, "high_price"), F.when(bad_low, "low_price"), F.when(F.col("volume") < 0, "volume")))
    own = j.select(F.col("observation_id").alias("record_id"), F.explode(flags).alias("field"))
    off = ((F.col("c_q") >= LEAST) & (F.abs(F.col("q_ohlc") - F.col("m_q")) > LEVEL)) | (F.col("q_ohlc") < 0) | (F.col("q_ohlc") > 1)
    rates = rated.join(norms, CELL).filter(off).select(F.col("quality_id").alias("record_id"), F.lit("q_ohlc").alias("field"))

    seq = _successive(d, "observation_id", ["high_price", "low_price", "volume"]).unionByName(_successive(rated, "quality_id", ["q_ohlc"]))
    v, m = F.col("value"), F.col("local_median")
    jump = (F.col("field") == "volume") & (F.col("c_volume") >= LEAST) & ((v > VOLUME_HIGH * m) | (v < VOLUME_LOW * m))
    near = seq.join(norms.select(*CELL, "c_volume"), CELL).filter(F.col("is_stuck") | jump).select("record_id", "field")
    return own.unionByName(rates).unionByName(near).distinct()


def p5_fences(spark: SparkSession, sf: str) -> DataFrame:
    """Values outside their cell's expanded interquartile fences by hour of day, jumps and flat values.

    A price is judged by its distance from the bar's body, as in ``p5_found``, volume and q_ohlc as they are.
    """
    d = materialize(_readings(spark, sf).filter("slot IS NOT NULL"), "readings")
    q = read_table(spark, sf, "quality_vector").filter(F.col("quality_id").isNotNull() & F.col("q_ohlc").isNotNull() & ~F.isnan("q_ohlc"))
    q = q.groupBy("quality_id", "observation_id").agg(F.min("q_ohlc").alias("q_ohlc"))
    rated = q.join(d.select("observation_id", *CELL, "slot", "at"), "observation_id").select(F.col("quality_id").alias("record_id"), *CELL, "slot", "at", "q_ohlc")
    own = d.select(F.col("observation_id").alias("record_id"), *CELL, "slot", "at", "upper", "lower", "volume")

    def sequence(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
        block = F.floor(F.col("slot") / F.lit(SLOTS_PER_BLOCK)).cast("long")
        n = implausible.numbered(rows, CELL, ["slot", "at", "record_id"], block, {f"n_{c}": c for c in fields.values()})
        pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(c).alias("value"), F.col(f"n_{c}").alias("number")) for f, c in fields.items()])
        return n.select("record_id", *CELL, "slot", F.explode(pairs).alias("x")).select("record_id", *CELL, "slot", "x.*")

    long = sequence(own, {"high_price": "upper", "low_price": "lower", "volume": "volume"}).unionByName(sequence(materialize(rated, "rated"), {"q_ohlc": "q_ohlc"}))
    hour = (F.floor(slot_start_ms(F.col("timeframe"), F.col("slot")) / F.lit(3_600_000.0)) % 24).cast("int")
    f = implausible.flag_by_fences(long, [*CELL, "field"], "value", "record_id", hour, factor=6.0, rate=4.0, number="number")
    return f.filter("is_outside OR is_jump OR is_flat").select("record_id", "field", "context", "is_outside", "is_jump", "is_flat")


# ---------------------------------------------------------------- 6 late records

CUTOFF_LENGTHS = 12


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Arriving records of both tables: tbl, cell, rec_id, event, arrival, allowed, volume, tf."""
    m = read_table(spark, sf, "market_observation")
    m = observations(m.filter("close_time IS NOT NULL AND retrieved_at IS NOT NULL"), times=("close_ms",), values=("volume",))
    m = m.select(F.lit("market_observation").alias("rec_table"), F.concat_ws(":", *CELL).alias("cell_id"), F.col("observation_id").alias("rec_id"), F.col("close_ms").alias("event"), F.col("retrieved_ms").alias("arrival"), (length_ms(F.col("timeframe")) * CUTOFF_LENGTHS).alias("allowed"), "volume")
    b = read_table(spark, sf, "research_bootstrap_progress")
    b = b.filter("cell_id IS NOT NULL AND cursor_ms IS NOT NULL AND updated_at IS NOT NULL")
    # a nameless timeframe is read off the cell_id
    tf = F.coalesce(F.when(F.col("timeframe") != "", F.col("timeframe")), F.substring_index("cell_id", ":", -1))
    b = b.select("cell_id", "cursor_ms", tf.alias("timeframe"), F.unix_millis(F.col("updated_at")).alias("at"), F.col("updated_at")).groupBy("cell_id", "cursor_ms", "timeframe").agg(F.min(F.unix_micros("updated_at")).alias("at_us"))
    b = b.select(F.lit("research_bootstrap_progress").alias("rec_table"), "cell_id", F.concat_ws("#", "cell_id", F.col("cursor_ms").cast("string")).alias("rec_id"), F.col("cursor_ms").alias("event"), F.floor(F.col("at_us") / 1000.0).cast("long").alias("arrival"), (length_ms(F.col("timeframe")) * CUTOFF_LENGTHS).alias("allowed"), F.lit(None).cast("double").alias("volume"))
    return m.unionByName(b)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    _, late = lateness.split_log(_records(spark, sf).drop("volume"), ["rec_table", "cell_id"], event="event", arrival="arrival", allowed="allowed")
    return late.select("rec_table", "rec_id")


def p6_days(spark: SparkSession, sf: str) -> DataFrame:
    """Corrected aggregates per cell and UTC day of the event time, with the records beyond the cut-off counted."""
    d = _records(spark, sf).filter("rec_table = 'market_observation'").withColumn("day", F.floor(F.col("event") / F.lit(float(DAY))).cast("long"))
    d = d.withColumn("volume", F.col("volume").cast("decimal(28,8)")).withColumn("end", (F.col("day") + 1) * DAY)
    v = lateness.replay_log(d, ["cell_id"], event="event", arrival="arrival", allowed="allowed", period="day", period_end="end", sums=["volume"])
    return v.select("cell_id", F.date_from_unix_date(F.col("day").cast("int")).alias("day"), "n", F.round(F.col("volume").cast("double"), 3).alias("volume"), "n_late", "state")


# ---------------------------------------------------------------- 7 as known at event time

#: Span of availability that one task holds of one cell.
KNOWN_BUCKET = 7 * DAY


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    known = observations(read_table(spark, sf, "market_observation"), status=KNOWN, times=("close_ms",))
    known = known.filter("close_ms IS NOT NULL AND retrieved_ms IS NOT NULL").withColumn("available", F.greatest("close_ms", "retrieved_ms"))
    known = known.withColumnRenamed("retrieved_ms", "retrieved")
    snaps = read_table(spark, sf, "snapshot_pit").filter("snapshot_id IS NOT NULL AND as_of IS NOT NULL").groupBy("snapshot_id").agg(F.min("as_of").alias("as_of"))
    e = read_table(spark, sf, "evidence_event").select("evidence_id", *CELL, "timestamp_utc", "snapshot_id").distinct()
    cited = F.coalesce(F.col("snapshot_id") != "", F.lit(False))
    with_snap = e.filter(cited).join(snaps, "snapshot_id", "left").select("evidence_id", *CELL, F.least("timestamp_utc", "as_of").alias("k"))
    e = with_snap.unionByName(e.filter(~cited).select("evidence_id", *CELL, F.col("timestamp_utc").alias("k")))
    e = e.groupBy("evidence_id", *CELL).agg(F.min(F.floor(F.unix_micros("k") / 1000.0).cast("long")).alias("k"))
    out = asof.known_at(e, known, CELL, at="k", available="available", rank=["close_ms", "retrieved", "observation_id"], keep="evidence_id", bucket=KNOWN_BUCKET)
    return out.filter("observation_id IS NOT NULL").select("evidence_id", "observation_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p2_found, p2_paths, p2_descendants, p2_pairs, p2_loops, p3_rolling, p4_found, p4_report, p5_found, p5_fences, p6_found, p6_days, p7_found)}
