"""Replay of signals over bars, statistics of the trades, cumulative series and chain checks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.features import DERIVED, EVENTS, expand
from tidemark.operators.scan import running_max, running_sum, with_halo
from tidemark.plans.bars import numbered_bars
from tidemark.plans.market import CELL
from tidemark.sources.tables import materialize, read_table, small_side

HOLD, STOP_ATR, TARGET_R, COST_R = 48, 0.5, 2.0, 0.05
#: Bars of a cell whose trades one task walks; over HOLD.
SPAN = 4096
#: Sequential test: win rates of the two hypotheses and the error bounds of either kind.
P0, P1, ALPHA, BETA = 0.35, 0.50, 0.05, 0.10


def replay(bars: DataFrame) -> DataFrame:
    """Trades of the reclaimed-low signal: cell, n (signal bar), entry, stop, target, held, reason, r.

    A bar that sweeps the low of the 20 bars before it and closes back above signals a long entry at
    the next open, with the stop half an ATR under the swept low and the target at twice the risk. The
    first later bar (of ``HOLD``) that touches the stop or, failing that, the target ends it, else the
    last one's close. r is the result in units of risk less costs. A signal without a next bar gives
    no trade. Bars after a signal are met by an equi-join on their numbers, never by a range join.
    """
    part = "symbol, timeframe, _chunk"
    d = with_halo(bars, CELL, "n", before=21, after=1)
    d = d.selectExpr("*", f"{expand(DERIVED['tr'], part)} AS tr")
    d = d.selectExpr(*CELL, "n", "l", "_own", "_chunk", f"{expand(EVENTS['sweep_low'], part)} AS hit", f"avg(tr) OVER (PARTITION BY {part} ORDER BY n ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr", f"lead(o) OVER (PARTITION BY {part} ORDER BY n) AS entry")
    s = d.filter("_own = _chunk AND hit AND entry IS NOT NULL").withColumn("stop", F.col("l") - STOP_ATR * F.col("atr")).filter("entry > stop")
    s = s.select(*CELL, "n", "entry", "stop", (F.col("entry") + TARGET_R * (F.col("entry") - F.col("stop"))).alias("target"))
    later = s.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(HOLD)))).withColumn("at", F.col("n") + F.col("k"))
    j = later.join(bars.select(*CELL, F.col("n").alias("at"), "h", "l", "c"), [*CELL, "at"])
    how = F.when(F.col("l") <= F.col("stop"), "STOP").when(F.col("h") >= F.col("target"), "TARGET")
    g = j.groupBy(*CELL, "n", "entry", "stop", "target").agg(F.min(F.when(how.isNotNull(), F.struct("k", how.alias("how")))).alias("x"), F.max(F.struct("k", "c")).alias("z"))
    price = F.when(F.col("x.how") == "STOP", F.col("stop")).when(F.col("x.how") == "TARGET", F.col("target")).otherwise(F.col("z.c"))
    return g.select(*CELL, "n", "entry", "stop", "target", F.coalesce("x.k", "z.k").alias("held"), F.coalesce("x.how", F.lit("TIME")).alias("reason"), F.round((price - F.col("entry")) / (F.col("entry") - F.col("stop")) - COST_R, 6).alias("r"))


def one_at_a_time(trades: DataFrame) -> DataFrame:
    """Those trades of :func:`replay` that a walk makes which skips signals while a trade is open.

    The first signal of a cell is taken; the next is the first one after the exit bar (n + held). A
    cell is walked in spans of ``SPAN`` bars. As no trade is held over ``HOLD`` bars, a span is
    entered with its first 0 to ``HOLD`` bars still taken: each span is folded once for every such
    entry, a fold over one row of these per span finds the true one, then the span is walked with it.
    """
    rest = [c for c in trades.columns if c not in (*CELL, "n")]
    d = trades.select(*CELL, F.floor((F.col("n") - 1) / F.lit(float(SPAN))).cast("long").alias("span"), F.struct("n", *rest).alias("x"))
    d = materialize(d.groupBy(*CELL, "span").agg(F.sort_array(F.collect_list("x")).alias("xs")), "spans")
    ends = d.selectExpr(*CELL, "span", f"transform(sequence(0, {HOLD}), k -> aggregate(xs, span * {SPAN} + 1 + k, (free, t) -> if(t.n >= free, t.n + t.held + 1, free))) AS ends")
    cells = ends.groupBy(*CELL).agg(F.sort_array(F.collect_list(F.struct("span", "ends"))).alias("spans"))
    late = f"cast(greatest(a.free - (s.span * {SPAN} + 1), 0L) AS int)"
    step = f"named_struct('free', element_at(s.ends, {late} + 1), 'entries', concat(a.entries, array(named_struct('span', s.span, 'late', {late}))))"
    entries = cells.selectExpr(*CELL, f"inline(aggregate(spans, named_struct('free', 0L, 'entries', cast(array() AS array<struct<span: bigint, late: int>>)), (a, s) -> {step}).entries)")
    walk = f"aggregate(xs, named_struct('free', span * {SPAN} + 1 + late, 'taken', slice(xs, 1, 0)), (a, t) -> if(t.n >= a.free, named_struct('free', t.n + t.held + 1, 'taken', concat(a.taken, array(t))), a)).taken"
    return d.join(small_side(materialize(entries, "entries")), [*CELL, "span"]).selectExpr(*CELL, f"inline({walk})")


def trade_replay(spark: SparkSession, sf: str) -> DataFrame:
    return replay(numbered_bars(spark, sf)).select(*CELL, "n", "held", "reason", "r")


def _metrics(trades: DataFrame) -> DataFrame:
    t = trades.withColumn("d", F.col("r").cast("decimal(18,6)"))
    g = t.groupBy("timeframe").agg(F.count("*").alias("n"), F.count(F.when(F.col("r") > 0, 1)).alias("wins"), F.sum("d").cast("double").alias("total"), F.stddev_samp("r").alias("sd"), F.sum(F.when(F.col("r") > 0, F.col("d"))).cast("double").alias("up"), F.sum(F.when(F.col("r") < 0, -F.col("d"))).cast("double").alias("down"))
    mean = F.col("total") / F.col("n")
    return g.select("timeframe", "n", F.round(F.col("wins") / F.col("n"), 6).alias("win_rate"), F.round(mean, 6).alias("expectancy"), F.round("sd", 6).alias("deviation"), F.round(F.col("up") / F.nullif(F.col("down"), F.lit(0.0)), 6).alias("profit_factor"), F.round(mean / F.nullif(F.col("sd"), F.lit(0.0)), 6).alias("mean_to_deviation"))


def trade_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per timeframe: trades, win rate, expectancy, deviation, profit factor and ratio of mean to deviation."""
    return _metrics(replay(numbered_bars(spark, sf)))


def _drawdown(trades: DataFrame) -> DataFrame:
    t = trades.select(*CELL, "n", F.col("r").cast("decimal(18,6)").alias("r"))
    e = running_sum(t, CELL, "n", "r", "equity")
    e = running_max(e.select(*CELL, "n", "equity"), CELL, "n", "equity", "peak", bucket=4096, strict=False)
    fall = F.greatest("peak", F.lit(0).cast("decimal(28,6)")) - F.col("equity")
    return e.groupBy(*CELL).agg(F.count("*").alias("n"), F.max_by("equity", "n").cast("double").alias("equity"), F.max(fall).cast("double").alias("max_drawdown"))


def trade_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: final sum of r and the deepest fall of the running sum from its peak (from 0)."""
    return _drawdown(replay(numbered_bars(spark, sf)))


def _sequential(t: DataFrame) -> DataFrame:
    win, loss = round(math.log(P1 / P0), 9), round(math.log((1 - P1) / (1 - P0)), 9)
    t = t.select(*CELL, "n", F.when(F.col("r") > 0, F.lit(win)).otherwise(F.lit(loss)).cast("decimal(18,9)").alias("step"))
    t = running_sum(t, CELL, "n", "step", "llr")
    upper, lower = math.log((1 - BETA) / ALPHA), math.log(BETA / (1 - ALPHA))
    llr = F.col("llr").cast("double")
    verdict = F.when(llr >= upper, "ACCEPT").when(llr <= lower, "REJECT")
    g = t.groupBy(*CELL).agg(F.count("*").alias("trades"), F.min(F.when(verdict.isNotNull(), F.struct("n", verdict.alias("v")))).alias("x"), F.max_by(llr, "n").alias("llr"))
    return g.select(*CELL, "trades", F.coalesce("x.n", F.lit(-1)).alias("decided_at"), F.coalesce("x.v", F.lit("CONTINUE")).alias("verdict"), F.round("llr", 6).alias("llr"))


def sequential_test(spark: SparkSession, sf: str) -> DataFrame:
    """Per cell: Wald's test of the win rate, the first trade at which it decides, and how."""
    return _sequential(replay(numbered_bars(spark, sf)))


def single_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The trades of a replay that holds one trade of a cell at a time."""
    return one_at_a_time(trade_replay(spark, sf))


def single_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`trade_metrics` of the trades of :func:`single_replay`."""
    return _metrics(single_replay(spark, sf))


def single_drawdown(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`trade_drawdown` of the trades of :func:`single_replay`."""
    return _drawdown(single_replay(spark, sf))


def single_test(spark: SparkSession, sf: str) -> DataFrame:
    """:func:`sequential_test` of the trades of :func:`single_replay`."""
    return _sequential(single_replay(spark, sf))


def obv(spark: SparkSession, sf: str) -> DataFrame:
    """On-balance volume over a cell's whole history, as a running sum over chunks."""
    part = "symbol, timeframe, _chunk"
    d = with_halo(numbered_bars(spark, sf), CELL, "n", before=1)
    d = d.selectExpr(*CELL, "open_ms", "n", "_own", "_chunk", f"cast(coalesce(signum(c - {expand('{c:1}', part)}) * v, 0) AS decimal(28,8)) AS flow").filter("_own = _chunk")
    d = running_sum(d.select(*CELL, "open_ms", "n", "flow"), CELL, "n", "flow", "obv")
    return d.select(*CELL, "open_ms", F.round(F.col("obv").cast("double"), 3).alias("obv"))


def chain_check(spark: SparkSession, sf: str) -> DataFrame:
    """Links of the recovery log by kind: ROOT, LINKED to an earlier row, FORWARD to a later one, BROKEN."""
    d = read_table(spark, sf, "ops_recovery_log").filter("payload_hash <> ''").groupBy("payload_hash").agg(F.min("created_at").alias("at"), F.min(F.when(F.col("parent_hash") != "", F.col("parent_hash"))).alias("parent"), F.min("kind").alias("kind"))
    p = d.select(F.col("payload_hash").alias("parent"), F.col("at").alias("parent_at"), F.lit(True).alias("known"))
    link = F.when(F.col("parent").isNull(), "ROOT").when(F.col("known").isNull(), "BROKEN").when(F.col("parent_at") <= F.col("at"), "LINKED").otherwise("FORWARD")
    return d.join(p, "parent", "left").groupBy("kind", link.alias("link")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (trade_replay, trade_metrics, trade_drawdown, sequential_test, single_replay, single_metrics, single_drawdown, single_test, obv, chain_check)}
