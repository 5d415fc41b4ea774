"""Indicators, phases, patterns, ledger and settings on small inputs; the dealt queries on empty tables and null rows."""

import math
from decimal import Decimal
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tidemark.functions import patterns, phases, structure
from tidemark.plans import temporal, trend, upkeep
from tidemark.sources import ledger, tables

TABLES = Path("/root/testdata/sf0.001")


def bars(rows):
    return structure.Bars(*(np.array([r[i] for r in rows], float) for i in range(5)))


def test_directional_index_FIX_04():
    rows = [(1, 2, 0.5, 1.5), (1.5, 2.5, 1, 2), (2, 3, 1.5, 2.8), (2.8, 3.5, 2, 3.2), (3.2, 4, 2.5, 3.8), (3.8, 4.5, 3, 4.2), (4.2, 5, 3.5, 4.8), (4.8, 5.5, 4, 5.2), (5.2, 6, 4.5, 5.8), (5.8, 6.5, 5, 6.2), (6.2, 7, 5.5, 6.8), (6.8, 7.5, 6, 7.2), (7.2, 8, 6.5, 7.8), (7.8, 8.5, 7, 8.2), (8.2, 9, 7.5, 8.8)]
    h, l, c = (np.array([r[i] for r in rows], float) for i in (1, 2, 3))
    plus, minus, adx = trend.directional(h, l, c)
    assert (plus[-1], minus[-1], adx[-1]) == pytest.approx((33.3333333333, 0.0, 100.0)) and np.isnan(adx[:-1]).all()
    assert all(len(x) == 0 for x in trend.directional(*[np.zeros(0)] * 3))


def frame(c, spread=0.001):
    c = np.asarray(c, float)
    return pd.DataFrame({"n": np.arange(1, len(c) + 1), "open_ms": np.arange(len(c)) * 60_000, "o": c, "h": c * (1 + spread), "l": c * (1 - spread), "c": c, "v": 1.0 + np.arange(len(c)) % 7})


def test_indicators_start_at_their_own_length():
    d = trend.indicator_rows(frame(100 + np.sin(np.arange(60))))
    first = {k: int(d[k].notna().idxmax()) for k in ("ema_20", "rma_14", "atr_wilder", "macd", "macd_signal", "rsi_14", "adx_14")}
    assert first == {"ema_20": 19, "rma_14": 13, "atr_wilder": 14, "macd": 25, "macd_signal": 33, "rsi_14": 14, "adx_14": 14}
    flat = trend.indicator_rows(frame([5.0] * 40))
    assert flat["rsi_14"].iloc[-1] == 100 and flat["rsi_14_neutral"].iloc[-1] == 50
    assert len(trend.indicator_rows(frame([]))) == 0 and len(trend.momentum_rows(frame([1.0]))) == 1


def test_trend_and_momentum_of_a_rise():
    d = trend.trend_rows(frame(np.linspace(100, 140, 80)), 20)
    assert len(d) == 61 and (d["direction"] == 1).all() and d["r2"].min() > 0.99 and (d["mk_s"] == 190).all()
    m = trend.momentum_rows(frame(np.concatenate([np.full(90, 100.0), np.linspace(100, 130, 12)])))
    assert m["momentum_z"].iloc[-1] > 2 and m["momentum_z"].iloc[:49].isna().all()


def test_regimes_are_probabilities():
    rng = np.random.default_rng(1)
    d = temporal.regime_rows(frame(100 * np.exp(np.cumsum(rng.normal(size=300) * 0.002))))
    p = d[["p_calm", "p_up", "p_down", "p_wild"]].to_numpy()
    assert np.allclose(p.sum(axis=1), 1) and d["entropy"].between(0, 1).all() and (d["turbulence"] >= 0).all()
    run = 0
    for i in range(1, len(d)):  # a state changes only after three bars of it
        run = run + 1 if d["raw_state"][i] == d["raw_state"][i - 1] else 0
        assert d["state"][i] == d["state"][i - 1] or run >= 2


def test_phases():
    p = phases.phase_probabilities(10.0, 9.0, 11.0, 0.4, 0.5, 3)
    assert p.sum() == pytest.approx(1) and len(p) == len(phases.PHASES) and phases.PHASES[int(p.argmax())] == "ACCUMULATION"
    flat = [(100, 100.6, 99.4, 100, 10)] * 30
    got = phases.phase_events(bars(flat + [(100, 100.1, 99.2, 99.9, 30)]))
    assert {"RANGE", "SPRING"} <= {g["event"] for g in got}
    base = [(100, 101, 99, 100, 10 + i % 3) for i in range(30)]
    got = phases.block_sweeps(bars([*base, (100, 100.5, 98, 99.8, 90)]))
    assert [g["event"] for g in got] == ["BLOCK_SWEEP_LOW"] and got[0]["size"] == 1 and got[0]["turn"] == pytest.approx(0.8)
    dip = base + [(100, 101, 99, c, 10) for c in (100, 100, 100, 99.8, 99.9, 100.1, 100)]
    assert "FALSE_MOVE_DOWN" in {g["event"] for g in phases.false_moves(bars(dip))}
    quiet = [(100, 103, 97, 100 + (-1) ** i, 20) for i in range(110)] + [(100, 100.5, 99.5, 100, 10)] * 20
    assert any(g["event"] == "TIGHT_RANGE" for g in phases.tight_ranges(bars(quiet)))


def test_double_top_breaks_its_line():
    up = [100 + i for i in range(10)] + [109 - i for i in range(1, 6)] + [104 + i for i in range(1, 6)] + [109 - i for i in range(1, 12)]
    b = bars([(c, c + 0.5, c - 0.5, c, 10) for c in [100] * 16 + up])
    got = {g["pattern"]: g for g in patterns.chart_patterns(b, structure.fractal_swings(b))}
    assert got["DOUBLE_TOP"]["direction"] == "DOWN" and got["DOUBLE_TOP"]["line"] == 103.5
    assert patterns.ladder(100, 200, (0.5, 1.618)) == pytest.approx([150, 261.8])


def test_canonical_json():
    assert ledger.canonical_json({"b": Decimal("1.50"), "a": [-0.0, Decimal("-0"), "ä"], "c": None}) == '{"a":[0.0,"0","ä"],"b":"1.50","c":null}'
    for bad in (math.nan, Decimal("Infinity"), {1: 2}):
        with pytest.raises(ValueError):
            ledger.canonical_json([bad])
    assert ledger.content_id({"x": 1}) == ledger.content_id({"x": 1}) != ledger.content_id({"x": 2})


def test_ledger_is_a_chain(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([("c", i, "FILL", f'{{"q":{i}}}') for i in range(3)], "chain string, number long, kind string, payload string")
    two = spark.createDataFrame([("c", 3, "NOTE", "{}"), ("d", 0, "FILL", "{}")], one.schema)
    ledger.append(spark, path, one, "1")
    ledger.append(spark, path, two, "2")
    ledger.append(spark, path, two, "2")  # run again after a failure
    d = ledger.read(spark, path)
    assert {r["chain"]: tuple(r)[1:] for r in ledger.verify(d).collect()} == {"c": (4, 0, 0, 0), "d": (1, 0, 0, 0)}
    from pyspark.sql import functions as F

    forged = d.withColumn("payload", F.when(F.col("number") == 1, "{}").otherwise(F.col("payload")))
    assert ledger.verify(forged).filter("chain = 'c'").first()["bad_payloads"] == 1
    assert ledger.verify(d.filter("number <> 1")).filter("chain = 'c'").first()["bad_parents"] == 1


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError):
            tables.shared_dir(Session())


@pytest.fixture(scope="module")
def poor_tables(tmp_path_factory):
    """The tables without rows, and with a few rows and rows of nothing but nulls."""
    empty, nulls = (tmp_path_factory.mktemp(n) for n in ("empty", "nulls"))
    for f in TABLES.glob("*.parquet"):
        t = pq.read_table(f)
        pq.write_table(t.slice(0, 0), empty / f.name)
        none = pa.table({c: pa.nulls(3, t.schema.field(c).type) for c in t.column_names}).cast(t.schema)
        pq.write_table(pa.concat_tables([t.slice(0, 40), none]), nulls / f.name)
    return str(empty), str(nulls)


@pytest.mark.skipif(not TABLES.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(upkeep.QUERIES))
def test_dealt_queries_on_poor_tables(spark, poor_tables, name):
    empty, nulls = poor_tables
    assert upkeep.QUERIES[name](spark, empty).count() == 0
    upkeep.QUERIES[name](spark, nulls).count()
