"""Functions on arrays against known figures and plain brute force."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import statistics as st
from tidemark.functions import structure
from tidemark.operators import folds
from tidemark.plans import volatility


def test_averages_E04_F01_F02():
    trs = np.array([4.0, 4.2, 3.8, 5.0, 4.5, 4.1, 4.3, 4.0, 3.9, 4.4, 4.6, 4.2, 4.0, 4.1, 6.0])
    w = folds.wilder(trs, 14)
    assert w[13] == pytest.approx(4.221428571428571) and w[14] == pytest.approx((w[13] * 13 + 6) / 14) and np.isnan(w[12])
    rnd = np.random.default_rng(1).normal(size=700)
    y, want = 0.3, []
    for x in rnd:
        y = 0.9 * y + 0.25 * x
        want.append(y)
    assert np.allclose(folds.linear_recursion(rnd, 0.9, 0.25, 0.3), want)
    assert len(folds.wilder(np.zeros(0), 14)) == 0 and np.isnan(folds.ema(np.ones(3), 5)).all()


def test_true_range_over_a_gap_E04_F03_F04():
    for h, l, c in ((610, 590, 600), (620, 610, 600)):
        b = structure.Bars(*(np.array(x, float) for x in ([c, h], [c, h], [c, l], [c, l], [1, 1])))
        assert b.tr[1] == 20


def test_quantile_regimes_E04_F10():
    past = [0.01, 0.012, 0.015, 0.018, 0.022, 0.03, 0.04, 0.06]
    for value, want in ((0.012, 0), (0.0125, 1), (0.025, 2), (0.04, 3), (0.06, 4)):
        assert volatility.regimes(np.array([0.5, *past, value]), 8)[-1] == want
    assert list(volatility.regimes(np.array(past), 8)) == [2] * 8


def test_ljung_box_E04_F11():
    r2 = np.array([0.0004, 0.0001, 0.0009, 0.0004, 0.0006, 0.0002, 0.0008, 0.0003, 0.0005, 0.0007])
    q, p = st.ljung_box(r2, 2)
    assert q == pytest.approx(5.0569, abs=0.01) and p == pytest.approx(0.0798, abs=0.005)
    assert st.ljung_box(np.ones(30), 2) == (0.0, 1.0) and math.isnan(st.ljung_box(r2, 20)[0])


def test_tails():
    assert st.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05) and st.chi2_tail(31.410432844230918, 20) == pytest.approx(0.05)
    assert st.t_tails(2.0422724563012373, 30) == pytest.approx(0.05) and st.t_tails(0, 5) == 1
    assert st.normal_quantile(0.975) == pytest.approx(1.959963984540054) and st.normal_cdf(0) == 0.5
    for n, k in ((10, 7), (20, 20), (5, 0)):
        assert st.binomial_tail(k, n) == pytest.approx(sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n)
    assert st.poisson_tail(3, 1.5) == pytest.approx(1 - math.exp(-1.5) * (1 + 1.5 + 1.125))
    lo, hi = st.wilson(0.5, 100)
    assert lo == pytest.approx(0.4038, abs=1e-4) and hi == pytest.approx(0.5962, abs=1e-4)


def test_rank_statistics():
    rnd = random.Random(2)
    x = [rnd.choice([1, 2, 2, 3, 5]) for _ in range(25)]
    s = sum(np.sign(b - a) for i, a in enumerate(x) for b in x[i + 1 :])
    got = st.mann_kendall(np.array(x, float))
    ties = [x.count(v) for v in set(x)]
    assert got[0] == s and got[1] == pytest.approx((25 * 24 * 55 - sum(t * (t - 1) * (2 * t + 5) for t in ties)) / 18)
    assert list(st.mid_ranks(np.array([3.0, 1, 3, 2]))) == [3.5, 1, 3.5, 2]
    assert st.spearman(np.arange(9.0), np.arange(9.0) ** 3) == pytest.approx(1) and st.spearman(np.ones(4), np.arange(4.0)) == 0
    h, p = st.kruskal_wallis([np.array([1.0, 2, 3]), np.array([4.0, 5, 6]), np.array([7.0, 8, 9])])
    assert h == pytest.approx(7.2) and p == pytest.approx(math.exp(-3.6))
    assert math.isnan(st.kruskal_wallis([np.array([1.0])])[0])


def test_regressions():
    rng = np.random.default_rng(3)
    y = 2 + 0.5 * np.arange(80) + rng.normal(size=80)
    slope, error, r2 = st.trend_slope(y)
    assert slope == pytest.approx(np.polyfit(np.arange(80), y, 1)[0]) and 0 < error < 0.05 and r2 > 0.98
    rv = np.abs(rng.normal(size=400))
    beta, se, n = st.har_fit(rv)
    x = np.array([[1, rv[t], rv[t - 4 : t + 1].mean(), rv[t - 21 : t + 1].mean()] for t in range(22, 399)])
    assert np.allclose(beta, np.linalg.lstsq(x, rv[23:], rcond=None)[0]) and n == 377 and (se > 0).all()
    assert st.har_fit(rv[:20]) is None and st.har_fit(np.ones(100)) is None
    walk = np.exp(np.cumsum(rng.normal(size=200)) * 0.01)
    assert 0.5 < st.hurst_exponent(walk) < 1.5 and math.isnan(st.hurst_exponent(walk[:20]))


def test_garch_finds_the_likelier_parameters():
    rng = np.random.default_rng(4)
    s, r = 1e-4, []
    for _ in range(200):
        r.append(rng.normal() * math.sqrt(s))
        s = 1e-5 + 0.15 * r[-1] ** 2 + 0.75 * s
    r = np.array(r)
    o, a, b, cost = st.garch_fit(r)
    e = r - r.mean()

    def likelihood(o, a, b):
        s, total = o / (1 - a - b), 0.0
        for i, x in enumerate(e):
            s = s if not i else o + a * e[i - 1] ** 2 + b * s
            total += 0.5 * (math.log(2 * math.pi) + math.log(s) + x * x / s)
        return total

    assert cost == pytest.approx(likelihood(o, a, b)) and cost <= likelihood(1e-5, 0.15, 0.75) + 1 and 0 < a + b < 1
    assert st.garch_fit(r[:50]) is None and st.garch_fit(np.zeros(150)) is None


def bars(rows):
    return structure.Bars(*(np.array([r[i] for r in rows], float) for i in range(5)))


def test_swings_FIX_001_FIX_002():
    b = bars([(620, 625, 618, 622, 100), (622, 628, 620, 627, 110), (627, 632.4, 624.1, 631.2, 150), (631.2, 631.5, 626, 627, 120), (627, 629, 621, 623, 90)])
    assert [(s.kind, s.price, s.at, s.confirmed) for s in structure.fractal_swings(b)] == [("HIGH", 632.4, 2, 4)]
    b = bars([(100, 101, 99, 99.5, 10), (99.5, 100, 98, 98.5, 12), (98.5, 99, 97, 97.2, 15), (97.2, 99.5, 97.1, 99, 14)])
    assert [(s.kind, s.price, s.at) for s in structure.turn_swings(b)] == [("LOW", 97.0, 2)]


def warm(n, last):
    b = bars([(630, 632.1, 627.9, 630, 100)] * n + last)
    b.atr[:] = 4.2
    return b


def swing(kind, price, at, state="ACTIVE"):
    return structure.Swing(kind, price, at, at + 2, "FRACTAL", state=state)


def test_breaks_FIX_003_FIX_004():
    got = structure.breaks(warm(13, [(636, 639, 635.8, 638.9, 200)]), [swing("HIGH", 635.5, 10)])
    assert [g["event"] for g in got] == ["BREAK_UP"] and got[0]["magnitude"] == pytest.approx(0.8095238) and got[0]["strength"] > 0.6
    got = structure.breaks(warm(13, [(640, 642, 639, 641.5, 180)]), [swing("HIGH", 635.5, 5), swing("HIGH", 640, 8)])
    assert [round(g["magnitude"], 3) for g in got] == [1.429, 0.357] and [g["rank"] for g in got] == [1, 2]


def test_change_of_character_FIX_005():
    swings = [swing("LOW", 635, 1), swing("HIGH", 640, 3), swing("LOW", 630, 5), swing("HIGH", 632.4, 7), swing("LOW", 628, 9)]
    got = structure.reversals(warm(12, [(633, 639, 632.8, 638.9, 210)]), swings, [{"event": "BREAK_DOWN", "at": 11}])
    assert [g["event"] for g in got] == ["CHANGE_UP"]


def test_retest_and_invalidation_FIX_006_FIX_007():
    assert structure._after(warm(11, [(637, 637.5, 635.6, 635.8, 100)]), 10, 635.5, 1) == ("RETEST", 11)
    assert structure._after(warm(11, [(634, 635, 630, 631, 100)]), 10, 635.5, 1) == ("INVALIDATION", 11)
    assert structure._after(warm(12, []), 11, 635.5, 1) == ("NONE", -1)


def test_pruning_FIX_009():
    got = structure.merged_swings(warm(16, []), [swing("HIGH", 631.2, 5), swing("HIGH", 632.4, 7), swing("HIGH", 631.8, 8)], [])
    assert [s.state for s in got] == ["ACTIVE", "SHALLOW", "SHALLOW"]


def test_gap_zone_lives_and_merges():
    flat = [(100, 101, 99, 100, 10)] * 20
    up = [(100, 101, 99.5, 100.8, 10), (101, 106, 100.8, 105.8, 30), (105.8, 107, 103, 106.5, 20)]
    z = structure.gap_zones(bars(flat + up + [(106, 106.5, 102.5, 103, 10), (103, 103.5, 100, 100.5, 10)]))
    assert len(z) == 1 and (z[0]["lower"], z[0]["upper"], z[0]["direction"]) == (101.0, 103.0, "UP")
    assert z[0]["touched"] == 23 and z[0]["filled"] == 24 and z[0]["fate"] == "FILLED"
    z = structure.gap_zones(bars(flat + up + [(107, 108, 106, 107, 10)] * 120))
    assert z[0]["fate"] == "EXPIRED" and z[0]["ended"] - z[0]["at"] == 96 and z[0]["touched"] == -1
    assert structure.overlap_ratio((0, 10), (2, 12)) == pytest.approx(8 / 12) and structure.overlap_ratio((0, 1), (2, 3)) == 0


def test_order_block_is_retested_and_invalidated():
    flat = [(100, 101, 99, 100, 10)] * 20
    leg = [(100.8, 101, 99, 99.2, 10), (99.2, 103, 99.2, 102.8, 40), (102.8, 106, 102.5, 105.8, 30), (105.8, 107, 105, 106.5, 20), (106.5, 107, 106, 106.8, 10), (106.8, 107.5, 106, 107, 10)]
    tail = [(107, 107, 104, 104.5, 10), (104.5, 104.6, 99.2, 100.2, 10), (100, 100.2, 95, 95.2, 10)]
    z = [x for x in structure.order_blocks(bars(flat + leg + tail), [{"event": "BREAK_UP", "at": 22}], []) if x["at"] == 20]
    assert len(z) == 1 and z[0]["direction"] == "UP" and z[0]["quality"] == "Q3" and z[0]["confirmed"] == 22
    assert z[0]["retested"] == 27 and z[0]["ended"] == 28 and z[0]["fate"] == "INVALIDATED"


def test_levels_and_pools():
    prices = np.array([100.0, 100.1, 100.2, 100.9, 105.0])
    groups = structure.equal_levels(prices, 0.2)
    assert [list(g) for g in groups] == [[100.0, 100.1, 100.2], [100.9], [105.0]] and structure.equal_levels(np.zeros(0), 1) == []
    assert [list(g) for g in structure.equal_levels(np.array([1.0, 1.35, 1.35]), 0.2)] == [[1.0], [1.35, 1.35]]
    rnd = random.Random(5)
    for _ in range(20):
        p = np.sort(np.array([rnd.uniform(0, 20) for _ in range(30)]))
        got = structure.density_pools(p, 0.8, 3)
        core = [sum(abs(a - b) <= 0.8 for b in p) >= 3 for a in p]
        for i in range(30):
            for j in range(i):
                if core[i] and core[j] and p[i] - p[j] <= 0.8:
                    assert got[i] == got[j] >= 0
            assert (got[i] < 0) == (not any(core[j] and abs(p[i] - p[j]) <= 0.8 for j in range(30)))
    assert structure.volume_imbalance(np.arange(100.0), np.ones(100), 5) > 0.2 and structure.volume_imbalance(np.ones(3), np.ones(3), 50) == 0
    assert structure.hit_probability(0.0, 0.01, 100) == 1 and structure.hit_probability(5.0, 0.001, 10) < 1e-6


def test_chunks_see_what_the_whole_key_shows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    c = 100 * np.exp(np.cumsum(rng.normal(size=900) * 0.004))
    o = np.concatenate([[100.0], c[:-1]])
    p = pd.DataFrame({"symbol": "A", "timeframe": "1h", "n": np.arange(1, 901), "o": o, "h": np.maximum(o, c) * 1.002, "l": np.minimum(o, c) * 0.998, "c": c, "v": 1 + rng.random(900), "len_ms": 3_600_000})
    whole = volatility.bar_state(p)
    got = folds.chunk_fold(spark.createDataFrame(p), ["symbol", "timeframe"], "n", volatility.bar_state, volatility._STATE, before=500, chunk=256 * 2).toPandas().sort_values("n")
    assert list(got["n"]) == list(range(1, 901))
    for col in ("atr_14", "ewma_vol", "hv_30", "volatility_ratio"):
        a, b = whole[col].to_numpy(float), got[col].to_numpy(float)
        assert np.allclose(a, b, equal_nan=True, rtol=1e-4)
    assert folds.chunk_fold(spark.createDataFrame(p).limit(0), ["symbol", "timeframe"], "n", volatility.bar_state, volatility._STATE).count() == 0
