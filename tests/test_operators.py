"""Edge cases of the core operators on small fixtures."""

import random
import statistics
from collections import defaultdict
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from tidemark.functions.timegrid import instant_ms, number, slot_index, slot_start_ms
from tidemark.operators import asof, hierarchy, implausible, lateness, orphans, regular_grid, rolling, scan
from tidemark.plans import bars, research, upkeep


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_instants_and_numbers(spark):
    texts = ["2024-03-24T03:51:00.000Z", "2024-03-24T05:51:00.000+02:00", "2024-03-23T22:51:00.000-05:00", "2024-03-24T03:51:00Z", "1711252260000", " 2024-03-24T03:51:00 ", "nonsense", "", None]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(instant_ms(F.col("t"))).collect()]
    assert got == [1711252260000] * 6 + [None] * 3
    ns = [r[0] for r in spark.createDataFrame([(0, "1.5E+3"), (1, "x"), (2, None), (3, "NaN"), (4, "-2")], "i int, t string").orderBy("i").select(number(F.col("t"))).collect()]
    assert ns == [1500.0, None, None, None, -2.0]


def test_slots_round_trip(spark):
    d = spark.createDataFrame([(tf, ms) for tf in ("1m", "1h", "1w", "1mo", "8h") for ms in (0, -1, 1711252260123, 951782400000)], "tf string, ms long")
    d = d.withColumn("i", slot_index(F.col("tf"), F.col("ms"))).withColumn("s", slot_start_ms(F.col("tf"), F.col("i"))).withColumn("e", slot_start_ms(F.col("tf"), F.col("i") + 1))
    assert d.filter("NOT (s <= ms AND ms < e)").count() == 0


def test_running_max_equals_brute_force(spark):
    rnd = random.Random(1)
    data = [(rnd.choice(["a", "a", "a", "b", None]), rnd.randrange(40), rnd.choice([None, *range(9)]), i) for i in range(300)]
    d = spark.createDataFrame(data, "k string, t int, v int, i int")
    for strict in (True, False):
        got = {r["i"]: r["top"] for r in scan.running_max(d, ["k"], "t", "v", "top", bucket=7, strict=strict).collect()}
        crowded = scan.running_max(d, ["k"], "t", "v", "top", bucket=7, strict=strict, heavy=3).collect()
        assert {r["i"]: r["top"] for r in crowded} == got
        for k, t, _, i in data:
            if k is None:
                assert i not in got
            else:
                before = [v2 for k2, t2, v2, _ in data if k2 == k and v2 is not None and (t2 < t or not strict and t2 == t)]
                assert got[i] == (max(before) if before else None)
    assert scan.running_max(d.limit(0), ["k"], "t", "v", "top", bucket=7, strict=True).count() == 0


def test_counter_reset_share_and_gap(spark):
    # 10 units up to 2.5, reset, 4 units up to 4.5, nothing vouches for cells 5 to 6, then 3 units within cell 7
    d = spark.createDataFrame([("m", None, 0.5, 100.0, 0), ("m", None, 2.5, 110.0, 0), ("m", None, 4.5, 4.0, 0), ("m", 7.25, 7.75, 7.0, 1), ("n", None, 1.0, None, 0), (None, None, 1.0, 1.0, 0)], "k string, s double, e double, v double, c int")
    seg = regular_grid.counter_segments(d, ["k"], start="s", end="e", counter="v", chunk="c")
    grid = {r["slot"]: r for r in regular_grid.spread_on_grid(seg, ["k"]).collect()}
    assert [grid[i]["amount"] for i in (0, 1, 2, 3, 4)] == [2.5, 5.0, 2.5 + 1.0, 2.0, 1.0]
    assert grid[2]["n_resets"] == 1 and grid[0]["coverage"] == 0.5 and grid[7]["amount"] == 3.0 and grid[7]["coverage"] == 0.5
    assert [i for i, r in sorted(grid.items()) if r["status"] == "lacking"] == [5, 6]
    assert regular_grid.spread_on_grid(regular_grid.counter_segments(d.limit(0), ["k"], start="s", end="e", counter="v", chunk="c"), ["k"]).count() == 0


def test_hierarchy(spark):
    chain = [(f"n{i:03}", f"n{i - 1:03}" if i else None) for i in range(70)]
    extra = [("x", "nowhere"), ("y", ""), ("l1", "l2"), ("l2", "l3"), ("l3", "l1"), ("tail", "l3"), ("tail2", "tail"), ("self", "self"), (None, "x"), ("", "x"), ("x", "nowhere")]
    d = spark.createDataFrame([(a, b, 1) for a, b in chain + extra], "id string, parent string, tbl int")
    links = hierarchy.parent_links(d, "id", "parent", "t")
    got = {r["node_id"]: (r["root_id"], r["depth"]) for r in hierarchy.resolve(links).collect()}
    assert all(got[f"n{i:03}"] == ("n000", i) for i in range(70))
    assert got["x"] == ("x", 0) and got["y"] == ("y", 0) and got["self"] == ("self", -1)
    assert all(got[k] == ("l1", -1) for k in ("l1", "l2", "l3", "tail", "tail2")) and len(got) == 78
    paths = hierarchy.full_paths(links)
    assert paths.filter("node_id = 'n069'").first()["path"] == [a for a, _ in chain]
    counts = {r["node_id"]: (r["n_descendants"], r["height"]) for r in hierarchy.descendant_counts(links).collect()}
    assert counts["n000"] == (69, 69) and counts["n069"] == (0, 0) and counts["tail"] == (1, 1) and len(counts) == 78
    assert all(counts[k] == (4, -1) for k in ("l1", "l2", "l3")) and counts["self"] == (0, -1) and counts["tail2"] == (0, 0)
    assert hierarchy.descendant_counts(links.limit(0)).count() == 0
    pairs = hierarchy.ancestor_pairs(hierarchy.upward_paths(links)).groupBy("ancestor_id").count().collect()
    assert {r["ancestor_id"]: r["count"] for r in pairs} == {k: n for k, (n, _) in counts.items() if n}
    assert hierarchy.resolve(links.limit(0)).count() == 0 and hierarchy.full_paths(links.limit(0)).count() == 0


def test_trailing_totals_equal_brute_force(spark):
    rnd = random.Random(2)
    data = [("a", date(2024, 1, d), rnd.choice([None, rnd.randrange(100)])) for d in sorted(rnd.sample(range(1, 32), 17))] + [("b", date(2024, 1, 5), 3)]
    d = spark.createDataFrame([(k, day, v, 1) for k, day, v in data], "k string, day date, v long, junk int")
    got = rolling.trailing_totals(d, ["k"], "day", ["v"], (1, 7, 30)).collect()
    have = defaultdict(int, {(k, day.toordinal()): v or 0 for k, day, v in data})
    first = {k: min(x.toordinal() for kk, x, _ in data if kk == k) for k in "ab"}
    last = {k: max(x.toordinal() for kk, x, _ in data if kk == k) for k in "ab"}
    assert len(got) == sum(last[k] - first[k] + 1 for k in "ab")
    for r in got:
        for w in (1, 7, 30):
            assert r[f"v_{w}"] == sum(have[r["k"], r["day"].toordinal() - i] for i in range(w))


def test_orphans_with_a_hot_key(spark):
    child = spark.createDataFrame([(i, "hot") for i in range(1500)] + [(2000 + i, "fine") for i in range(1500)] + [(9000, "lost"), (9001, ""), (9002, None), (9003, "Fine"), (9000, "lost")], "id int, ref string").withColumn("n", F.lit(7))
    parent = spark.createDataFrame([("fine",), ("fine",), (None,), ("other",)], "key string")
    gone = orphans.dangling(orphans.count_references(child, "ref", F.lit("all")), parent, "key")
    assert rows(gone.select("ref_key", "n", "is_heavy")) == [("Fine", 1, False), ("hot", 1500, True), ("lost", 2, False)]
    found = rows(orphans.dangling_rows(child, "id", "ref", gone))
    assert len(found) == 1502 and (9000, "lost") in found and (9003, "Fine") in found
    assert len(rows(orphans.dangling(orphans.count_references(child, "ref", F.lit("all")), parent.limit(0), "key"))) == 4
    assert orphans.dangling(orphans.count_references(child.limit(0), "ref", F.lit("all")), parent, "key").count() == 0


def test_exact_medians_with_narrowing(spark, monkeypatch):
    rnd = random.Random(3)
    data = [("a", rnd.gauss(0, 1)) for _ in range(4001)] + [("b", float(rnd.randrange(3))) for _ in range(800)] + [("c", 5.0), ("c", None)]
    d = spark.createDataFrame(data, "k string, v double")
    monkeypatch.setattr(implausible, "EXACT_ROWS", 60)
    sketches = implausible.merge_sketches(implausible.source_sketches(d, ["k"], "v", (F.hash("v") % 3)), ["k"])
    got = {r["k"]: r["median"] for r in implausible.exact_medians(d, ["k"], "v", sketches).collect()}
    for k in "abc":
        assert got[k] == statistics.median(v for kk, v in data if kk == k and v is not None)


def test_neighbourhoods_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(implausible, "CHUNK", 16)
    rnd = random.Random(4)
    values = [rnd.choice([1.0, 1.0, 1.0, 2.0]) for _ in range(30)] + [7.0] * 9 + [rnd.random() for _ in range(40)]
    d = spark.createDataFrame([("k", i + 1, v) for i, v in enumerate(values)], "k string, n int, v double")
    got = {r["n"]: (r["is_stuck"], r["local_median"]) for r in implausible.neighbourhoods(d, ["k"], "n", "v", reach=7, run=8).collect()}
    assert len(got) == len(values)
    for i, v in enumerate(values):
        lo = hi = i
        while lo and values[lo - 1] == v:
            lo -= 1
        while hi + 1 < len(values) and values[hi + 1] == v:
            hi += 1
        assert got[i + 1] == (hi - lo + 1 >= 8, statistics.median(values[max(0, i - 7) : i + 8]))


def test_numbered(spark):
    d = spark.createDataFrame([("k", i, i % 3 or None) for i in range(50)] + [("j", 1, 1)], "k string, s int, v int")
    got = {(r["k"], r["s"]): (r["n"], r["m"]) for r in implausible.numbered(d, ["k"], ["s"], F.floor(F.col("s") / 8), {"n": "s", "m": "v"}).collect()}
    assert all(got["k", i] == (i + 1, sum(1 for j in range(i + 1) if j % 3)) for i in range(50)) and got["j", 1] == (1, 1)


def test_known_at(spark):
    events = spark.createDataFrame([("c", 10, "e1"), ("c", 20, "e2"), ("c", 5, "e0"), ("d", 9, "e3"), (None, 1, "e4"), ("c", None, "e5")], "k string, at int, id string")
    changes = spark.createDataFrame([("c", 10, 3, "x", 0), ("c", 12, 2, "y", 0), ("c", 20, 3, "z", 0), ("c", 21, 9, "late", 0)], "k string, known int, r int, name string, at int")
    got = {r["id"]: r["name"] for r in asof.known_at(events, changes, ["k"], at="at", available="known", rank=["r", "name"], keep="id", bucket=4).collect()}
    assert got == {"e0": None, "e1": "x", "e2": "z", "e3": None}
    assert asof.known_at(events, changes.limit(0), ["k"], at="at", available="known", rank=["r", "name"], keep="id", bucket=4).filter("name IS NOT NULL").count() == 0


def test_lateness_and_lambda_view(spark):
    rec = spark.createDataFrame([("c", 100, 1, 5), ("c", 80, 1, 5), ("c", 95, 2, 5), ("c", 94, 2, 5), ("c", None, 3, 5), (None, 1, 1, 5)], "k string, e int, a int, w int")
    got = rows(lateness.beyond_cutoff(rec, ["k"], event="e", arrival="a", allowed="w").select("e", "is_late"))
    assert got == [(80, False), (94, True), (95, False), (100, False)]
    batch = spark.createDataFrame([("c", 1, 2), ("c", 2, 3)], "k string, p int, v int")
    late = spark.createDataFrame([("c", 1, 5)], "k string, p int, v int")
    view = lateness.LambdaView.empty(batch, by=["k", "p"], sums=["v"]).fast(batch).fast(late)
    assert rows(view.view().select("p", "n", "v", "state")) == [(1, 2, 7, "provisional"), (2, 1, 3, "provisional")]
    view = view.recompute(spark.createDataFrame([("c", 1)], "k string, p int"))
    assert rows(view.view().select("p", "n", "v", "state")) == [(1, 2, 7, "frozen"), (2, 1, 3, "provisional")]
    assert rows(view.fast(late.withColumn("p", F.lit(2))).view().select("p", "n", "v", "state")) == [(1, 2, 7, "frozen"), (2, 2, 8, "provisional")]


def test_fences(spark):
    d = spark.createDataFrame([("k", i, float(i % 10)) for i in range(100)] + [("k", 200, 500.0), ("f", 1, 2.0), ("f", 2, 2.0), ("f", 3, None)], "k string, i int, v double")
    got = {(r["k"], r["i"]): (r["is_outside"], r["is_flat"]) for r in implausible.flag_by_fences(d, ["k"], "v", "i", F.lit(0), factor=3.0, rate=2.0).collect()}
    assert got["k", 200] == (True, False) and got["f", 1] == (False, True) and ("f", 3) not in got and not any(a for (k, i), (a, _) in got.items() if i < 200)


def test_jumps_inside_the_fences(spark, monkeypatch):
    monkeypatch.setattr(implausible, "CHUNK", 16)
    slow = [abs(i % 40 - 20.0) for i in range(100)]  # neighbours differ by 1
    slow[33:33] = [0.0]  # between 7 and 6: inside the fences, but no neighbour
    data = [("k", f"r{i:03}", i + 1, v) for i, v in enumerate(slow)] + [("one", "x", 1, 3.0), ("two", "x", 1, 3.0), ("two", "y", 2, 9.0)]
    d = spark.createDataFrame(data, "k string, id string, n int, v double")
    for number in ("n", None):
        got = {(r["k"], r["id"]): (r["is_outside"], r["is_jump"]) for r in implausible.flag_by_fences(d, ["k"], "v", "id", F.lit(0), factor=3.0, rate=4.0, number=number).collect()}
        assert len(got) == len(data) and not any(a for a, _ in got.values())
        assert sorted(k for k, (_, b) in got.items() if b) == [("k", "r033"), ("k", "r034")]


def test_p5_fences_reports_flat_and_rated_values(spark, tmp_path):
    text = ["observation_id", "symbol", "timeframe", "open_price", "high_price", "low_price", "close_price", "volume", "open_time", "close_time", "retrieved_at", "candle_status"]
    obs = [(f"o{i:02}", "S", "1d", "10", "11", str(9 - i % 3 / 10), "10", str(100 + i % 5), str(i * 86_400_000), None, None, "CLOSED") for i in range(40)]
    spark.createDataFrame(obs, ", ".join(f"{c} string" for c in text)).write.parquet(f"{tmp_path}/market_observation.parquet")
    rates = [(f"q{i:02}", f"o{i:02}", 0.9 + i % 3 / 100 if i != 20 else 0.1) for i in range(40)]
    spark.createDataFrame(rates, "quality_id string, observation_id string, q_ohlc double").write.parquet(f"{tmp_path}/quality_vector.parquet")
    got = {(r["record_id"], r["field"]): (r["is_outside"], r["is_jump"], r["is_flat"]) for r in upkeep.p5_fences(spark, str(tmp_path)).collect()}
    assert all(got[f"o{i:02}", "high_price"] == (False, False, True) for i in range(40))
    assert got["q20", "q_ohlc"] == (True, True, False) and got["q21", "q_ohlc"] == (False, True, False)
    assert len(got) == 42


def test_p2_pairs_equal_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    up = {f"n{i:02}": f"n{rnd.randrange(i):02}" if i else None for i in range(40)}
    up |= {"l3": "l2", "l2": "l5", "l5": "l1", "l1": "l3", "t1": "l2", "t2": "t1", "t3": "t1", "t4": "l1", "self": "self", "s1": "self", "s2": "s1", "lost": "nowhere"}
    spark.createDataFrame(list(up.items()), "revision_id string, parent_revision_id string").write.parquet(f"{tmp_path}/apex_risk_ladder_state.parquet")
    spark.createDataFrame([("a", ""), ("b", "a"), (None, "a")], "payload_hash string, parent_hash string").write.parquet(f"{tmp_path}/ops_recovery_log.parquet")
    want = {("ops_recovery_log", "a", "b", 1)}
    for node in up:
        seen, at = [node], up[node]
        while at in up and at not in seen:
            want.add(("apex_risk_ladder_state", at, node, len(seen)))
            seen.append(at)
            at = up[at]
    got = [tuple(r) for r in upkeep.QUERIES["p2_pairs"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_one_trade_at_a_time_equals_a_walk(spark, monkeypatch):
    monkeypatch.setattr(research, "SPAN", 64)
    rnd = random.Random(6)
    # signals at 1 to 700, and after a hole of several spans; holds up to the longest reach over borders
    data = [(s, "1h", n, rnd.choice([1, 5, 47, 48]), float(n)) for s in "ab" for n in sorted(rnd.sample([*range(1, 700), *range(1200, 1300)], 300))] + [("c", "1h", 64, 48, 0.0), ("c", "1h", 112, 1, 1.0), ("c", "1h", 113, 1, 2.0), ("c", "1h", 114, 1, 3.0)]
    d = spark.createDataFrame(data, "symbol string, timeframe string, n long, held int, r double")
    want, free = [], {}
    for s, t, n, held, r in sorted(data):
        if n >= free.get(s, 0):
            want.append((s, t, n, held, r))
            free[s] = n + held + 1
    assert rows(research.one_at_a_time(d).select("symbol", "timeframe", "n", "held", "r")) == want
    assert research.one_at_a_time(d.limit(0)).count() == 0


def test_coarser_bars_of_every_timeframe(spark, tmp_path):
    at = lambda *x: int(datetime(*x, tzinfo=timezone.utc).timestamp() * 1000)
    order = ["1m", "3m", "5m", "15m", "30m", "1h", "2h", "4h", "6h", "8h", "12h", "1d", "1w", "1mo"]
    day, length = 86_400_000, dict(zip(order[:13], (60_000, 180_000, 300_000, 900_000, 1_800_000, 3_600_000, 7_200_000, 14_400_000, 21_600_000, 28_800_000, 43_200_000, 86_400_000, 604_800_000)))
    have = []  # timeframe, open, close
    for tf in order[:12]:
        first = at(2024, 1, 29) // length[tf] * length[tf]
        have += [(tf, first + i * length[tf], first + (i + 1) * length[tf]) for i in range(max(4, 4 * day // length[tf] if length[tf] >= 3_600_000 else 4))]
    have += [("1w", at(2024, 1, d), at(2024, 1, d) + 7 * day) for d in (15, 22, 29)] + [("1mo", at(2023, 12, 1), at(2024, 1, 1)), ("1mo", at(2024, 1, 1), at(2024, 2, 1))]
    names = ["observation_id", "symbol", "timeframe", "open_price", "high_price", "low_price", "close_price", "volume", "open_interest", "open_time", "close_time", "retrieved_at", "candle_status"]
    obs = [(f"o{i}", "S", tf, "1", "999", "1", str(i), "1", None, str(o), None, None, "CLOSED") for i, (tf, o, _) in enumerate(have)]
    spark.createDataFrame(obs, ", ".join(f"{c} string" for c in names)).write.parquet(f"{tmp_path}/market_observation.parquet")
    want = []
    for i, (tf, o, c) in enumerate(have):
        k, found = order.index(tf), []
        for up in (order[min(k + 2, 13)], order[min(k + 4, 13)]) if tf != "1mo" else (None, None):
            found += [up, *max([(o2, float(j)) for j, (tf2, o2, c2) in enumerate(have) if tf2 == up and c2 <= c], default=(None, None))]
        want.append((tf, o, float(i), *found))
    got = bars.QUERIES["coarser_all"](spark, str(tmp_path)).select("timeframe", "open_ms", "c", "tf_mid", "open_mid", "c_mid", "tf_high", "open_high", "c_high")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # the day that ends on 31 January does not know January's bar; the next one that ends in February does
    assert got.filter(f"timeframe = '1d' AND open_ms = {at(2024, 1, 30)}").first()["open_mid"] == at(2023, 12, 1)
