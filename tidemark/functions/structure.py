"""Swings, breaks of structure, gaps that fill, order blocks and liquidity levels of one run of bars.

Everything takes arrays of one run (a chunk with a halo) and gives plain rows; positions are offsets
into the run. Objects live a bounded number of bars, so a run started early enough sees what a whole
history would show.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

K, DEPTH, GANN_DEPTH, REDUNDANT, MAX_AGE, LEVELS = 2, 0.8, 1.2, 0.9, 120, 3
BREAK, DISPLACEMENT, RETEST, INVALID, EXPIRY = 0.3, 1.5, 0.25, 0.5, 48
#: Weights of break size, displacement, volume and close in a break's strength.
STRENGTH = (0.38, 0.27, 0.19, 0.16)


@dataclass
class Bars:
    """Arrays of a run, with the trailing figures that the rules use; an average is NaN until it is full."""

    o: np.ndarray
    h: np.ndarray
    l: np.ndarray  # noqa: E741
    c: np.ndarray
    v: np.ndarray

    def __post_init__(self) -> None:
        before = np.concatenate([[np.nan], self.c[:-1]])
        self.tr = np.fmax(self.h - self.l, np.fmax(np.abs(self.h - before), np.abs(self.l - before)))
        self.atr = trailing(self.tr[1:], 14, lead=1)
        self.eps = np.maximum(1e-8 * np.abs(self.c), 1e-12)
        self.pace = ratio_to_past(self.v)
        self.displacement = ratio_to_past(self.h - self.l)

    def __len__(self) -> int:
        return len(self.c)


def trailing(x: np.ndarray, n: int, lead: int = 0) -> np.ndarray:
    """Mean of the last ``n`` values at each place, NaN until there are as many; ``lead`` NaNs go in front."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = np.lib.stride_tricks.sliding_window_view(x, n).mean(axis=1)
    return np.concatenate([np.full(lead, np.nan), out])


def ratio_to_past(x: np.ndarray, n: int = 20) -> np.ndarray:
    """Each value over the mean of the (up to) ``n`` before it; 0 at the first."""
    total = np.concatenate([[0.0], np.cumsum(np.nan_to_num(x))])
    i = np.arange(len(x))
    lo = np.maximum(i - n, 0)
    mean = (total[i] - total[lo]) / np.maximum(i - lo, 1)
    return np.where(i > 0, x / np.maximum(mean, 1e-12), 0.0)


@dataclass
class Swing:
    kind: str  # HIGH or LOW
    price: float
    at: int
    confirmed: int
    method: str
    depth: float = math.nan
    state: str = "ACTIVE"


def fractal_swings(b: Bars, k: int = K) -> list[Swing]:
    """Bars beyond their ``k`` neighbours on either side by more than a rounding; known ``k`` bars later."""
    out, n = [], len(b)
    if n < 2 * k + 1:
        return out
    for kind, x in (("HIGH", b.h), ("LOW", -b.l)):
        near = np.lib.stride_tricks.sliding_window_view(x, 2 * k + 1)
        rest = np.delete(near, k, axis=1).max(axis=1)
        for t in np.flatnonzero((near[:, k] > rest + b.eps[k : n - k]) & (b.h >= b.l)[k : n - k]) + k:
            out.append(Swing(kind, float(b.h[t] if kind == "HIGH" else b.l[t]), int(t), int(t) + k, "FRACTAL"))
    return sorted(out, key=lambda s: (s.at, s.kind))


def turn_swings(b: Bars) -> list[Swing]:
    """Extremes of completed legs: a leg down ends with the first higher low, a leg up with the first lower high."""
    out: list[Swing] = []
    rising, low, high = False, 0, 0
    for t in range(1, len(b)):
        if b.h[t] < b.l[t]:
            continue
        if not rising and b.l[t] > b.l[t - 1]:
            out.append(Swing("LOW", float(b.l[low]), low, t, "TURN"))
            rising, high = True, t
        elif rising and b.h[t] < b.h[t - 1]:
            out.append(Swing("HIGH", float(b.h[high]), high, t, "TURN"))
            rising, low = False, t
        low = t if b.l[t] < b.l[low] else low
        high = t if b.h[t] > b.h[high] else high
    return out


def merged_swings(b: Bars, fractals: list[Swing], turns: list[Swing]) -> list[Swing]:
    """Both kinds of swings in order; of two methods' swings of a kind within two bars the farther one stays.

    ``state`` is ACTIVE, or why a swing was pruned against the last active one: SHALLOW (under 0.8
    average ranges away), UNCONFIRMED (a turn no fractal agrees with, under 1.2), REDUNDANT.
    """
    kept: list[Swing] = []
    for s in sorted([*fractals, *turns], key=lambda s: s.at):
        last = kept[-1] if kept else None
        if last and s.at - last.at <= 2 and s.kind == last.kind and s.method != last.method:
            if (s.price > last.price) if s.kind == "HIGH" else (s.price < last.price):
                kept[-1] = s
        else:
            kept.append(s)
    agreed = {(s.kind, s.at + d) for s in fractals for d in range(-2, 3)}
    active: Swing | None = None
    for s in kept:
        if active is None:
            active = s
            continue
        a = b.atr[min(max(s.at, 14), len(b) - 1)]
        a = a if a == a else float(np.nanmax(b.h - b.l))
        away = abs(s.price - active.price)
        s.depth = away / max(a, b.eps[s.at])
        if s.method == "TURN" and s.depth < GANN_DEPTH and (s.kind, s.at) not in agreed:
            s.state = "UNCONFIRMED"
        elif s.depth < DEPTH:
            s.state = "SHALLOW"
        elif math.exp(-away / max(0.15 * a, b.eps[s.at])) > REDUNDANT:
            s.state = "REDUNDANT"
        else:
            active = s
    return kept


def strength(bm: float, disp: float, pace: float, close_position: float) -> float:
    """Weighted strength of a break from its size, displacement, volume and close, each within 0 and 1."""
    parts = (1 / (1 + math.exp(1 - bm)), min(disp / DISPLACEMENT, 1), min(pace / 2, 1), close_position)
    return sum(w * p for w, p in zip(STRENGTH, parts))


def breaks(b: Bars, swings: list[Swing]) -> list[dict]:
    """Closes beyond one of the last three active, confirmed swings by 0.3 average ranges or more.

    Levels count as the price meets them. A swing serves ``MAX_AGE`` bars. Each break carries how it
    went: RETEST (a close within a quarter range of the level), INVALIDATION (a close half a range on
    the wrong side) or NONE within ``EXPIRY`` bars, and the bar of it.
    """
    out = []
    stacks: dict[str, list[Swing]] = {"HIGH": [], "LOW": []}
    waiting = sorted((s for s in swings if s.state == "ACTIVE"), key=lambda s: max(s.at + 2, s.confirmed))
    done = 0
    for t in range(len(b)):
        while done < len(waiting) and max(waiting[done].at + 2, waiting[done].confirmed) <= t:
            s = waiting[done]
            stacks[s.kind] = sorted([*stacks[s.kind], s], key=lambda x: -x.at)[:LEVELS]
            done += 1
        a = b.atr[t]
        if not a == a or b.h[t] < b.l[t]:
            continue
        span = max(b.h[t] - b.l[t], b.eps[t])
        place = (b.c[t] - b.l[t]) / span
        for kind, sign in (("HIGH", 1), ("LOW", -1)):
            beyond = [s for s in stacks[kind] if sign * (b.c[t] - s.price) > 1e-12 and t - s.at <= MAX_AGE]
            for rank, s in enumerate(sorted(beyond, key=lambda s: sign * s.price), start=1):
                bm = abs(b.c[t] - s.price) / max(a, b.eps[t])
                if bm >= BREAK:
                    how, when = _after(b, t, s.price, sign)
                    out.append({"at": t, "event": "BREAK_UP" if sign > 0 else "BREAK_DOWN", "level": s.price, "rank": rank, "magnitude": bm, "strength": strength(bm, b.displacement[t], b.pace[t], place if sign > 0 else 1 - place), "outcome": how, "outcome_at": when})
    return out


def _after(b: Bars, t: int, level: float, sign: int) -> tuple[str, int]:
    for u in range(t + 1, min(len(b), t + EXPIRY + 1)):
        if b.h[u] < b.l[u] or b.atr[u] != b.atr[u]:
            continue
        if abs(b.c[u] - level) <= RETEST * b.atr[u]:
            return "RETEST", u
        if sign * (level - b.c[u]) > INVALID * b.atr[u]:
            return "INVALIDATION", u
    return "NONE", -1


def market_state(swings: list[Swing]) -> str:
    """UP, DOWN or RANGE by the last four swings: two highs and two lows that rise or fall together."""
    highs, lows = ([s.price for s in swings[-4:] if s.kind == k] for k in ("HIGH", "LOW"))
    if len(highs) < 2 or len(lows) < 2:
        return "RANGE"
    up, down = highs[-1] > highs[-2] and lows[-1] > lows[-2], highs[-1] < highs[-2] and lows[-1] < lows[-2]
    return "UP" if up else "DOWN" if down else "RANGE"


def reversals(b: Bars, swings: list[Swing], broken: list[dict]) -> list[dict]:
    """Changes of character and wick rejections.

    A change is a bar whose body lies beyond the last high of a falling structure (low of a rising one)
    after an earlier break along that structure. A rejection pokes a fifth of a range or more
    over the last swing high and closes below it. Only confirmed swings are seen.
    """
    active = [s for s in swings if s.state == "ACTIVE"]
    first = {e: min((x["at"] for x in broken if x["event"] == e), default=len(b)) for e in ("BREAK_UP", "BREAK_DOWN")}
    order, out, seen, done = sorted(active, key=lambda s: s.confirmed), [], [], 0
    for t in range(len(b)):
        while done < len(order) and order[done].confirmed < t:
            seen = sorted([*seen, order[done]], key=lambda s: s.at)[-12:]
            done += 1
        a = b.atr[t]
        if not a == a or b.h[t] < b.l[t] or not seen:
            continue
        state = market_state(seen)
        high = next((s for s in reversed(seen) if s.kind == "HIGH"), None)
        low = next((s for s in reversed(seen) if s.kind == "LOW"), None)
        if state == "DOWN" and high and min(b.o[t], b.c[t]) > high.price + b.eps[t] and first["BREAK_DOWN"] < t:
            out.append({"at": t, "event": "CHANGE_UP", "level": high.price, "magnitude": abs(b.c[t] - high.price) / a})
        if state == "UP" and low and max(b.o[t], b.c[t]) < low.price - b.eps[t] and first["BREAK_UP"] < t:
            out.append({"at": t, "event": "CHANGE_DOWN", "level": low.price, "magnitude": abs(b.c[t] - low.price) / a})
        if high and b.h[t] > high.price + b.eps[t] and b.c[t] < high.price - b.eps[t] and (b.h[t] - high.price) / a > 0.2:
            out.append({"at": t, "event": "WICK_REJECTION", "level": high.price, "magnitude": (b.h[t] - high.price) / a})
    return out


# ---------------------------------------------------------------- zones

GAP_WIDTH, GAP_AGE, HALF_LIFE, STALE, MITIGATED, FILLED, SAME_ZONE = 0.2, 96, 48, 0.15, 0.5, 0.999, 0.7
#: Weights of width, volume, structural role and freshness in a zone's salience.
SALIENCE = (0.35, 0.25, 0.25, 0.15)


def overlap_ratio(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Common part of two price ranges over the range they span."""
    return max(0.0, min(a[1], b[1]) - max(a[0], b[0])) / max(max(a[1], b[1]) - min(a[0], b[0]), 1e-12)


def gap_type(b: Bars, t: int, up: bool) -> str:
    """DOJI, BISI, SIBI, REJECTION or CONVENTIONAL by the middle candle and the wick of the last."""
    m = t - 1
    body = abs(b.c[m] - b.o[m]) / max(b.h[m] - b.l[m], 1e-12)
    if body < 0.1:
        return "DOJI"
    if up and b.c[m] < b.o[m]:
        return "BISI"
    if not up and b.c[m] > b.o[m]:
        return "SIBI"
    span = b.h[t] - b.l[t] + 1e-12
    wick = b.h[t] - max(b.o[t], b.c[t]) if up else min(b.o[t], b.c[t]) - b.l[t]
    return "REJECTION" if wick / span >= 0.5 and abs(b.c[t] - b.o[t]) / span <= 0.4 else "CONVENTIONAL"


def gap_zones(b: Bars) -> list[dict]:
    """Life of each fair value gap: bounds, type, salience, first touch, half fill, whole fill, end and fate.

    Gaps of one direction that overlap by over 0.7 or contain each other are merged into the older
    one as soon as both live; the younger ends as MERGED. A gap ends FILLED, or EXPIRED at 96 bars.
    """
    live: list[dict] = []
    out: list[dict] = []
    for t in range(2, len(b)):
        if b.atr[t] == b.atr[t]:
            up, down = b.l[t] - b.h[t - 2], b.l[t - 2] - b.h[t]
            if max(up, down) >= GAP_WIDTH * b.atr[t] > 0:
                lo, hi = (b.h[t - 2], b.l[t]) if up > down else (b.h[t], b.l[t - 2])
                kind = gap_type(b, t, up > down)
                base = SALIENCE[0] * min((hi - lo) / b.atr[t], 2) / 2 + SALIENCE[1] * min(b.pace[t - 1] / 2, 1) + SALIENCE[2] * 0.5 + SALIENCE[3]
                live.append({"at": t, "direction": "UP" if up > down else "DOWN", "lower": float(lo), "upper": float(hi), "kind": kind, "salience": base * (0.7 if kind == "DOJI" else 1.0), "touched": -1, "mitigated": -1, "filled": -1, "ended": -1, "fate": "FRESH", "depth": 0.0, "merged": 0})
                out.append(live[-1])
        for z in live:
            if z["at"] == t:
                continue
            if b.h[t] >= z["lower"] and b.l[t] <= z["upper"]:
                depth = max(0.0, min(z["upper"], b.h[t]) - max(z["lower"], b.l[t])) / max(z["upper"] - z["lower"], 1e-12)
                z["depth"] = max(z["depth"], depth)
                z["touched"] = t if z["touched"] < 0 else z["touched"]
                if depth >= MITIGATED and z["mitigated"] < 0:
                    z["mitigated"] = t
                z["fate"] = "MITIGATED" if z["mitigated"] >= 0 else "TOUCHED"
                if depth >= FILLED:
                    z["filled"], z["ended"], z["fate"] = t, t, "FILLED"
            age = t - z["at"]
            if z["ended"] < 0 and (age >= GAP_AGE or 0.5 ** (age / HALF_LIFE) < STALE):
                z["ended"], z["fate"] = t, "EXPIRED"
        live = [z for z in live if z["ended"] < 0]
        for direction in ("UP", "DOWN"):
            mine = sorted((z for z in live if z["direction"] == direction), key=lambda z: z["lower"])
            i = 0
            while i + 1 < len(mine):
                p, q = mine[i], mine[i + 1]
                within = p["upper"] >= q["upper"] or q["lower"] <= p["lower"]
                if within or overlap_ratio((p["lower"], p["upper"]), (q["lower"], q["upper"])) > SAME_ZONE:
                    old, young = (p, q) if p["at"] <= q["at"] else (q, p)
                    old.update(lower=min(p["lower"], q["lower"]), upper=max(p["upper"], q["upper"]), salience=max(p["salience"], q["salience"]) * 1.1, merged=old["merged"] + 1)
                    young["ended"], young["fate"] = t, "MERGED"
                    mine.remove(young)
                    i = max(0, i - 1)
                else:
                    i += 1
        live = [z for z in live if z["ended"] < 0]
    return out


BLOCK_AGE, BLOCK_BODY, LEG, LEG_SINGLE = 144, 0.55, 5, 1.8


def order_blocks(b: Bars, broken: list[dict], gaps: list[dict]) -> list[dict]:
    """Last opposite candle before a displacement of 1.5 ranges or more within five bars, and its life.

    A block is confirmed by the first structural break along it within the five bars, else it stays a
    candidate known after all five. It is RETESTED by the first touch from its own side, MITIGATED at half depth,
    INVALIDATED by a close beyond it by a fifth of a range, EXPIRED after 144 bars; a block of the same
    direction within 20 bars that overlaps a more salient one by over 0.7 is MERGED. An
    invalidated block that price takes back within 20 later blocks turns into a BREAKER the other way.
    """
    steps: dict[int, list[str]] = {}
    for e in broken:
        steps.setdefault(e["at"], []).append("UP" if e["event"] == "BREAK_UP" else "DOWN")
    holes: dict[str, list[tuple[int, float]]] = {"UP": [], "DOWN": []}
    for g in gaps:
        holes[g["direction"]].append((g["at"], (g["lower"] + g["upper"]) / 2))
    out: list[dict] = []
    for t in range(14, len(b) - LEG):
        a, span = b.atr[t], b.h[t] - b.l[t]
        if not a > 1e-12 or span <= 0 or abs(b.c[t] - b.o[t]) / span < BLOCK_BODY:
            continue
        way = "UP" if b.c[t + 1] > b.o[t + 1] else "DOWN"
        if (way == "UP") != (b.c[t] < b.o[t]):
            continue
        hit = next((k for k in range(1, LEG + 1) if way in steps.get(t + k, ())), 0)
        leg = float((b.h - b.l)[t + 1 : t + 1 + (hit or LEG)].sum()) / a
        if leg < DISPLACEMENT:
            continue
        known = t + (hit or LEG)
        beside = any(t <= at <= known and abs(mid - b.c[t]) <= 2 * a for at, mid in holes[way])
        context = b.pace[t + 1] >= 1.3 and (beside or leg >= LEG_SINGLE)
        quality = "Q3" if context and hit else "Q2" if context or b.pace[t + 1] >= 1.3 else "Q1"
        tol = 0.15 * a
        lo, hi = (b.l[t] - tol, min(b.o[t], b.c[t]) + tol) if way == "UP" else (max(b.o[t], b.c[t]) - tol, b.h[t] + tol)
        if hi - lo < 0.15 * a or lo >= hi:
            continue
        salience = SALIENCE[0] * min(leg / 3, 1) + SALIENCE[1] * (1.0 if hit else 0.3) + SALIENCE[2] * min(b.pace[t + 1] / 3, 1) + SALIENCE[3]
        out.append({"at": t, "direction": way, "lower": float(lo), "upper": float(hi), "kind": "ENTRY", "quality": quality, "salience": salience, "displacement": leg, "confirmed": known})
    for z in out:
        _block_life(b, z)
    for z in sorted(out, key=lambda z: -z["salience"]):
        if z["fate"] == "MERGED":
            continue
        for y in out:
            if y is not z and y["fate"] != "MERGED" and y["direction"] == z["direction"] and abs(y["at"] - z["at"]) <= 20 and y["salience"] <= z["salience"]:
                if overlap_ratio((y["lower"], y["upper"]), (z["lower"], z["upper"])) > SAME_ZONE:
                    y["fate"] = "MERGED"
    flips = []
    for z in (z for z in out if z["fate"] == "INVALIDATED"):
        for t in range(z["ended"] + 1, min(len(b), z["ended"] + BLOCK_AGE)):
            back = b.c[t] > z["upper"] + 0.2 * b.atr[t] and b.l[t] <= z["upper"] if z["direction"] == "UP" else b.c[t] < z["lower"] - 0.2 * b.atr[t] and b.h[t] >= z["lower"]
            if back:
                f = {**z, "at": t, "confirmed": t, "direction": "DOWN" if z["direction"] == "UP" else "UP", "kind": "BREAKER", "quality": "Q3", "salience": z["salience"] * 0.9}
                _block_life(b, f)
                flips.append(f)
                break
    return [*out, *flips]


def _block_life(b: Bars, z: dict) -> None:
    z.update(retested=-1, mitigated=-1, ended=-1, fate="ACTIVE" if z["quality"] == "Q3" else "CANDIDATE")
    up = z["direction"] == "UP"
    for t in range(z["confirmed"] + 1, min(len(b), z["confirmed"] + 1 + BLOCK_AGE)):
        wrong = b.c[t] < z["lower"] - 0.2 * b.atr[t] if up else b.c[t] > z["upper"] + 0.2 * b.atr[t]
        if wrong:
            z["ended"], z["fate"] = t, "INVALIDATED"
            return
        if b.l[t] <= z["upper"] and b.h[t] >= z["lower"]:
            came = b.c[t - 1] > z["upper"] if up else b.c[t - 1] < z["lower"]
            if came or z["retested"] >= 0:
                depth = (min(z["upper"], b.h[t]) - max(z["lower"], b.l[t])) / max(z["upper"] - z["lower"], 1e-12)
                if z["retested"] < 0:
                    z["retested"], z["fate"] = t, "RETESTED"
                if depth >= MITIGATED and z["mitigated"] < 0:
                    z["mitigated"], z["fate"] = t, "MITIGATED"
        if t - z["confirmed"] >= BLOCK_AGE:
            z["ended"], z["fate"] = t, "EXPIRED"


# ---------------------------------------------------------------- liquidity


def equal_levels(prices: np.ndarray, tolerance: float) -> list[np.ndarray]:
    """Groups of prices in which all lie within ``tolerance`` of the group's median; ascending.

    Runs no wider than twice the tolerance, split at the median (or the middle of the run) while a member is too far from it.
    """
    out: list[np.ndarray] = []
    rest = np.sort(np.asarray(prices, dtype=float))
    while len(rest):
        k = int(np.searchsorted(rest, rest[0] + 2 * tolerance, side="right"))
        todo, rest = [rest[:k]], rest[k:]
        while todo:
            g = todo.pop()
            m = float(np.median(g))
            if np.abs(g - m).max() <= tolerance + 1e-12 or g[0] == g[-1]:
                out.append(g)
            else:
                cut = m if g[-1] > m else (g[0] + g[-1]) / 2  # a median that is the highest price splits nothing
                todo += [g[g > cut], g[g <= cut]]
    return sorted(out, key=lambda g: g[0])


def density_pools(prices: np.ndarray, radius: float, least: int) -> np.ndarray:
    """Cluster number of each of the ascending ``prices`` by density along the line, -1 for noise.

    A price with ``least`` prices within ``radius`` (itself too) is a core; cores within reach of
    each other share a cluster, and others join the first core in reach.
    """
    lo, hi = np.searchsorted(prices, prices - radius, "left"), np.searchsorted(prices, prices + radius, "right")
    core = hi - lo >= least
    out, last, number = np.full(len(prices), -1), None, -1
    for i in np.flatnonzero(core):
        if last is None or prices[i] - prices[last] > radius:
            number += 1
        out[i], last = number, i
    for i in np.flatnonzero(~core):
        reach = [j for j in range(lo[i], hi[i]) if core[j]]
        out[i] = out[reach[0]] if reach else -1
    return out


def volume_imbalance(c: np.ndarray, v: np.ndarray, bucket: float, buckets: int = 50) -> float:
    """Share of one-sided volume over the last volume buckets, sides by the normal law of the price change."""
    sizes, moves, total, start = [], [], 0.0, None
    for price, volume in zip(c, v):
        start = price if start is None else start
        total += volume
        if total >= bucket:
            sizes.append(total)
            moves.append(price - start)
            total, start = 0.0, None
    if len(sizes) < 2:
        return 0.0
    sizes, moves = np.array(sizes[-buckets:]), np.array(moves[-buckets:])
    sigma = max(float(moves.std()), 1e-12)
    buy = np.array([0.5 * math.erfc(-m / (sigma * math.sqrt(2))) for m in moves])
    return float(min(1.0, np.abs((2 * buy - 1) * sizes).sum() / (sizes.sum() + 1e-12)))


def hit_probability(distance: float, sigma: float, bars: int, rate: float = 0.02, mean: float = 0.0, spread: float = 0.02) -> float:
    """Chance to reach a relative ``distance`` within ``bars``, diffusion and jumps added, at most 1."""
    d, whole = abs(distance), math.sqrt(sigma**2 + rate * (mean**2 + spread**2))
    drift = math.erfc(d / (max(whole, 1e-12) * math.sqrt(2 * bars)))
    return min(1.0, drift + rate * bars * 0.5 * math.erfc((d - abs(mean)) / (spread * math.sqrt(2))))
