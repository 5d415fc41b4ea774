"""Chart patterns and ratio ladders over the swings of one run of bars."""

from __future__ import annotations

import numpy as np

from tidemark.functions.structure import Bars, Swing

#: Tolerances in average ranges, the pole of a flag, and the share of it that a pause may take back.
EQUAL, FLAT, POLE, PAUSE, FLAG_BARS = 0.15, 0.25, 3.0, 0.5, 12
#: Bars after its last pivot within which a pattern must break.
BREAK_WITHIN = 48
#: Ratios of retracements, projections and extensions.
RETRACE, PROJECT, EXTEND = (0.236, 0.382, 0.5, 0.618, 0.705, 0.786), (1.0, 1.272, 1.618, 2.0), (-0.272, -0.618, -1.0)


def _break(b: Bars, since: int, level: float, up: bool) -> int:
    for t in range(since + 1, min(len(b), since + BREAK_WITHIN + 1)):
        if (b.c[t] > level) if up else (b.c[t] < level):
            return t
    return -1


def _add(out: list[dict], b: Bars, name: str, pivots: list[Swing], level: float, up: bool) -> None:
    # a pattern is there once its last pivot is known and its line is crossed by a close
    at = _break(b, pivots[-1].confirmed, level, up)
    if at >= 0:
        out.append({"at": at, "pattern": name, "direction": "UP" if up else "DOWN", "line": float(level), "first": pivots[0].at, "last": pivots[-1].at})


def chart_patterns(b: Bars, swings: list[Swing]) -> list[dict]:
    """Double and triple turns, head and shoulders, triangles, wedges, rectangles, broadening and quasimodo, from pivots in
    a row, and flags from the bars. Each needs a close beyond its line within 48 bars of its last pivot."""
    out: list[dict] = []
    pivots: list[Swing] = []
    for s in sorted(swings, key=lambda s: (s.at, s.kind)):  # alternate, the farther of two of a kind
        if pivots and pivots[-1].kind == s.kind:
            if (s.price > pivots[-1].price) == (s.kind == "HIGH"):
                pivots[-1] = s
        else:
            pivots.append(s)
    for i in range(len(pivots)):
        a = b.atr[pivots[i].at]
        if not a > 0:
            continue
        near = lambda x, y, tol=EQUAL: abs(x - y) <= tol * a
        if i >= 2:
            p, q, r = pivots[i - 2 : i + 1]
            if near(p.price, r.price):
                top = r.kind == "HIGH"
                _add(out, b, "DOUBLE_TOP" if top else "DOUBLE_BOTTOM", [p, q, r], q.price, not top)
        if i >= 4:
            p = pivots[i - 4 : i + 1]
            x = [s.price for s in p]
            sign = 1 if p[4].kind == "HIGH" else -1
            if near(x[0], x[4], 2 * FLAT) and sign * (x[2] - max(sign * x[0], sign * x[4]) * sign) > EQUAL * a and near(x[1], x[3], 3 * FLAT):
                _add(out, b, "HEAD_AND_SHOULDERS" if sign > 0 else "INVERSE_HEAD_AND_SHOULDERS", p, (x[1] + x[3]) / 2, sign < 0)
            elif near(x[0], x[2]) and near(x[2], x[4]):
                _add(out, b, "TRIPLE_TOP" if sign > 0 else "TRIPLE_BOTTOM", p, x[3], sign < 0)
            if sign * (x[2] - x[0]) > 0 and sign * (x[3] - x[1]) < 0 and sign * (x[4] - x[2]) < 0 and abs(x[4] - x[0]) <= 2 * FLAT * a:
                _add(out, b, "QUASIMODO", p, x[3], sign < 0)
        if i >= 3:
            p = pivots[i - 3 : i + 1]
            highs, lows = ([s.price for s in p if s.kind == k] for k in ("HIGH", "LOW"))
            up, dn = highs[1] - highs[0], lows[1] - lows[0]
            flat_top, flat_low = abs(up) <= FLAT * a, abs(dn) <= FLAT * a
            if flat_top and flat_low:
                name, ways = "RECTANGLE", (True, False)
            elif flat_top and dn > 0:
                name, ways = "TRIANGLE_ASCENDING", (True,)
            elif flat_low and up < 0:
                name, ways = "TRIANGLE_DESCENDING", (False,)
            elif up < 0 < dn:
                name, ways = "TRIANGLE_SYMMETRICAL", (True, False)
            elif up > 0 > dn:
                name, ways = "BROADENING", (True, False)
            elif dn > up > 0:
                name, ways = "WEDGE_RISING", (False,)
            elif up < dn < 0:
                name, ways = "WEDGE_FALLING", (True,)
            else:
                continue
            hits = [(t, w) for w in ways if (t := _break(b, p[-1].confirmed, highs[1] if w else lows[1], w)) >= 0]
            if hits:
                _add(out, b, name, p, highs[1] if min(hits)[1] else lows[1], min(hits)[1])
    return [*out, *flags(b)]


def flags(b: Bars) -> list[dict]:
    """Flags: a pole of three average ranges or more in up to eight bars, a pause of up to twelve that gives back no more
    than half, and a close beyond the pole's end."""
    out, t, n = [], 8, len(b)
    while t < n:
        a = b.atr[t]
        move = b.c[t] - b.c[t - 8]
        if a > 0 and abs(move) >= POLE * a:
            up = move > 0
            tip = b.h[t] if up else b.l[t]
            for u in range(t + 1, min(n, t + FLAG_BARS + 1)):
                back = (tip - b.l[u]) if up else (b.h[u] - tip)
                if back > PAUSE * abs(move):
                    break
                if u - t >= 3 and ((b.c[u] > tip) if up else (b.c[u] < tip)):
                    out.append({"at": u, "pattern": "FLAG", "direction": "UP" if up else "DOWN", "line": float(tip), "first": t - 8, "last": t})
                    t = u
                    break
                tip = tip if u - t < 3 else tip
        t += 1
    return out


def ladder(a: float, b: float, ratios: tuple[float, ...]) -> list[float]:
    """Prices at ``a + ratio * (b - a)``."""
    return list(a + np.array(ratios) * (b - a))
