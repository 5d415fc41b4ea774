"""Phases of a range and false moves around it, over one run of bars."""

from __future__ import annotations

import math

import numpy as np

from tidemark.functions.structure import Bars, ratio_to_past, trailing
from tidemark.operators.folds import wilder

#: Bars and average ranges of a range, and how long it is waited on.
RANGE_BARS, RANGE_WIDTH, AGE = 12, 1.5, 96
PHASES = ("ACCUMULATION", "MARKUP", "DISTRIBUTION", "MARKDOWN", "RE_ACCUMULATION", "RE_DISTRIBUTION", "RANGE", "TRANSITION")


def _scores(x: np.ndarray, n: int = 20) -> np.ndarray:
    """Standard score among the last ``n`` values with the current one; NaN before."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        w = np.lib.stride_tricks.sliding_window_view(x, n)
        dev = w.std(axis=1)
        out[n - 1 :] = np.where(dev < 1e-12, 0.0, (x[n - 1 :] - w.mean(axis=1)) / np.maximum(dev, 1e-12))
    return out


def phase_events(b: Bars) -> list[dict]:
    """Climax, rally, test, spring, strength, support, upthrust and supply around a range, and the phase they speak for.

    A selling climax sets a low that a rally and a test within five and ninety-six bars refer to. The range is
    that of the last twelve bars where these span under 1.5 average ranges, held until price closes
    half a range beyond it or for 96 bars.
    """
    out: list[dict] = []
    span = b.h - b.l
    pace, wide, volume = ratio_to_past(b.v), _scores(span), _scores(b.v)
    place = np.where(span > 1e-12, (b.c - b.l) / np.maximum(span, 1e-12), 0.5)
    body = np.where(span > 1e-12, np.abs(b.c - b.o) / np.maximum(span, 1e-12), 0.0)
    climax = test = strength = -1
    low = high_sos = math.nan
    lo = hi = math.nan
    since = -1
    for t in range(20, len(b)):
        a = b.atr[t]
        if not a > 1e-12 or b.h[t] < b.l[t]:
            continue
        found = []
        top, bottom = b.h[t - RANGE_BARS : t].max(), b.l[t - RANGE_BARS : t].min()
        if top - bottom < RANGE_WIDTH * a:
            if since < 0:
                found.append("RANGE")
            lo, hi, since = bottom, top, t
        elif since >= 0 and (t - since > AGE or b.c[t] > hi + 0.5 * a or b.c[t] < lo - 0.5 * a):
            if t - since > AGE or b.c[t] < lo - 0.5 * a:
                found.append("INVALIDATED")
            if b.c[t] > hi + 0.2 * a and pace[t] >= 1.2 and place[t] >= 0.65:
                found.append("STRENGTH")
                strength, high_sos = t, b.h[t]
            since = -1
        effort = volume[t] * wide[t] * float(np.sign(b.c[t] - b.c[t - 1]))
        if pace[t] >= 2.5 and wide[t] >= 2 and 0.25 <= place[t] <= 0.6 and body[t] >= 0.5 and b.c[t] < b.o[t] and b.l[t] <= b.l[t - 5 : t].min():
            found.append("CLIMAX")
            climax, low, test = t, b.l[t], -1
        elif climax >= 0:
            age = t - climax
            if 1 <= age <= 5 and b.h[t] - low >= 0.5 * a and place[t] >= 0.6:
                found.append("RALLY")
            if age <= AGE and test < 0 and abs(b.l[t] - low) <= 0.3 * a and b.l[t] >= low and pace[t] <= 0.7:
                found.append("TEST")
                test = t
        if lo == lo and t - since <= AGE and since >= 0:
            if 0 < lo - b.l[t] <= 0.3 * a and b.c[t] > lo and (pace[t] >= 1.3 or effort > 0.5) and (test < 0 or t - test <= 20):
                found.append("SPRING")
            if 0 < b.h[t] - hi <= 0.3 * a and b.c[t] < hi and pace[t] >= 1.2:
                found.append("UPTHRUST_REJECTED" if place[t] <= 0.4 else "UPTHRUST")
            if b.h[t] < hi and b.l[t] >= lo + 0.2 * a and pace[t] <= 0.7 and b.c[t] < b.o[t]:
                found.append("SUPPLY")
        if strength >= 0 and 0 < t - strength <= AGE and b.h[t] < high_sos and lo == lo and b.l[t] >= lo + 0.2 * a and pace[t] <= 0.7 and b.c[t] >= b.o[t]:
            found.append("SUPPORT")
        if found:
            p = phase_probabilities(b.c[t], lo, hi, effort, pace[t], max(t - since, 0) if since >= 0 else AGE)
            k = int(p.argmax())
            out += [{"at": t, "event": e, "lower": float(lo), "upper": float(hi), "phase": PHASES[k], "probability": float(p[k]), "entropy": float(-(p * np.log(p)).sum() / math.log(len(p)))} for e in found]
    return out


def phase_probabilities(c: float, lo: float, hi: float, effort: float, pace: float, age: float) -> np.ndarray:
    """Soft maximum of the phases' scores; what a phase says nothing about counts as one half."""
    half = 0.5
    sigmoid = lambda x: 1 / (1 + math.exp(-min(max(x, -60), 60)))
    position = min(1.0, sigmoid((c - lo) / (hi - lo) - 0.5) * 2) if hi > lo else half
    up, down = (sigmoid(effort), sigmoid(-effort)) if effort == effort else (half, half)
    quiet = 1 - min(pace / 2, 1) if pace == pace else half
    fresh = math.exp(-0.02 * max(age, 0))
    rising = 1.0 if hi == hi and c > hi else 0.0
    table = np.array([
        (position, up, quiet, rising, fresh), (half, half, half, rising, fresh), (half, down, quiet, half, fresh), *[(half, half, half, half, fresh)] * 2, (half, down, half, half, fresh), *[(half, half, half, half, fresh)] * 2,
    ])
    z = table.mean(axis=1) * 5
    e = np.exp(z - z.max())
    return e / e.sum()


def tight_ranges(b: Bars) -> list[dict]:
    """Bars that end eight quiet ones: a short average range under 0.75 of the long, all within 2.5 long ranges, closes within
    0.6, volume at most 0.9 of the 92 bars before, no gap over three ranges."""
    out = []
    short, long = wilder(b.tr[1:], 10), wilder(b.tr[1:], 100)
    close_dev = np.full(len(b), np.nan)
    if len(b) >= 8:
        close_dev[7:] = np.lib.stride_tricks.sliding_window_view(b.c, 8).std(axis=1)
    recent, past = trailing(b.v, 8), trailing(b.v, 92)
    for t in range(101, len(b)):
        s, g = short[t - 1], long[t - 1]
        if not g > 1e-12 or b.v[t - 7 : t + 1].min() <= 0:
            continue
        spread = b.h[t - 7 : t + 1].max() - b.l[t - 7 : t + 1].min()
        jump = np.abs(b.o[t - 6 : t + 1] - b.c[t - 7 : t]).max()
        pace = recent[t] / max(past[t - 8], 1e-12)
        if s / g < 0.75 and spread < 2.5 * g and close_dev[t] < 0.6 * g and pace <= 0.9 and jump <= 3 * g:
            out.append({"at": t, "event": "TIGHT_RANGE", "size": spread / g, "turn": pace})
    return out


def false_moves(b: Bars) -> list[dict]:
    """Bars three after the far point of a move of at most a quarter range from the close nine bars before, when it has been
    taken back in full within these three bars."""
    out = []
    atr = trailing(b.tr[1:], 20, lead=1)
    for t in range(9, len(b)):
        a = atr[t]
        if not a > 1e-12:
            continue
        x = b.c[t - 9 : t + 1] - b.c[t - 9]
        for sign, name in ((1, "FALSE_MOVE_DOWN"), (-1, "FALSE_MOVE_UP")):
            k = int((-sign * x).argmax())
            size = -sign * x[k]
            back = next((j for j in range(k + 1, min(k + 4, 10)) if sign * (x[j] - x[k]) >= size), None)
            if 0 < size <= 0.25 * a and k == 6 and back:
                out.append({"at": t, "event": name, "size": size / a, "turn": float(back - k)})
    return out


def block_sweeps(b: Bars) -> list[dict]:
    """Five-bar blocks in which a bar of twofold deviating volume pokes beyond the twenty bars before the block and closes back.

    ``strength`` is how far it came back against how far it poked, within 0 and 1.
    """
    out = []
    for t in range(24, len(b)):
        first = t - 4
        top, bottom = b.h[first - 20 : first].max(), b.l[first - 20 : first].min()
        past = b.v[first - 19 : first]
        for u in range(first, t + 1):
            both = np.append(past, b.v[u])
            dev = both.std()
            if dev < 1e-12 or (b.v[u] - both.mean()) / dev < 2:
                continue
            if b.l[u] < bottom < b.c[u]:
                out.append({"at": t, "event": "BLOCK_SWEEP_LOW", "size": float(bottom - b.l[u]), "turn": float(min(1.0, (b.c[u] - bottom) / (bottom - b.l[u])))})
                break
            if b.h[u] > top > b.c[u]:
                out.append({"at": t, "event": "BLOCK_SWEEP_HIGH", "size": float(b.h[u] - top), "turn": float(min(1.0, (top - b.c[u]) / (b.h[u] - top)))})
                break
    return out
