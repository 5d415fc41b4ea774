"""Tests, tail probabilities and small fits on arrays, for use inside chunk folds and grouped maps."""

from __future__ import annotations

import math

import numpy as np

_FAR = 500


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:  # power series of the lower part
        term = total = 1 / a
        for k in range(1, _FAR):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return max(0.0, 1 - front * total)
    # Lentz's evaluation of the continued fraction of the upper part
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, _FAR):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, front * h)


def beta_lower(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, _FAR):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return min(1.0, front * h)


def chi2_tail(x: float, df: int) -> float:
    return gamma_upper(df / 2, x / 2)


def t_tails(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return beta_lower(df / 2, 0.5, df / (df + t * t))


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of :func:`normal_cdf`, by bisection and Newton steps."""
    lo, hi = -40.0, 40.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def wilson(p: float, n: float, z: float = 1.96) -> tuple[float, float]:
    """Wilson's bounds of a rate."""
    if n <= 0:
        return 0.0, 1.0
    mid, half, scale = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return (mid - half) / scale, (mid + half) / scale


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k) of n trials."""
    return 1.0 if k <= 0 else beta_lower(k, n - k + 1, p) if k <= n else 0.0


def poisson_tail(k: int, mean: float) -> float:
    """P(X >= k)."""
    return 1.0 if k <= 0 else 1 - gamma_upper(k, mean) if mean > 0 else 0.0


def ljung_box(x: np.ndarray, lags: int) -> tuple[float, float]:
    """Statistic and p-value for autocorrelation up to ``lags``; NaN where there are too few values."""
    n = len(x)
    if n <= lags + 1:
        return math.nan, math.nan
    d = x - x.mean()
    total = float(d @ d)
    if total < 1e-12:
        return 0.0, 1.0
    rho = np.array([d[k:] @ d[:-k] for k in range(1, lags + 1)]) / total
    q = n * (n + 2) * float((rho**2 / (n - np.arange(1, lags + 1))).sum())
    return q, chi2_tail(q, lags)


def correlation_test(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float, float]:
    """Pearson correlation, t, two-sided p and Fisher bounds at 95 %."""
    n = len(x)
    dx, dy = x - x.mean(), y - y.mean()
    scale = math.sqrt(float(dx @ dx) * float(dy @ dy))
    if scale < 1e-12:
        return 0.0, 0.0, 1.0, -1.0, 1.0
    r = min(max(float(dx @ dy) / scale, -1 + 1e-12), 1 - 1e-12)
    t = r * math.sqrt((n - 2) / max(1 - r * r, 1e-12))
    z, w = math.atanh(r), 1.96 / math.sqrt(n - 3)
    return r, t, t_tails(t, n - 2), math.tanh(z - w), math.tanh(z + w)


def garch_fit(returns: np.ndarray, least: int = 100) -> tuple[float, float, float, float] | None:
    """omega, alpha, beta and the negative log-likelihood of GARCH(1,1); None where it cannot be fitted."""
    return garch_fits([returns], least)[0]


def garch_fits(windows: list[np.ndarray], least: int = 100, together: int = 32) -> list[tuple[float, float, float, float] | None]:
    """:func:`garch_fit` of many windows.

    A grid of starts is refined by coordinate steps. All starts of ``together`` windows of one length are
    lanes of the same arrays, so the recursion over the returns runs once per step for all of them.
    """
    out: list[tuple[float, float, float, float] | None] = [None] * len(windows)
    lengths: dict[int, list[int]] = {}
    for i, x in enumerate(windows):
        if len(x) >= least and float(np.var(x)) > 0:
            lengths.setdefault(len(x), []).append(i)
    for n, places in lengths.items():
        for lo in range(0, len(places), together):
            part = places[lo : lo + together]
            for i, fit in zip(part, _garch_lanes(np.stack([windows[i] for i in part]), n)):
                out[i] = fit
    return out


def _garch_lanes(returns: np.ndarray, n: int) -> list[tuple[float, float, float, float]]:
    e = returns - returns.mean(axis=1, keepdims=True)
    sq = np.ascontiguousarray((e * e).T)[:, :, None]  # time, window, lane
    var = (e * e).mean(axis=1)[:, None]

    def cost(o: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = (o > 0) & (a >= 0) & (b >= 0) & (a + b < 0.999999)
        s = np.where(ok, o / np.where(ok, 1 - a - b, 1.0), 1.0)
        logs, total = np.log(s), sq[0] / s
        for t in range(1, n):
            s = np.maximum(o + a * sq[t - 1] + b * s, 1e-12)
            logs += np.log(s)
            total += sq[t] / s
        return np.where(ok, 0.5 * (n * math.log(2 * math.pi) + logs + total), 1e12)

    grid = [(w, a, b) for w in (0.01, 0.05, 0.1, 0.2, 0.35, 0.5) for a in (0.02, 0.05, 0.1, 0.15, 0.2) for b in (0.6, 0.7, 0.8, 0.85, 0.9, 0.92) if a + b < 0.999]
    w, a, b = np.array([(0.1, 0.1, 0.8), (0.05, 0.15, 0.8), (0.2, 0.05, 0.85), *grid]).T
    o, a, b = var * w, *(np.broadcast_to(x, (len(var), len(w))) for x in (a, b))
    best = cost(o, a, b)
    for scale in (0.8, 0.9, 1.0, 1.1, 1.25):
        for da in (-0.02, 0.0, 0.02):
            for db in (-0.03, 0.0, 0.03):
                o2, a2, b2 = o * scale, np.maximum(0, a + da), np.maximum(0, b + db)
                got = np.where(a2 + b2 >= 0.999, np.inf, cost(o2, a2, b2))
                better = got < best
                o, a, b, best = np.where(better, o2, o), np.where(better, a2, a), np.where(better, b2, b), np.where(better, got, best)
    k = best.argmin(axis=1)
    return [(float(o[i, j]), float(a[i, j]), float(b[i, j]), float(best[i, j])) for i, j in enumerate(k)]


def har_fit(rv: np.ndarray, lag: int = 5) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Coefficients (1, day, 5 days, 22 days) of the next value, Newey-West errors, and rows used."""
    n = len(rv)
    if n < 25 + lag:
        return None
    total = np.concatenate([[0.0], np.cumsum(rv)])
    t = np.arange(22, n - 1)
    x = np.stack([np.ones(len(t)), rv[t], (total[t + 1] - total[t - 4]) / 5, (total[t + 1] - total[t - 21]) / 22], axis=1)
    return least_squares(x, rv[t + 1], lag)


def least_squares(x: np.ndarray, y: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """Coefficients, their Newey-West errors with Bartlett weights up to ``lag``, and rows."""
    gram = x.T @ x
    if np.linalg.matrix_rank(gram, tol=1e-15) < len(gram):
        return None
    beta, inverse = np.linalg.solve(gram, x.T @ y), np.linalg.inv(gram)
    u = x * (y - x @ beta)[:, None]
    meat = u.T @ u
    for k in range(1, min(lag, len(y) - 1) + 1):
        g = u[k:].T @ u[:-k]
        meat += (1 - k / (lag + 1)) * (g + g.T)
    return beta, np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0)), len(y)


def trend_slope(y: np.ndarray) -> tuple[float, float, float]:
    """Slope against time, its Newey-West error with the usual lag, and R2."""
    n = len(y)
    x = np.stack([np.ones(n), np.arange(n, dtype=float)], axis=1)
    fit = least_squares(x, y, int(4 * (n / 100) ** (2 / 9)))
    if fit is None:
        return 0.0, 0.0, 0.0
    beta, error, _ = fit
    d = y - y.mean()
    whole = float(d @ d)
    rest = y - x @ beta
    return float(beta[1]), float(error[1]), 1 - float(rest @ rest) / whole if whole > 1e-12 else 0.0


def mann_kendall(x: np.ndarray, tie: float = 0.0) -> tuple[int, float, float]:
    """S, its variance corrected for ties, and z; values within ``tie`` of each other are ties."""
    n = len(x)
    d = x[None, :] - x[:, None]
    d = np.where(np.abs(d) <= tie, 0.0, np.sign(d))
    s = int(np.triu(d, 1).sum())
    _, t = np.unique(np.round(x / tie) if tie else x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - float((t * (t - 1) * (2 * t + 5)).sum())) / 18
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    return s, var, float(z)


def hurst_exponent(prices: np.ndarray) -> float:
    """Rescaled-range exponent of log prices over lags 8 to min(n // 2, 32); NaN under 24 prices."""
    n = len(prices)
    if n < 24:
        return math.nan
    logs, xs, ys = np.log(np.maximum(prices, 1e-300)), [], []
    for lag in range(8, min(n // 2, 32) + 1):
        parts = np.array([logs[i : i + lag] for i in range(0, n - lag, lag)])
        d = parts - parts.mean(axis=1, keepdims=True)
        walk = d.cumsum(axis=1)
        spread = walk.max(axis=1) - walk.min(axis=1)
        rs = spread[spread > 0] / np.sqrt(np.maximum((d[spread > 0] ** 2).mean(axis=1), 1e-300))
        if len(rs) and rs.mean() > 0:
            xs.append(math.log(lag))
            ys.append(math.log(rs.mean()))
    if len(xs) < 3:
        return math.nan
    x, y = np.array(xs), np.array(ys)
    dx = x - x.mean()
    return float(dx @ (y - y.mean()) / (dx @ dx))


def mid_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties share the mean of theirs."""
    _, which, count = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(count) - (count - 1) / 2)[which]


def spearman(x: np.ndarray, y: np.ndarray) -> float:
    a, b = mid_ranks(x), mid_ranks(y)
    a, b = a - a.mean(), b - b.mean()
    scale = math.sqrt(float(a @ a) * float(b @ b))
    return float(a @ b) / scale if scale > 0 else 0.0


def kruskal_wallis(groups: list[np.ndarray]) -> tuple[float, float]:
    """H corrected for ties, and its p-value."""
    groups = [g for g in groups if len(g)]
    every = np.concatenate(groups) if groups else np.zeros(0)
    n = len(every)
    if len(groups) < 2 or n < 3:
        return math.nan, math.nan
    ranks = np.split(mid_ranks(every), np.cumsum([len(g) for g in groups])[:-1])
    h = 12 / (n * (n + 1)) * sum(r.sum() ** 2 / len(r) for r in ranks) - 3 * (n + 1)
    _, t = np.unique(every, return_counts=True)
    fix = 1 - float((t**3 - t).sum()) / (n**3 - n)
    h = h / fix if fix > 0 else 0.0
    return h, chi2_tail(h, len(groups) - 1)
