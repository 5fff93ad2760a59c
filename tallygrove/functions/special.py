"""Distribution functions in numpy, for the few rows that tests leave."""

from __future__ import annotations

import math

import numpy as np


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_sf(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def _solve(f, low: float, high: float, rounds: int = 200) -> float:
    """Where an increasing function crosses 0, by bisection."""
    for _ in range(rounds):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _solve(lambda x: norm_cdf(x) - p, -40, 40)


def beta_inc(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def gamma_inc(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        for k in range(1, 10_000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-16:
                break
        return front * total
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for k in range(1, 10_000):
        top = -k * (k - a)
        b += 2
        d = 1 / (top * d + b or 1e-300)
        c = b + top / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - front * h


def t_sf(t: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
    return tail if t >= 0 else 1 - tail


def t_ppf(p: float, df: float) -> float:
    return _solve(lambda x: 1 - t_sf(x, df) - p, -1e6, 1e6)


def f_sf(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: float, df: float) -> float:
    return 1 - gamma_inc(df / 2, x / 2)


_X, _W = np.polynomial.legendre.leggauss(64)


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z = np.linspace(-8, 8, 401)
    cdf = np.array([norm_cdf(v) for v in z])
    at = np.interp(z[None, :] - w[:, None], z, cdf, left=0.0, right=1.0)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return np.trapezoid(k * density[None, :] * np.maximum(cdf[None, :] - at, 0) ** (k - 1), z, axis=1)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """P(studentised range > q) for k groups and df, by Gauss-Legendre over the standard deviation."""
    if q <= 0:
        return 1.0
    if df > 5000:
        return float(1 - _range_cdf(np.array([q]), k)[0])
    spread = 8 / math.sqrt(2 * df)
    low, high = max(1e-6, 1 - spread), 1 + spread
    s = (high - low) / 2 * _X + (high + low) / 2
    log = (df / 2) * math.log(df) - math.lgamma(df / 2) - (df / 2 - 1) * math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(min(1.0, max(0.0, 1 - (high - low) / 2 * np.sum(_W * np.exp(log) * _range_cdf(q * s, k)))))


def studentized_range_ppf(p: float, k: int, df: float) -> float:
    return _solve(lambda x: 1 - studentized_range_sf(x, k, df) - p, 0, 200, 40)


def mannwhitney_exact_sf(u: float, n1: int, n2: int) -> float:
    """P(U >= u) without ties, by counting."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1
    for i in range(1, n1 + 1):  # the q-binomial coefficient, factor by factor
        for j in range(n1 * n2, n2 + i - 1, -1):
            ways[j] -= ways[j - n2 - i]
        for j in range(i, n1 * n2 + 1):
            ways[j] += ways[j - i]
    return float(ways[math.ceil(u) :].sum() / ways.sum())


def wilcoxon_exact_cdf(w: float, n: int) -> float:
    """P(W <= w) for the sum of positive ranks of n values without ties."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r]
    return float(ways[: math.floor(w) + 1].sum() / 2.0**n)


#: The shares of Poisson numbers with mean 1 that are at most 0, 1 .. 11, of 2 ** 32; what is over 12 is rarer than one.
_POISSON = np.round(np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)])) * (1 << 32)).astype(np.uint32)


def poisson_of_one(rng: np.random.Generator, n: int) -> np.ndarray:
    """n Poisson numbers with mean 1, from uniform numbers of 32 bits."""
    u, w = rng.integers(0, 1 << 32, n, np.uint32), np.zeros(n, np.uint8)
    for share in _POISSON:
        w += u >= share
    return w
