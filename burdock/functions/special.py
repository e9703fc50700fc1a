"""Distribution functions without scipy: Student t, normal, rank-sum, binomial, beta."""

from __future__ import annotations

import math

import numpy as np


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    tiny, c, f = 1e-300, 1.0, 1.0
    d = 1 / max(abs(v := 1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, v)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a * f


def t_two_sided(t: float, df: float) -> float:
    return betainc(df / 2, 0.5, df / (df + t * t))


def normal_sf(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def rank_sum_counts(n: int, m: int) -> np.ndarray:
    """Number of orders of n and m values for each U without ties, by adding one value at a time."""
    counts = np.zeros(n * m + 1)
    counts[0] = 1
    for i in range(1, n + 1):  # Gaussian binomial: times (1 - q^(m+i)) / (1 - q^i)
        top = m + i
        for u in range(n * m, top - 1, -1):
            counts[u] -= counts[u - top]
        for u in range(i, n * m + 1):
            counts[u] += counts[u - i]
    return counts


def mann_whitney(u: float, n: int, m: int, ties: float, side: str = "two-sided") -> float:
    """p of U. Exact if the smaller group has at most 8 values and nothing ties, else normal with tie and continuity
    correction. ``ties``: sum of t^3 - t over tied groups."""
    most = max(u, n * m - u) if side == "two-sided" else u
    if min(n, m) <= 8 and not ties:
        counts = rank_sum_counts(n, m)
        p = counts[math.ceil(most) :].sum() / counts.sum()
    else:
        total = n + m
        sd = math.sqrt(n * m / 12 * (total + 1 - ties / (total * (total - 1))))
        p = normal_sf((most - n * m / 2 - 0.5) / sd) if sd else 1.0
    return min(1.0, 2 * p if side == "two-sided" else p)


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """P(X >= k); by logarithms, so that no count is too large."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    return min(1.0, math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k, n + 1)))


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if betainc(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    tail = (1 - level) / 2
    return (beta_quantile(tail, k, n - k + 1) if k else 0.0, beta_quantile(1 - tail, k + 1, n - k) if k < n else 1.0)
