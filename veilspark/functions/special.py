"""Distribution functions in closed form: the regularised incomplete beta
function and what follows from it. Plain driver arithmetic on a few numbers."""

from __future__ import annotations

import math


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta I_x(a, b), by its continued fraction."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 2000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * total


def beta_quantile(q: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if beta_cdf(mid, a, b) < q else (lo, mid)
    return 0.5 * (lo + hi)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P[Bin(n, p) >= k]."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else beta_cdf(p, k, n - k + 1)


def t_cdf(t: float, df: float) -> float:
    half = 0.5 * beta_cdf(df / (df + t * t), df / 2, 0.5)
    return 1 - half if t > 0 else half


def fisher_greater(a: int, b: int, c: int, d: int) -> float:
    """One-sided Fisher p-value of the table [[a, b], [c, d]]: first cell at least a."""
    row, col, total = a + b, a + c, a + b + c + d
    ways = sum(math.comb(row, k) * math.comb(total - row, col - k) for k in range(a, min(row, col) + 1))
    return ways / math.comb(total, col)


def clopper_pearson(k: int, n: int, alpha: float = 0.05) -> tuple[float, float]:
    if n <= 0:
        return 0.0, 1.0
    low = 0.0 if k <= 0 else beta_quantile(alpha / 2, k, n - k + 1)
    high = 1.0 if k >= n else beta_quantile(1 - alpha / 2, k + 1, n - k)
    return low, high
