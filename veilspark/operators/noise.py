"""Noise for released counts. Counts are aggregated by Spark; noise is added to
the few aggregated cells.

SecureNoise draws from the operating system's entropy with exact rational
samplers (Canonne, Kamath, Steinke 2020). SeededNoise is replayable and gives no
privacy; a release made with it is marked as such.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from collections.abc import Callable
from fractions import Fraction


class SeededNoise:
    """Inverse-transform draws on the counter-based md5 uniforms."""

    secure = False

    def __init__(self, seed: int | str = 0) -> None:
        self.seed = seed

    def uniform(self, salt: str, i: int) -> float:
        return (int(hashlib.md5(f"{salt}|{i}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32

    def laplace(self, scale: float, size: int, salt: str = "") -> list[int]:
        salt = f"{self.seed}{salt}"
        return [math.floor(-scale * math.log(1 - self.uniform(salt + "+", i))) - math.floor(-scale * math.log(1 - self.uniform(salt + "-", i))) for i in range(size)]

    def gaussian(self, sigma: float, size: int, salt: str = "") -> list[int]:
        return [_normal_quantile_on_integers(self.uniform(f"{self.seed}{salt}g", i), sigma) for i in range(size)]


def _normal_quantile_on_integers(u: float, sigma: float) -> int:
    """Quantile of the discrete Gaussian, by adding up its probabilities."""
    reach = max(2, math.ceil(12 * sigma))
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    total, mass = sum(weights), 0.0
    for k, w in zip(range(-reach, reach + 1), weights, strict=True):
        mass += w / total
        if u <= mass:
            return k
    return reach


class SecureNoise:
    """Exact discrete samplers on integers from the operating system."""

    secure = True

    def __init__(self, below: Callable[[int], int] = secrets.randbelow) -> None:
        self._below = below

    def _coin(self, p: Fraction) -> bool:
        return self._below(p.denominator) < p.numerator

    def _coin_exp(self, x: Fraction) -> bool:
        """True with probability exp(-x)."""
        while x > 1:
            if not self._coin_exp_unit(Fraction(1)):
                return False
            x -= 1
        return self._coin_exp_unit(x)

    def _coin_exp_unit(self, x: Fraction) -> bool:
        k = 1
        while self._coin(x / k):
            k += 1
        return k % 2 == 1

    def _laplace(self, scale: Fraction) -> int:
        s, t = scale.denominator, scale.numerator
        while True:
            low = self._below(t)
            if not self._coin_exp(Fraction(low, t)):
                continue
            high = 0
            while self._coin_exp(Fraction(1)):
                high += 1
            size = (low + t * high) // s
            negative = self._below(2) == 1
            if not (negative and size == 0):
                return -size if negative else size

    def laplace(self, scale: float, size: int, salt: str = "") -> list[int]:
        exact = Fraction(scale).limit_denominator(10**6)
        return [self._laplace(exact) for _ in range(size)]

    def gaussian(self, sigma: float, size: int, salt: str = "") -> list[int]:
        variance = Fraction(sigma).limit_denominator(10**6) ** 2
        wide = math.floor(sigma) + 1
        out = []
        while len(out) < size:
            y = self._laplace(Fraction(wide))
            gap = abs(y) - variance / wide
            if self._coin_exp(gap * gap / (2 * variance)):
                out.append(y)
        return out
