"""Privacy accounting: Renyi curves of the Gaussian and Laplace mechanisms,
composition, conversion to epsilon, calibration, and budgets.

Curves: Mironov 2017; subsampled Gaussian at integer orders: Mironov, Talwar,
Zhang 2019; conversion: Canonne, Kamath, Steinke 2020.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

#: The order grid, and the limits of the calibration search.
ORDERS: tuple[float, ...] = (*(1 + k / 10 for k in range(1, 100)), *range(11, 64), 128, 256, 512, 1024)
MIN_SCALE, MAX_SCALE = 1e-6, 1e9
GAUSSIAN = ("gaussian", "dp-sgd", "dpsgd")
LAPLACE = ("laplace",)


class BudgetExceeded(Exception):
    """A charge would take the composed epsilon above the budget."""

    def __init__(self, needed: float, budget: float) -> None:
        super().__init__(f"composed epsilon {needed:.6g} would exceed the budget {budget:.6g}")
        self.needed, self.budget = needed, budget


@dataclass(frozen=True)
class Charge:
    """`steps` uses of one mechanism."""

    mechanism: str
    sensitivity: float = 1.0
    noise_scale: float = 1.0
    steps: int = 1
    sampling_rate: float | None = None

    def __post_init__(self) -> None:
        if self.sensitivity <= 0 or self.noise_scale < 0 or self.steps < 1:
            raise ValueError("sensitivity must be positive, noise_scale not negative, steps at least 1")
        if self.sampling_rate is not None and not 0 < self.sampling_rate <= 1:
            raise ValueError("sampling_rate must be in (0, 1]")
        if self.mechanism.lower() not in GAUSSIAN + LAPLACE:
            raise ValueError(f"unknown mechanism {self.mechanism!r}")

    def rdp(self, order: float) -> float:
        """Renyi divergence of all steps at this order."""
        if self.noise_scale == 0:
            return math.inf
        z = self.noise_scale / self.sensitivity
        sampled = self.sampling_rate is not None and self.sampling_rate < 1
        if self.mechanism.lower() in LAPLACE:
            if sampled:
                raise ValueError("no bound for the subsampled Laplace mechanism")
            return self.steps * _laplace_rdp(order, z)
        return self.steps * (_sampled_gaussian_rdp(order, z, self.sampling_rate) if sampled else order / (2 * z * z))


def _laplace_rdp(order: float, z: float) -> float:
    first = math.log(order / (2 * order - 1)) + (order - 1) / z
    second = math.log((order - 1) / (2 * order - 1)) - order / z
    top = max(first, second)
    return (top + math.log(math.exp(first - top) + math.exp(second - top))) / (order - 1)


def _sampled_gaussian_rdp(order: float, z: float, q: float) -> float:
    if order != int(order):
        return math.inf  # the bound holds at integer orders
    n = int(order)
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + (n - k) * math.log1p(-q) + k * math.log(q) + k * (k - 1) / (2 * z * z) for k in range(n + 1)]
    top = max(terms)
    return (top + math.log(sum(math.exp(t - top) for t in terms))) / (n - 1)


def epsilon(charges: Iterable[Charge], delta: float, orders: Sequence[float] = ORDERS) -> float:
    """Epsilon of the composition at `delta`."""
    charges = list(charges)
    if not charges:
        return 0.0
    if delta <= 0 or any(c.noise_scale == 0 for c in charges):
        return math.inf
    best = math.inf
    for a in orders:
        if a <= 1.01:
            continue
        r = sum(c.rdp(a) for c in charges)
        if r == math.inf:
            continue
        if delta * delta + math.expm1(-r) > 0:
            return 0.0
        best = min(best, r + math.log1p(-1 / a) - math.log(delta * a) / (a - 1))
    return max(0.0, best)


@dataclass
class Spend:
    """One accepted charge, for export as a row."""

    charge: Charge
    run_id: str
    total_eps: float
    spend_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    at: str = field(default_factory=lambda: datetime.now(UTC).isoformat())


class Accountant:
    """Composed spend under a budget; a refused charge leaves it unchanged."""

    def __init__(self, budget_eps: float, delta: float = 1e-5, orders: Sequence[float] = ORDERS) -> None:
        if budget_eps <= 0 or not 0 <= delta < 1:
            raise ValueError("the budget must be positive and delta in [0, 1)")
        self.budget_eps, self.delta, self.orders = budget_eps, delta, tuple(orders)
        self.spends: list[Spend] = []

    def total(self) -> float:
        return epsilon((s.charge for s in self.spends), self.delta, self.orders)

    def dry_run(self, *charges: Charge) -> float:
        return epsilon([*(s.charge for s in self.spends), *charges], self.delta, self.orders)

    def remaining(self) -> float:
        return max(0.0, self.budget_eps - self.total())

    def charge(self, charge: Charge, run_id: str = "") -> float:
        """Accept the charge; returns the epsilon that it adds."""
        before, after = self.total(), self.dry_run(charge)
        if after > self.budget_eps:
            raise BudgetExceeded(after, self.budget_eps)
        self.spends.append(Spend(charge, run_id, after))
        return after - before

    def snapshot(self) -> list[Spend]:
        return list(self.spends)

    def restore(self, snapshot: list[Spend]) -> None:
        self.spends = list(snapshot)

    def rows(self) -> list[tuple]:
        """(seq, run_id, mechanism, sensitivity, noise_scale, steps, total_eps) of every spend."""
        return [(i, s.run_id, s.charge.mechanism, float(s.charge.sensitivity), float(s.charge.noise_scale), s.charge.steps, s.total_eps) for i, s in enumerate(self.spends)]


def epsilon_for_scale(scale: float, delta: float, mechanism: str = "gaussian", sensitivity: float = 1.0, steps: int = 1, sampling_rate: float | None = None) -> float:
    return epsilon([Charge(mechanism, sensitivity, scale, steps, sampling_rate)], delta)


def calibrate(target: float, delta: float = 1e-5, mechanism: str = "gaussian", sensitivity: float = 1.0, steps: int = 1, sampling_rate: float | None = None, tolerance: float = 1e-4) -> float:
    """A noise scale whose composed epsilon is at most `target`: bracket by
    doubling from the sensitivity, halve until the bracket's width is within
    `tolerance` of its upper end, and return that (safe) end."""
    if target <= 0 or steps < 1:
        raise ValueError("target must be positive and steps at least 1")

    def reached(scale: float) -> float:
        return epsilon_for_scale(scale, delta, mechanism, sensitivity, steps, sampling_rate)

    low = high = float(sensitivity)
    while reached(high) > target:
        high *= 2
        if high > MAX_SCALE:
            raise ValueError(f"epsilon {target} cannot be reached in {steps} steps")
    while reached(low) < target:
        low /= 2
        if low < MIN_SCALE:
            return MIN_SCALE
    while high - low > tolerance * high:
        middle = 0.5 * (low + high)
        low, high = (middle, high) if reached(middle) > target else (low, middle)
    return high


def allocate(total: float, weights: dict[str, float] | Sequence[str]) -> dict[str, float]:
    """Shares of a total in proportion to max(0, weight), equal shares if none is
    positive or only names are given."""
    if not isinstance(weights, dict):
        weights = dict.fromkeys(weights, 1.0)
    mass = {k: max(0.0, w) for k, w in weights.items()}
    whole = sum(mass.values())
    return {k: total * m / whole if whole > 0 else total / len(mass) for k, m in mass.items()}


@dataclass(frozen=True)
class BudgetSplit:
    """The epsilon of one release, divided between profiling and synthesis."""

    total_eps: float
    profile_eps: float
    synthesis_eps: float
    delta: float = 1e-5

    @classmethod
    def of(cls, total: float, delta: float = 1e-5, profile_share: float = 0.1) -> BudgetSplit:
        if total <= 0 or not 0 < profile_share < 1:
            raise ValueError("total must be positive and profile_share in (0, 1)")
        parts = allocate(total, {"profile": profile_share, "synthesis": 1 - profile_share})
        return cls(total, parts["profile"], parts["synthesis"], delta)
