"""Driver arithmetic: accounting, bounds, noise. Expected figures are published ones."""

import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilspark.functions import special
from veilspark.operators import audit
from veilspark.operators.accounting import Accountant, BudgetExceeded, BudgetSplit, Charge, allocate, calibrate, epsilon, epsilon_for_scale
from veilspark.operators.noise import SecureNoise, SeededNoise

# target: (profile of 8 Laplace and 12 Gaussian, the same profile with 18 Gaussian and 6 Laplace of sensitivity 2)
PROVED = {
    0.5: (0.4558847146344011, 0.38534588280692106),
    1: (0.9122542470732562, 0.7781757068329299),
    2: (1.827533823411445, 1.5761918554915184),
    4: (3.663710008556676, 3.201144720066901),
    8: (7.3559535878149775, 6.5426925748221745),
}


@pytest.mark.parametrize("target", PROVED)
def test_proved_epsilon(target):
    part = BudgetSplit.of(target)
    profile = Charge("laplace", 1, calibrate(part.profile_eps, mechanism="laplace", steps=8), 8)
    plain = Charge("gaussian", 1, calibrate(part.synthesis_eps, steps=12), 12)
    assert epsilon([profile, plain], 1e-5) == pytest.approx(PROVED[target][0], rel=1e-12)
    measured = Charge("gaussian", 1, calibrate(part.synthesis_eps * 0.75, steps=18), 18)
    picked = Charge("laplace", 2, calibrate(part.synthesis_eps * 0.25, mechanism="laplace", sensitivity=2.0, steps=6), 6)
    assert epsilon([profile, measured, picked], 1e-5) == pytest.approx(PROVED[target][1], rel=1e-12)


@settings(max_examples=25, deadline=None)
@given(st.floats(0.5, 50), st.integers(1, 30), st.sampled_from(["gaussian", "laplace"]))
def test_epsilon_is_monotone(scale, steps, mechanism):
    e = epsilon_for_scale(scale, 1e-5, mechanism, steps=steps)
    assert epsilon_for_scale(scale * 1.5, 1e-5, mechanism, steps=steps) <= e + 1e-12
    assert epsilon_for_scale(scale, 1e-5, mechanism, steps=steps + 1) >= e - 1e-12
    assert e <= steps * epsilon_for_scale(scale, 1e-5, mechanism) + 1e-9


@settings(max_examples=25, deadline=None)
@given(st.floats(0.1, 16), st.integers(1, 30), st.sampled_from(["gaussian", "laplace"]))
def test_calibration_neither_overspends_nor_wastes(target, steps, mechanism):
    reached = epsilon_for_scale(calibrate(target, mechanism=mechanism, steps=steps), 1e-5, mechanism, steps=steps)
    assert 0.98 * target <= reached <= target


def test_budget_refuses_and_keeps_its_state():
    book = Accountant(5.0)
    charge = Charge("gaussian", 1, 2.0)
    book.charge(charge, "a")
    before, total = book.snapshot(), book.total()
    with pytest.raises(BudgetExceeded):
        book.charge(Charge("gaussian", 1, 0.1))
    assert book.total() == total and len(book.rows()) == 1
    book.charge(Charge("laplace", 1, 50.0))
    assert book.total() >= total and book.remaining() < 5 - total + 1e-9
    book.restore(before)
    assert book.total() == total


@pytest.mark.parametrize("bad", [{"sensitivity": 0}, {"noise_scale": -1}, {"steps": 0}, {"sampling_rate": 0}, {"sampling_rate": 1.5}])
def test_bad_charges(bad):
    with pytest.raises(ValueError):
        Charge("gaussian", **bad)


def test_odd_charges():
    assert epsilon([], 1e-5) == 0 and epsilon([Charge("gaussian")], 0) == math.inf
    assert epsilon([Charge("gaussian", 1, 0)], 1e-5) == math.inf
    with pytest.raises(ValueError):
        Charge("exponential")
    with pytest.raises(ValueError):
        epsilon([Charge("laplace", sampling_rate=0.5)], 1e-5)
    assert epsilon([Charge("gaussian", 1, 1, 10, 0.01)], 1e-5) < epsilon([Charge("gaussian", 1, 1, 10)], 1e-5)


def test_allocation():
    assert allocate(2.0, {"a": 3, "b": 1, "c": -5}) == {"a": 1.5, "b": 0.5, "c": 0.0}
    assert allocate(2.0, {"a": 0, "b": -1}) == {"a": 1.0, "b": 1.0} and allocate(1.0, {}) == {}
    assert allocate(3.0, ["x", "y", "z"])["y"] == 1.0


def test_ceilings_and_costs():
    assert audit.epsilon_ceiling(60) == pytest.approx(2.9721, abs=1e-4)
    assert audit.epsilon_ceiling(80) == pytest.approx(3.26606, abs=1e-5)
    assert audit.epsilon_ceiling(200) == pytest.approx(4.1936, abs=1e-4)
    assert [audit.canaries_needed(e) for e in (1, 2, 4, 7.36, 8)] == [10, 24, 166, 4711, 8932]
    assert audit.paired_ceiling(10) == pytest.approx(0.807155, abs=1e-6) and audit.paired_ceiling(800) == pytest.approx(5.376983, abs=1e-6)
    assert audit.detectable(80) == (pytest.approx(0.0079102, abs=1e-7), 0.6)


def test_bounds():
    for correct, n in ((30, 60), (50, 100), (5, 10), (10, 60), (0, 60), (3, 3)):
        assert audit.epsilon_bound(correct, n) == 0
    assert audit.epsilon_bound(5, 5) > 0 and audit.epsilon_bound(60, 60, delta=0.01) == 0
    for n in (10, 60, 200, 800):
        assert audit.epsilon_bound(n, n) == pytest.approx(audit.epsilon_ceiling(n), abs=1e-9)
    assert audit.delta_warning(60, 1e-3) and not audit.delta_warning(60, 1e-5)
    assert audit.paired(0, 60, 0, 60).epsilon == 0 and audit.paired(60, 60, 0, 60).epsilon > 2


def test_distribution_functions():
    for n, p in ((7, 0.3), (40, 0.9)):
        exact = lambda k: sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k, n + 1))  # noqa: B023, E731
        assert all(special.binomial_tail(k, n, p) == pytest.approx(exact(k), rel=1e-10) for k in range(n + 1))
    assert special.beta_cdf(special.beta_quantile(0.3, 4, 7), 4, 7) == pytest.approx(0.3)
    assert special.t_cdf(0, 5) == 0.5 and special.t_cdf(2.015048, 5) == pytest.approx(0.95, abs=1e-6)
    assert special.fisher_greater(3, 1, 1, 3) == pytest.approx(17 / 70)


def test_equivalence():
    rng = random.Random(1)
    x, y = ([rng.gauss(0.5, 0.02) for _ in range(30)] for _ in range(2))
    assert audit.equivalence(x, y, 0.1)[2] and not audit.equivalence(x, [v + 0.3 for v in y], 0.1)[2]
    assert audit.equivalence([1.0], y, 0.1)[1:] == (1.0, False)


def gaussian_fit(draws, sigma):
    weight = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-60, 61)}
    total, chi, cells = sum(weight.values()), 0.0, 0
    for k in range(-8, 9):
        expected = len(draws) * weight[k] / total
        if expected >= 5:
            chi, cells = chi + (draws.count(k) - expected) ** 2 / expected, cells + 1
    return chi, cells


@pytest.mark.parametrize("noise", [SecureNoise(random.Random(3).randrange), SeededNoise(123)])
def test_discrete_gaussian_fits(noise):
    chi, cells = gaussian_fit(noise.gaussian(2.0, 6000), 2.0)
    assert chi < 45 and cells >= 13
    assert any(noise.gaussian(0.29, 20000 if isinstance(noise, SeededNoise) else 4000))


@pytest.mark.parametrize("noise", [SecureNoise(random.Random(5).randrange), SeededNoise(7)])
def test_discrete_laplace_spread(noise):
    draws = noise.laplace(3.0, 5000)
    q = math.exp(-1 / 3.0)
    want = 2 * q / (1 - q) ** 2
    assert sum(d * d for d in draws) / len(draws) == pytest.approx(want, rel=0.12) and abs(sum(draws) / len(draws)) < 0.3
