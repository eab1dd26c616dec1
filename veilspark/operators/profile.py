"""Private domain discovery: declared domains are free, undeclared numeric
ranges cost two Laplace queries and undeclared category domains one."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import CATEGORICAL, NUMERICAL, ColumnSpec, PublicSchema, fallback_kinds
from .accounting import Accountant, Charge, calibrate
from .noise import SecureNoise

#: Fixed value: a category is released if its noisy count is this many standard deviations.
THRESHOLD_FACTOR = 3.0


@dataclass(frozen=True)
class Profile:
    schema: PublicSchema
    suppressed: dict[str, int]
    public: frozenset[str]
    eps_spent: float


def threshold(scale: float, factor: float = THRESHOLD_FACTOR) -> float:
    return factor * scale * math.sqrt(2.0)


def query_count(kinds: dict[str, str], declared: PublicSchema) -> int:
    """One query a categorical column, two an undeclared numeric one."""
    return sum(1 if k == CATEGORICAL else 0 if declared.bounds(c) else 2 for c, k in kinds.items())


def discover(df: DataFrame, declared: PublicSchema, accountant: Accountant, eps: float, noise=None, over: str = "declared") -> Profile:
    """A released schema for df. over="declared": a declared category domain is
    the domain that is tested, including values that do not occur; "observed":
    only values that occur are tested (the support then depends on the data)."""
    noise = noise or SecureNoise()
    specs = {c.name: c for c in declared.columns}
    fallback = fallback_kinds(df.select(*[c for c in df.columns if c not in specs])) if set(df.columns) - set(specs) else {}
    kinds = {c: specs[c].kind if c in specs else fallback[c] for c in df.columns}
    n = query_count(kinds, declared)
    unit = calibrate(eps, accountant.delta, "laplace", 1.0, n) if n else 0.0
    before, out, suppressed, public = accountant.total(), [], {}, set()
    for c, kind in kinds.items():
        if kind == NUMERICAL and declared.bounds(c):
            out.append(specs[c])
            public.add(c)
        elif kind == NUMERICAL:
            accountant.charge(Charge("laplace", 1.0, unit, 2), f"range {c}")
            low, high = df.agg(F.min(c), F.max(c)).first()
            a, b = noise.laplace(unit, 2, f"range {c}")
            out.append(ColumnSpec(c, NUMERICAL, float(low) + a, max(float(low) + a + 1.0, float(high) + b)))
        else:
            accountant.charge(Charge("laplace", 1.0, unit, 1), f"domain {c}")
            counts = {r[0]: r["count"] for r in df.groupBy(F.col(c).cast("string").alias(c)).count().collect()}
            levels = list(specs[c].categories) if over == "declared" and c in specs and specs[c].categories else sorted(x for x in counts if x is not None)
            noisy = dict(zip(levels, noise.laplace(unit, len(levels), f"domain {c}"), strict=True))
            kept = [v for v in levels if counts.get(v, 0) + noisy[v] >= threshold(unit)]
            kept = kept or [max(levels, key=lambda v: counts.get(v, 0))]
            suppressed[c] = len(levels) - len(kept)
            out.append(ColumnSpec(c, CATEGORICAL, categories=tuple(kept)))
    return Profile(PublicSchema(tuple(out)), suppressed, frozenset(public), accountant.total() - before)
