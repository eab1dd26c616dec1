"""Synthesis mechanisms. Fitting takes one grouped scan of the data; sampling is
a projection over a range of row numbers, so it is narrow and needs no shuffle."""

from __future__ import annotations

import itertools
from abc import ABC, abstractmethod

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import seeded
from ..plans.marginals import MarginalPlan, level_codes, level_counts
from ..plans.ranking import dense_index, smallest
from ..schema import NUMERICAL, PublicSchema
from ..sources.scratch import materialized
from .accounting import Accountant, Charge, calibrate
from .noise import SecureNoise

#: Bins of numeric columns in the one-way and the tree mechanism.
ONE_WAY_BINS, TREE_BINS = 10, 12


def normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities from noisy counts along the last axis; uniform where nothing is left."""
    counts = np.maximum(np.asarray(counts, float), 0.0)
    total = counts.sum(axis=-1, keepdims=True)
    return np.where(total > 0, counts / np.where(total > 0, total, 1), 1.0 / counts.shape[-1])


def _cdf(p: np.ndarray) -> Column:
    return F.array(*[F.lit(float(x)) for x in np.cumsum(p)])


def draw(cdf: Column, u: Column, levels: int) -> Column:
    """Level whose cumulative probability first exceeds u."""
    return F.least(F.lit(levels - 1), F.size(F.filter(cdf, lambda c: c <= u)))


class Mechanism(ABC):
    """fit once on private data, then generate any number of rows."""

    name = "mechanism"

    def __init__(self, seed: int = 0, noise=None) -> None:
        self.seed, self.noise, self.schema = seed, noise or SecureNoise(), None

    @abstractmethod
    def fit(self, df: DataFrame, schema: PublicSchema, accountant: Accountant, eps: float) -> Mechanism: ...

    @abstractmethod
    def _columns(self) -> dict[str, Column]: ...

    def generate(self, spark: SparkSession, rows: int) -> DataFrame:
        if self.schema is None:
            raise RuntimeError("fit before generate")
        return spark.range(rows).withColumnRenamed("id", "rid").withColumns(self._levels()).select("rid", *[c.alias(n) for n, c in self._columns().items()])

    def _levels(self) -> dict[str, Column]:
        return {}

    def _u(self, what: str, column: str) -> Column:
        return seeded.uniform(f"{self.seed}{what}{column}", "rid")

    def _value(self, name: str, level: Column, bins: int) -> Column:
        """A point in a numeric bin, or the category of a level."""
        spec = self.schema[name]
        if spec.kind == NUMERICAL:
            return F.lit(float(spec.lower)) + (level + self._u("v", name)) * (spec.width / bins)
        return F.element_at(F.array(*[F.lit(v) for v in spec.categories]), (level + 1).cast("int"))


class Independent(Mechanism):
    """A product of noisy one-way marginals."""

    name, bins = "independent", ONE_WAY_BINS

    def fit(self, df, schema, accountant, eps):
        plan = MarginalPlan(tuple((c,) for c in schema.names))
        sigma = calibrate(eps, accountant.delta, "gaussian", 1.0, len(plan.cliques))
        for c in schema.names:
            accountant.charge(Charge("gaussian", 1.0, sigma, 1), f"one-way {c}")
        tables = plan.tables(level_codes(df, schema, self.bins), level_counts(schema, self.bins))
        self.probabilities = {q[0]: normalised(t + self.noise.gaussian(sigma, t.size, q[0])) for q, t in tables.items()}
        self.schema = schema
        return self

    def _levels(self):
        return {f"__{c}": draw(_cdf(p), self._u("l", c), len(p)) for c, p in self.probabilities.items()}

    def _columns(self):
        return {c: self._value(c, F.col(f"__{c}"), self.bins) for c in self.schema.names}


class GaussianColumns(Mechanism):
    """Noisy mean and deviation of each numeric column, noisy histogram of each
    categorical one. `width_sensitivity` charges width / n instead of one."""

    name = "gaussian_columns"

    def fit(self, df, schema, accountant, eps):
        numbers = schema.of_kind(NUMERICAL)
        steps = 2 * len(numbers) + len(schema.columns) - len(numbers)
        sigma = calibrate(eps, accountant.delta, "gaussian", 1.0, steps)
        accountant.charge(Charge("gaussian", 1.0, sigma, steps), "per column")
        clipped = schema.clip(df)
        self.moments, self.probabilities = {}, {}
        if numbers:
            one = clipped.agg(F.count("*").alias("n"), *[f(c.name).alias(k + c.name) for c in numbers for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
            for c in numbers:
                a, b = self.noise.gaussian(sigma, 2, c.name)
                spread = one["s" + c.name] if one["n"] > 1 else 1.0
                self.moments[c.name] = ((one["m" + c.name] or 0.0) + a, max(1e-3, spread + b))
        names = tuple((c.name,) for c in schema.columns if c.kind != NUMERICAL)
        if names:
            tables = MarginalPlan(names).tables(level_codes(df, schema, 1), level_counts(schema, 1))
            self.probabilities = {q[0]: normalised(t + self.noise.gaussian(sigma, t.size, q[0])) for q, t in tables.items()}
        self.schema = schema
        return self

    def _levels(self):
        return {f"__{c}": draw(_cdf(p), self._u("l", c), len(p)) for c, p in self.probabilities.items()}

    def _columns(self):
        out = {}
        for c in self.schema.names:
            if c in self.moments:
                mean, spread = self.moments[c]
                out[c] = F.lit(mean) + F.lit(spread) * seeded.gaussian(f"{self.seed}n{c}", "rid")
            else:
                out[c] = self._value(c, F.col(f"__{c}"), 1)
        return out


class Pairwise(Mechanism):
    """A tree of two-way marginals, a chain of the columns by default; sampled
    from the root down, each level drawn from the row of its parent's level."""

    name, bins = "pairwise", TREE_BINS

    def __init__(self, seed: int = 0, noise=None, tree: list[tuple[str, str]] | None = None) -> None:
        super().__init__(seed, noise)
        self.tree = tree

    def fit(self, df, schema, accountant, eps):
        names = schema.names
        edges = list(itertools.pairwise(names)) if self.tree is None else self.tree
        known = {names[0]}
        for parent, child in edges:
            if parent not in known or child in known:
                raise ValueError("a tree starts at the first column and lists parents before children")
            known.add(child)
        if known != set(names):
            raise ValueError(f"the tree leaves out {sorted(set(names) - known)}")
        plan = MarginalPlan(((names[0],), *edges))
        sigma = calibrate(eps, accountant.delta, "gaussian", 1.0, len(plan.cliques))
        for q in plan.cliques:
            accountant.charge(Charge("gaussian", 1.0, sigma, 1), "tree " + "|".join(q))
        tables = plan.tables(level_codes(df, schema, self.bins), level_counts(schema, self.bins))
        self.schema, self.edges = schema, edges
        self._set({q: t + np.reshape(self.noise.gaussian(sigma, t.size, "|".join(q)), t.shape) for q, t in tables.items()})
        return self

    def _set(self, noisy: dict[tuple[str, ...], np.ndarray]) -> None:
        self.root = normalised(noisy[(self.schema.names[0],)])
        self.conditional = {e: normalised(noisy[e]) for e in self.edges}

    def generate(self, spark, rows):
        if self.schema is None:
            raise RuntimeError("fit before generate")
        root = self.schema.names[0]
        df = spark.range(rows).withColumnRenamed("id", "rid").withColumn(f"__{root}", draw(_cdf(self.root), self._u("l", root), len(self.root)))
        for (parent, child), p in self.conditional.items():
            table = F.array(*[_cdf(row) for row in p])
            df = df.withColumn(f"__{child}", draw(F.element_at(table, (F.col(f"__{parent}") + 1).cast("int")), self._u("l", child), p.shape[1]))
        return df.select("rid", *[c.alias(n) for n, c in self._columns().items()])

    def _columns(self):
        return {c: self._value(c, F.col(f"__{c}"), self.bins) for c in self.schema.names}


def leaky_release(df: DataFrame, columns: list[str], share: float, key: str = "rid", salt: str = "leak") -> DataFrame:
    """A non-private control: round(n * share) rows verbatim (those of smallest
    seeded key), each other row made of values of independently drawn rows."""
    df = materialized(df.select(key, *columns), "leak")
    n = df.count()
    kept = int(n * share + 0.5)
    verbatim = smallest(df, seeded.key(salt, key), key, kept).where("chosen").drop("chosen").withColumn("verbatim", F.lit(True))
    indexed = materialized(dense_index(df, seeded.key(salt + "i", key), key), "index")
    rest = df.sparkSession.range(kept, n).select(F.col("id").alias("slot"))
    for c in columns:
        pick = F.floor(seeded.uniform(salt + c, "slot") * n)
        rest = rest.withColumn("index", pick).join(indexed.select("index", c), "index").drop("index")
    return verbatim.unionByName(rest.select((-1 - F.col("slot")).alias(key), *columns, F.lit(False).alias("verbatim")))


MECHANISMS: dict[str, type[Mechanism]] = {m.name: m for m in (Independent, GaussianColumns, Pairwise)}
#: Shares of verbatim rows of the controls; they are no mechanisms.
CONTROLS = {"full": 1.0, "half": 0.5, "tenth": 0.1, "shuffled": 0.0}
