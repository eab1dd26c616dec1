"""Adaptive mechanisms: measure one-way marginals, then repeatedly pick the pair
that the current model predicts worst (noisy maximum) and measure it.

`adaptive_tree` only takes pairs that keep the model a forest, so estimates are
closed form. `aim` takes any pair whose junction tree stays within a size bound
and fits a joint model by mirror descent. True marginals of all pairs come from
one scan; nothing iterative touches the rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from ..plans.marginals import MarginalPlan, level_codes, level_counts
from .accounting import Charge, calibrate
from .generators import TREE_BINS, Mechanism, _cdf, draw, normalised

#: Fixed values of the loop.
ROUNDS, SELECTION_SHARE, MODEL_MB, STEPS, FINAL_STEPS = 6, 0.25, 128.0, 150, 400


class Adaptive(Mechanism):
    """The measuring loop; subclasses say which pairs are allowed and model them."""

    bins = TREE_BINS

    def fit(self, df, schema, accountant, eps):
        names = schema.names
        pairs = tuple(itertools.combinations(names, 2))
        rounds = min(ROUNDS, len(pairs))
        pick_eps = eps * SELECTION_SHARE if rounds else 0.0
        sigma = calibrate(eps - pick_eps, accountant.delta, "gaussian", 1.0, len(names) + rounds)
        scale = calibrate(pick_eps, accountant.delta, "laplace", 2.0, rounds) if rounds else 0.0
        self.sizes = level_counts(schema, self.bins)
        true = MarginalPlan((*((c,) for c in names), *pairs)).tables(level_codes(df, schema, self.bins), self.sizes)
        self.total = float(true[(names[0],)].sum())
        self.measured: dict[tuple[str, ...], np.ndarray] = {}
        self.skipped: list[tuple[str, str]] = []
        self.schema = schema
        for c in names:
            accountant.charge(Charge("gaussian", 1.0, sigma, 1), f"one-way {c}")
            self.measured[(c,)] = true[(c,)] + self.noise.gaussian(sigma, self.sizes[c], c)
        open_ = list(pairs)
        for r in range(rounds):
            allowed = [q for q in open_ if self._allowed(q)]
            self.skipped += [q for q in open_ if q not in allowed and q not in self.skipped]
            if not allowed:
                break
            self._estimate(STEPS)
            accountant.charge(Charge("laplace", 2.0, scale, 1), f"select {r}")
            noise = self.noise.laplace(scale, len(allowed), f"select {r}")
            errors = [np.abs(true[q] - self._pair(q)).sum() + z for q, z in zip(allowed, noise, strict=True)]
            chosen = allowed[int(np.argmax(errors))]
            open_.remove(chosen)
            accountant.charge(Charge("gaussian", 1.0, sigma, 1), "pair " + "|".join(chosen))
            self.measured[chosen] = true[chosen] + np.reshape(self.noise.gaussian(sigma, true[chosen].size, "|".join(chosen)), true[chosen].shape)
        self._estimate(FINAL_STEPS)
        return self

    def _one(self, c: str) -> np.ndarray:
        return normalised(self.measured[(c,)])

    def _columns(self):
        return {c: self._value(c, F.col(f"__{c}"), self.bins) for c in self.schema.names}

    def generate(self, spark, rows):
        if self.schema is None:
            raise RuntimeError("fit before generate")
        df = spark.range(rows).withColumnRenamed("id", "rid")
        for c, parents, table in self._draws():
            at = F.lit(0)
            for p in parents:
                at = at * self.sizes[p] + F.col(f"__{p}")
            cdf = F.element_at(F.array(*[_cdf(row) for row in table]), (at + 1).cast("int"))
            df = df.withColumn(f"__{c}", draw(cdf, self._u("l", c), self.sizes[c]))
        return df.select("rid", *[col.alias(n) for n, col in self._columns().items()])


class AdaptiveTree(Adaptive):
    name = "adaptive_tree"

    def _root(self, c: str) -> str:
        up = {n: n for n in self.schema.names}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for q in self.measured:
            if len(q) == 2:
                up[root(q[1])] = root(q[0])
        return root(c)

    def _allowed(self, q):
        return self._root(q[0]) != self._root(q[1])

    def _estimate(self, steps):
        """Forest parents in breadth-first order with conditionals."""
        edges = [q for q in self.measured if len(q) == 2]
        self.order: list[tuple[str, str | None, np.ndarray]] = []
        done: set[str] = set()
        for start in self.schema.names:
            if start in done:
                continue
            done.add(start)
            self.order.append((start, None, self._one(start)[None, :]))
            queue = [start]
            while queue:
                here = queue.pop(0)
                for a, b in edges:
                    other = b if a == here else a if b == here else None
                    if other and other not in done:
                        done.add(other)
                        joint = self.measured[(a, b)]
                        self.order.append((other, here, normalised(joint if a == here else joint.T)))
                        queue.append(other)
        self.marginal = {}
        for c, parent, table in self.order:
            self.marginal[c] = table[0] if parent is None else self.marginal[parent] @ table

    def _pair(self, q):
        """Expected counts of a pair that the forest does not join: independent."""
        return self.total * np.outer(self.marginal[q[0]], self.marginal[q[1]])

    def _draws(self):
        for c, parent, table in self.order:
            yield c, [parent] if parent else [], table


class Aim(Adaptive):
    """Joint model over junction-tree cliques, by mirror descent on the cells."""

    name = "aim"

    def _cliques(self, extra=()) -> list[tuple[str, ...]]:
        """Maximal cliques after eliminating columns of least fill."""
        near = {c: set() for c in self.schema.names}
        for q in [*self.measured, *extra]:
            if len(q) == 2:
                near[q[0]].add(q[1])
                near[q[1]].add(q[0])
        found, order = [], {c: i for i, c in enumerate(self.schema.names)}
        near = {c: set(v) for c, v in near.items()}
        while near:
            c = min(near, key=lambda x: (math.prod(self.sizes[y] for y in near[x] | {x}), order[x]))
            clique = near.pop(c) | {c}
            if not any(clique <= set(f) for f in found):
                found.append(tuple(sorted(clique, key=order.get)))
            for a in clique - {c}:
                near[a] |= clique - {a, c}
                near[a].discard(c)
        return found

    def _allowed(self, q):
        cells = sum(math.prod(self.sizes[c] for c in k) for k in self._cliques([q]))
        return cells * 8 / 2**20 <= MODEL_MB

    def _tree(self, cliques):
        """(clique, parent, separator) with parents first, by largest overlap."""
        left, done = list(range(1, len(cliques))), [0]
        out = [(0, None, ())]
        while left:
            i, j = max(((a, b) for a in left for b in done), key=lambda p: (len(set(cliques[p[0]]) & set(cliques[p[1]])), -p[0], -p[1]))
            out.append((i, j, tuple(c for c in cliques[i] if c in cliques[j])))
            left.remove(i)
            done.append(i)
        return out

    @staticmethod
    def _sum_to(table, columns, keep):
        at = tuple(i for i, c in enumerate(columns) if c not in keep)
        return table.sum(axis=at) if at else table

    def _shape(self, columns, of):
        return [self.sizes[c] if c in columns else 1 for c in of]

    def _beliefs(self, theta):
        """Clique marginals of the model exp(theta), by one pass up and one down."""
        k = [np.exp(t - t.max()) for t in theta]
        ratio = {}
        for i, j, sep in reversed(self.tree):
            if j is not None:
                message = self._sum_to(k[i], self.cliques[i], sep)
                ratio[i] = message
                k[j] = k[j] * message.reshape(self._shape(sep, self.cliques[j]))
                k[j] /= k[j].sum()
        for i, j, sep in self.tree:
            if j is not None:
                now = self._sum_to(k[j], self.cliques[j], sep)
                k[i] = k[i] * (now / np.maximum(ratio[i], 1e-300)).reshape(self._shape(sep, self.cliques[i]))
            k[i] = k[i] / k[i].sum()
        return k

    def _estimate(self, steps):
        self.cliques = self._cliques()
        self.tree = self._tree(self.cliques)
        home = {q: next(i for i, c in enumerate(self.cliques) if set(q) <= set(c)) for q in self.measured}
        theta = [np.zeros([self.sizes[c] for c in k]) for k in self.cliques]
        goal = {q: y / max(self.total, 1) for q, y in self.measured.items()}

        def loss_and_slope(beliefs):
            loss, slope = 0.0, [np.zeros_like(t) for t in theta]
            for q, y in goal.items():
                i = home[q]
                gap = self._sum_to(beliefs[i], self.cliques[i], q) - y
                loss += 0.5 * float((gap * gap).sum())
                slope[i] = slope[i] + gap.reshape(self._shape(q, self.cliques[i]))
            return loss, slope

        beliefs, step = self._beliefs(theta), 1.0
        loss, slope = loss_and_slope(beliefs)
        for _ in range(steps):
            while step > 1e-8:
                trial = [t - step * s for t, s in zip(theta, slope, strict=True)]
                moved = self._beliefs(trial)
                new, new_slope = loss_and_slope(moved)
                if new <= loss:
                    theta, beliefs, loss, slope, step = trial, moved, new, new_slope, step * 1.5
                    break
                step /= 2
            else:
                break
        self.beliefs = beliefs

    def _pair(self, q):
        """Expected counts of any pair of columns, through the tree if they share no clique."""
        for k, b in zip(self.cliques, self.beliefs, strict=True):
            if set(q) <= set(k):
                return self.total * self._sum_to(b, k, q)
        return self.total * self._through(q)

    def _through(self, q):
        """P(a, b): carry the joint with column a along the tree path to b."""
        parents = {i: (j, sep) for i, j, sep in self.tree}
        start = next(i for i, k in enumerate(self.cliques) if q[0] in k)
        goal = next(i for i, k in enumerate(self.cliques) if q[1] in k)

        def up(i):
            out = [i]
            while parents[out[-1]][0] is not None:
                out.append(parents[out[-1]][0])
            return out

        a, b = up(start), up(goal)
        meet = next(x for x in a if x in b)
        path = a[: a.index(meet) + 1] + b[: b.index(meet)][::-1]
        table, columns = self.beliefs[start], self.cliques[start]
        joint = np.moveaxis(table, columns.index(q[0]), 0)
        columns = [q[0], *[c for c in columns if c != q[0]]]
        for here, there in itertools.pairwise(path):
            sep = [c for c in self.cliques[there] if c in self.cliques[here]]
            keep = [c for c in columns[1:] if c in sep]
            carried = joint.sum(axis=tuple(i for i, c in enumerate(columns) if i and c not in keep)).reshape(self.sizes[q[0]], -1)
            target = self.cliques[there]
            order = [target.index(c) for c in keep] + [i for i, c in enumerate(target) if c not in keep]
            flat = np.transpose(self.beliefs[there], order).reshape(carried.shape[1], -1)
            rest = [target[i] for i in order[len(keep) :]]
            joint = (carried[:, :, None] * normalised(flat)[None, :, :]).reshape(self.sizes[q[0]], *[self.sizes[c] for c in keep], *[self.sizes[c] for c in rest])
            columns = [q[0], *keep, *rest]
        return joint.sum(axis=tuple(i for i, c in enumerate(columns) if i and c != q[1]))

    def _draws(self):
        """Each clique's new columns one by one, given those drawn before in it."""
        done: list[str] = []
        for i, _, _ in self.tree:
            columns, table = self.cliques[i], self.beliefs[i]
            given = [c for c in columns if c in done]
            for c in columns:
                if c in done:
                    continue
                keep = [*given, c]
                part = self._sum_to(table, columns, keep)
                now = [x for x in columns if x in keep]
                flat = np.transpose(part, [now.index(x) for x in keep]).reshape(-1, self.sizes[c])
                yield c, list(given), normalised(flat)
                given.append(c)
                done.append(c)


MODELS: dict[str, type[Mechanism]] = {m.name: m for m in (AdaptiveTree, Aim)}
