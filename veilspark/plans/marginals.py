"""All marginals of a release in one scan: one GROUPING SETS aggregation over
level codes, completed to the full public domain afterwards.

The shuffle carries at most the sum of the cliques' cell numbers per map task,
whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import NUMERICAL, PublicSchema


def level_codes(df: DataFrame, schema: PublicSchema, bins: int) -> DataFrame:
    """Integer level of every declared column; -1 for an undeclared category."""
    return df.select(*[(c.in_bins(bins) if c.kind == NUMERICAL else c.code()).cast("int").alias(c.name) for c in schema.columns])


def level_counts(schema: PublicSchema, bins: int) -> dict[str, int]:
    return {c.name: bins if c.kind == NUMERICAL else len(c.categories) for c in schema.columns}


@dataclass(frozen=True)
class MarginalPlan:
    """The cliques (tuples of one or two columns) that a release measures."""

    cliques: tuple[tuple[str, ...], ...]

    def counts(self, codes: DataFrame) -> DataFrame:
        """(clique, a, b, n) of the cells that occur, from one scan."""
        columns = sorted({c for q in self.cliques for c in q}, key=codes.columns.index)
        sets = [[F.col(c) for c in q] for q in self.cliques]
        grouped = codes.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
        width, name, first, second = len(columns), None, None, None
        for q in self.cliques:
            bits = sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in q)
            here = F.col("g") == bits
            values = "|".join(q), F.col(q[0]), F.col(q[1]) if len(q) > 1 else F.lit(None).cast("int")
            name = F.when(here, values[0]) if name is None else name.when(here, values[0])
            first = F.when(here, values[1]) if first is None else first.when(here, values[1])
            second = F.when(here, values[2]) if second is None else second.when(here, values[2])
        return grouped.select(name.alias("clique"), first.alias("a"), second.alias("b"), "n")

    def tables(self, codes: DataFrame, sizes: dict[str, int]) -> dict[tuple[str, ...], np.ndarray]:
        """True cell counts by clique, empty cells included; cells only, no rows."""
        out = {q: np.zeros([sizes[c] for c in q]) for q in self.cliques}
        by_name = {"|".join(q): q for q in self.cliques}
        for r in self.counts(codes).collect():
            q = by_name[r["clique"]]
            at = (r["a"],) if len(q) == 1 else (r["a"], r["b"])
            if min(at) >= 0:
                out[q][at] += r["n"]
        return out


def numeric_histogram(df: DataFrame, column: str, lower: float, upper: float, bins: int) -> DataFrame:
    """(bin, n) for every bin; values outside the range are left out and the
    last bin takes its upper edge."""
    x = F.col(column)
    at = F.least(F.lit(bins - 1), F.floor((x - lower) / (upper - lower) * bins).cast("int"))
    seen = df.where((x >= lower) & (x <= upper)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(seen, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def category_counts(df: DataFrame, column: str, levels: tuple[str, ...]) -> DataFrame:
    """(level, n) for the released levels only, zero where a level is absent."""
    domain = df.sparkSession.createDataFrame([(v,) for v in levels], "level string")
    seen = df.groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"))
    return domain.join(seen, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))
