"""Exact order statistics by a uniform key without a global sort.

Keys are md5 texts, so their first PREFIX hex digits cut the rows into evenly
filled groups. A small histogram of the groups gives the rank at which each
begins; ranks inside a group come from a window over the group alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hex digits of the histogram: at most 65 536 rows per group of `by`.
PREFIX = 4


def _offsets(df: DataFrame, by: list[str]) -> DataFrame:
    """Per prefix the number of rows before it, within each value of `by`."""
    hist = df.groupBy(*by, "__p").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    return hist.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def dense_index(df: DataFrame, key: Column, ties: str, name: str = "index", by: list[str] | None = None) -> DataFrame:
    """df with the rank (from 0) of each row in the order of key, then ties,
    among the rows of equal `by`."""
    by = by or []
    prefixed = df.withColumn("__p", F.substring(key, 1, PREFIX))
    inside = Window.partitionBy(*by, "__p").orderBy("__k", ties)
    offsets = _offsets(prefixed, by) if by else F.broadcast(_offsets(prefixed, by))
    # rows are dealt without their long key, which each task makes again
    keyed = prefixed.repartition(*by, "__p").withColumn("__k", key)
    ranked = keyed.withColumn("__r", F.row_number().over(inside)).join(offsets, [*by, "__p"])
    return ranked.withColumn(name, F.col("__before") + F.col("__r") - 1).drop("__k", "__p", "__r", "__n", "__before")


def smallest(df: DataFrame, key: Column, ties: str, wanted: DataFrame | int, by: list[str] | None = None, name: str = "chosen") -> DataFrame:
    """df with a flag for the `wanted` rows of smallest key: a number, or a table
    (by columns, wanted). Only the group at the border is ranked. All rows are
    chosen where there are no more than wanted."""
    by = by or []
    keyed = df.withColumn("__k", key).withColumn("__p", F.substring("__k", 1, PREFIX))
    offsets = _offsets(keyed, by)
    offsets = offsets.withColumn("wanted", F.lit(wanted)) if isinstance(wanted, int) else offsets.join(wanted, by)
    # without more rows than wanted, the last group is the border and is taken whole
    every = Window.partitionBy(*by)
    border_at = F.least(F.col("wanted"), F.sum("__n").over(every))
    offsets = offsets.withColumn("wanted", border_at)
    cut = offsets.where((F.col("__before") < F.col("wanted")) & (F.col("__before") + F.col("__n") >= F.col("wanted")))
    cut = cut.select(*by, F.col("__p").alias("__cut"), (F.col("wanted") - F.col("__before")).alias("__take"))
    joined = keyed.join(F.broadcast(cut), by, "left") if by else keyed.join(F.broadcast(cut), F.lit(True), "left")
    border = joined.where(F.col("__p") == F.col("__cut"))
    inside = Window.partitionBy(*by, "__p").orderBy("__k", ties)
    border = border.withColumn(name, F.row_number().over(inside) <= F.col("__take"))
    rest = joined.where(~F.coalesce(F.col("__p") == F.col("__cut"), F.lit(False))).withColumn(name, F.coalesce(F.col("__p") < F.col("__cut"), F.lit(False)))
    return rest.unionByName(border).drop("__k", "__p", "__cut", "__take")


def smallest_of_each(df: DataFrame, key: Column, ties: str, wanted: DataFrame, by: list[str], keep) -> DataFrame:
    """For each row of the short table wanted (by, further columns, wanted) the rows of df of
    equal `by` with the smallest key, so many as are wanted, with the further columns.
    Rows are neither dealt nor sorted but for the groups at the borders. keep(df, tag)
    writes a table and reads it back."""
    further = [c for c in wanted.columns if c not in (*by, "wanted")]
    keyed = df.withColumn("__k", key).withColumn("__p", F.substring("__k", 1, PREFIX))
    offsets = _offsets(keyed, by).join(F.broadcast(wanted), by)
    cut = offsets.where((F.col("__before") < F.col("wanted")) & (F.col("__before") + F.col("__n") >= F.col("wanted")))
    cut = keep(cut.select(*by, *further, F.col("__p").alias("__cut"), (F.col("wanted") - F.col("__before")).alias("__take")), "cuts")
    joined = keyed.join(F.broadcast(cut), by)
    inside = Window.partitionBy(*by, *further).orderBy("__k", ties)
    border = joined.where(F.col("__p") == F.col("__cut")).withColumn("__r", F.row_number().over(inside)).where(F.col("__r") <= F.col("__take"))
    return joined.where(F.col("__p") < F.col("__cut")).select(*df.columns, *further).unionByName(border.select(*df.columns, *further))
