"""Audit of each level of a sensitive attribute, over many seeds in one plan.

Canaries are dealt to the levels and get the level as their attribute, so each
belongs to its group by construction. One release a seed is scored; ranks,
guesses and bounds are taken level by level. Bounds, p-values, equivalence tests
and the detectable effect are columns on the grouped counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import distributions, seeded
from ..schema import PublicSchema
from ..sources.scratch import materialized
from . import audit, cells

SALT = "subgroup"
#: Equivalence margin of the accuracy around one half, fixed before any analysis.
MARGIN = 0.10
GROUP = ["seed", "level"]


def stratified_canaries(df: DataFrame, schema: PublicSchema, attribute: str, total: int, seeds: Sequence[int], least: int = 20, balanced: bool = True) -> DataFrame:
    """seed, level, share, canary_id (from 0 in a seed), the schema's columns with
    the attribute forced to the level, included (drawn per level, never all or none)."""
    if attribute not in schema.names:
        raise KeyError(f"no declared column {attribute!r}")
    dealt = audit.allocate_subgroups(df, attribute, total, least, balanced)
    drawn = dealt.select(F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"), "level", "share", F.explode(F.sequence(F.lit(1).cast("long"), "canaries")).alias("k"))
    values = audit.canary_columns(schema, SALT, ["seed", "level", "k"])
    values[schema.names.index(attribute)] = F.col("level").alias(attribute)
    number = F.row_number().over(Window.partitionBy("seed").orderBy("level", "k")) - 1
    cans = drawn.select("seed", "level", "share", number.cast("long").alias("canary_id"), *values, (seeded.uniform(SALT + "in", "seed", "level", "k") < 0.5).alias("included"))
    return audit.repaired(cans, GROUP)


def planted(df: DataFrame, canaries: DataFrame, columns: list[str], seeds: Sequence[int], key: str = "rid") -> DataFrame:
    """seed, key, columns: the table once a seed, with that seed's member canaries."""
    rows = df.select(F.explode(F.array(*[F.lit(int(s)) for s in seeds])).alias("seed"), key, *columns)
    return rows.unionByName(canaries.where("included").select("seed", (-1 - F.col("canary_id")).alias(key), *columns))


def outcomes(canaries: DataFrame, release: DataFrame, schema: PublicSchema) -> DataFrame:
    """seed, level, share, canary_id, included, correct: whether the guess was
    right. The better half of a level's scores is guessed in, the rest out."""
    scores = cells.similarity(canaries, release, schema, ["seed"], "canary_id").join(canaries.select("seed", "canary_id", "level", "share", "included"), ["seed", "canary_id"])
    group = Window.partitionBy(*GROUP)
    rank = F.row_number().over(group.orderBy(F.desc(F.round("score", 9)), "canary_id"))
    said = rank <= F.floor(F.count("*").over(group) / 2)
    return scores.select(*GROUP, "share", "canary_id", "included", (said == F.col("included")).alias("correct"))


def audited(found: DataFrame, alpha: float = audit.ALPHA) -> DataFrame:
    """One row per seed and level: canaries, members, correct, accuracy, epsilon,
    ceiling, p_value, saturated, and the leakage gap of the seed (rarest level
    minus commonest; null with one level)."""
    one = F.lit(1).cast("long")
    counts = found.groupBy(*GROUP).agg(F.max("share").alias("share"), F.count("*").alias("canaries"), F.sum(F.when(F.col("included"), one).otherwise(0)).alias("members"), F.sum(F.when(F.col("correct"), one).otherwise(0)).alias("correct"))
    counts = materialized(counts, "counts")
    k, n = F.col("correct"), F.col("canaries")
    bounds = counts.select("*", (k / n).alias("accuracy"), distributions.epsilon_bound(k, n, alpha).alias("epsilon"), distributions.epsilon_ceiling(n, alpha).alias("ceiling"), distributions.binomial_tail(k, n, F.lit(0.5)).alias("p_value"))
    bounds = materialized(bounds.withColumn("saturated", (F.col("epsilon") > 0) & (F.col("epsilon") >= F.col("ceiling") - 1e-6)), "bounds")
    every = Window.partitionBy("seed")
    by_share = F.struct("share", "level")
    gap = F.min_by("epsilon", by_share).over(every) - F.max_by("epsilon", by_share).over(every)
    return bounds.withColumn("gap", F.when(F.count("*").over(every) > 1, gap))


def over_seeds(bounds: DataFrame) -> DataFrame:
    """One row a level: means and maxima over the seeds, and the mean gap."""
    return bounds.groupBy("level").agg(
        F.max("share").alias("share"), F.max("canaries").alias("canaries"), F.max("ceiling").alias("ceiling"), F.avg("epsilon").alias("mean_epsilon"), F.max("epsilon").alias("max_epsilon"),
        F.avg("accuracy").alias("mean_accuracy"), F.avg("p_value").alias("mean_p_value"), F.avg("gap").alias("mean_gap"),
    )


def detectable(groups: DataFrame, n: str = "canaries", alpha: float = audit.ALPHA) -> DataFrame:
    """groups with the fewest correct guesses of n that show anything, as the
    accuracy and the epsilon that they show (null where no count does)."""
    sizes = materialized(groups.select(n).distinct().select(n, F.explode(F.sequence(F.floor(F.col(n) / 2), F.col(n))).alias("k")), "sizes")
    shown = sizes.where(distributions.binomial_tail(F.col("k"), F.col(n), F.lit(0.5)) < alpha).groupBy(n).agg(F.min("k").alias("k"))
    shown = materialized(shown, "shown").select(n, (F.col("k") / F.col(n)).alias("detectable_accuracy"), distributions.epsilon_bound(F.col("k"), F.col(n), alpha).alias("detectable_epsilon"))
    return groups.join(shown, n, "left")


def verdict(found: DataFrame, alpha: float = audit.ALPHA, margin: float = MARGIN) -> DataFrame:
    """One row a level over all its seeds: the mean p-value adjusted over the
    levels, whether the guesses' accuracy is equivalent to a fair coin's within
    the margin, what the canaries could have shown at all, and the verdict.

    The coin's sample has as many guesses, half of them right. `supported`: leakage
    survives the false discovery rate; `equivalent`: it is bounded by the margin;
    `undetermined`: neither."""
    right = F.col("correct").cast("double")
    sample = found.groupBy("level").agg(F.count("*").alias("n"), F.avg(right).alias("mean"), F.coalesce(F.var_samp(right), F.lit(0.0)).alias("var"))
    sample = materialized(sample, "sample")
    n = F.col("n").cast("double")
    coin = F.when(F.col("n") > 1, 0.25 * n / (n - 1)).otherwise(0.0)
    tested = sample.select("level", (F.col("mean") - 0.5).alias("observed"), distributions.equivalence_p(F.col("n"), F.col("mean"), F.col("var"), F.col("n"), F.lit(0.5), coin, margin).alias("equivalence_p"))
    levels = detectable(over_seeds(audited(found, alpha)), alpha=alpha)
    adjusted = audit.corrected(levels, "mean_p_value", "level")
    told = adjusted.join(tested, "level")
    said = F.when(F.col("bh") < alpha, "supported").when(F.col("equivalence_p") < alpha, "equivalent").otherwise("undetermined")
    return told.withColumn("range_used", F.when(F.col("ceiling") > 0, F.col("max_epsilon") / F.col("ceiling")).otherwise(0.0)).withColumn("verdict", said)
