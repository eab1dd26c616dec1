"""Attacks on a release and their measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import NUMERICAL, PublicSchema
from ..sources.scratch import materialized
from .audit import nearest

#: Records of each kind that are attacked, radius floor, neighbours.
MOST_RECORDS, LEAST_RADIUS, NEIGHBOURS = 400, 1e-12, 5
#: One in PART of the different rows, in GROUPS groups, bounds the smallest distances.
PART, GROUPS = 16, 64
#: Width of the steps in which exponents of a log-sum-exp are added up.
STEP = 32


def head(df: DataFrame, key: str, rows: int = MOST_RECORDS) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(rows)


def roc_points(scores: DataFrame) -> DataFrame:
    """(score, tpr, fpr) per threshold, ties sharing one; scores: score, member."""
    at = scores.groupBy("score").agg(F.sum(F.col("member").cast("int")).alias("p"), F.sum((~F.col("member")).cast("int")).alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    every = Window.partitionBy()
    return at.select("score", (F.sum("p").over(down) / F.sum("p").over(every)).alias("tpr"), (F.sum("n").over(down) / F.sum("n").over(every)).alias("fpr"))


def auc(scores: DataFrame) -> DataFrame:
    """One row with the area under the curve, from tie-averaged ranks."""
    at = scores.groupBy("score").agg(F.sum(F.col("member").cast("int")).alias("p"), F.count("*").alias("c"))
    up = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = at.withColumn("rank", F.sum("c").over(up) - (F.col("c") - 1) / 2.0)
    one = ranked.agg(F.sum(F.col("rank") * F.col("p")).alias("ranks"), F.sum("p").alias("p"), F.sum(F.col("c") - F.col("p")).alias("n"))
    return one.select(((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("n"))).alias("auc"))


def advantage(points: DataFrame) -> DataFrame:
    return points.agg(F.greatest(F.lit(0.0), F.max(F.col("tpr") - F.col("fpr"))).alias("advantage"))


def tpr_at(points: DataFrame, fpr: float) -> DataFrame:
    """True positive rate at a false positive rate, between the last point not
    above it (the origin if none) and the first above it."""
    below = F.coalesce(F.max(F.when(F.col("fpr") <= fpr, F.struct("fpr", "tpr"))), F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    above = F.min(F.when(F.col("fpr") > fpr, F.struct("fpr", "tpr")))
    two = points.agg(below.alias("a"), above.alias("b"))
    slope = (F.lit(fpr) - F.col("a.fpr")) * (F.col("b.tpr") - F.col("a.tpr")) / (F.col("b.fpr") - F.col("a.fpr"))
    return two.select(F.lit(fpr).alias("at_fpr"), F.when(F.col("b").isNull(), F.col("a.tpr")).otherwise(F.col("a.tpr") + slope).alias("tpr"))


def labelled(members: DataFrame, others: DataFrame, columns: list[str], key: str) -> DataFrame:
    return members.select(key, *columns, F.lit(True).alias("member")).unionByName(others.select(key, *columns, F.lit(False).alias("member")))


def nearest_scores(release: DataFrame, targets: DataFrame, columns: list[str], key: str) -> DataFrame:
    """(key, member, score) of the distance attack: 1 / (1 + nearest distance)."""
    near = nearest(targets, release, columns, key)
    return targets.select(key, "member").join(near, key).select(key, "member", (1 / (1 + F.sqrt("d2"))).alias("score"))


def _standard(release: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    one = release.agg(*[F.avg(c).alias("m" + c) for c in columns], *[F.stddev_pop(c).alias("s" + c) for c in columns]).first()
    return {c: (one["m" + c], one["s" + c] or 1.0) for c in columns}


def _gap2(columns: list[str], unit: dict[str, tuple[float, float]]):
    return sum((((F.col(c) - F.col(f"__{c}")) / F.lit(unit[c][1])) ** 2 for c in columns), F.lit(0.0))


def _smallest_gaps(targets: DataFrame, rows: DataFrame, columns: list[str], unit, key: str, k: int) -> DataFrame:
    """key and the k smallest distances to rows, ascending. Any k rows bound a target's
    k-th distance: here one row each of k groups of a part of the rows, so tasks keep a
    minimum a target and group. All rows are then compared, and only distances within
    the bound, each with its number of rows, are sorted."""
    other = rows.select(*[F.col(c).alias(f"__{c}") for c in columns])
    asked = targets.select(key, *columns)
    d2, hashed = _gap2(columns, unit).alias("d2"), F.xxhash64(*[f"__{c}" for c in columns])
    some = other.withColumn("__h", hashed).where(F.pmod("__h", F.lit(PART)) == 0).withColumn("__g", F.pmod(F.floor(F.col("__h") / PART), F.lit(GROUPS)))
    least = some.join(F.broadcast(asked)).groupBy(key, "__g").agg(F.min(d2).alias("d2")).where("d2 is not null")
    ranked = least.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("d2"))).where(F.col("__r") == k)
    bounded = materialized(asked.join(ranked.select(key, F.col("d2").alias("__most")), key, "left"), "bounds")
    # without a bound there are few different rows
    within = F.col("d2").isNotNull() & (F.col("__most").isNull() | (F.col("d2") <= F.col("__most")))
    counted = other.join(F.broadcast(bounded)).select(key, "__most", d2).where(within).groupBy(key, "d2").agg(F.count("*").alias("__n"))
    along = Window.partitionBy(key).orderBy("d2").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.withColumn("__before", F.coalesce(F.sum("__n").over(along), F.lit(0))).where(F.col("__before") < k)
    copies = F.array_repeat(F.sqrt("d2"), F.least("__n", F.lit(k)).cast("int"))
    return first.groupBy(key).agg(F.slice(F.sort_array(F.flatten(F.collect_list(copies))), 1, k).alias("gaps"))


def domias_neighbours(release: DataFrame, reference: DataFrame, targets: DataFrame, columns: list[str], key: str, k: int = NEIGHBOURS) -> DataFrame:
    """(key, member, score): log ratio of k-nearest-neighbour densities of the
    release and of the reference, where a target's own reference row is left out."""
    unit, d = _standard(release, columns), len(columns)
    near = _smallest_gaps(targets, release, columns, unit, key, k).withColumnRenamed("gaps", "g1")
    far = _smallest_gaps(targets, reference, columns, unit, key, k + 1).withColumnRenamed("gaps", "g2")
    own = F.element_at("g2", 1) <= LEAST_RADIUS
    r1 = F.greatest(F.lit(LEAST_RADIUS), F.element_at("g1", -1))
    r2 = F.greatest(F.lit(LEAST_RADIUS), F.when(own, F.element_at("g2", -1)).otherwise(F.element_at("g2", F.least(F.lit(k), F.size("g2")))))
    return targets.select(key, "member").join(near, key).join(far, key).select(key, "member", (d * (F.log(r2) - F.log(r1))).alias("score"))


def scott_bandwidth(rows: int, columns: int) -> float:
    return 1.0 if rows < 2 else max(1e-3, rows ** (-1.0 / (columns + 4)))


def log_density(targets: DataFrame, rows: DataFrame, columns: list[str], unit, key: str, bandwidth: float, count: int) -> DataFrame:
    """key and log density of a Gaussian kernel estimate, in one pass over the
    pairs: exponents are summed within steps of STEP, where nothing under- or
    overflows, so partial sums merge in any order; the few steps of a target then
    meet at the largest."""
    other = rows.select(*[F.col(c).alias(f"__{c}") for c in columns])
    exponent = (-_gap2(columns, unit) / (2 * bandwidth**2)).alias("e")
    pairs = other.join(F.broadcast(targets.select(key, *columns))).select(key, exponent).withColumn("step", F.floor(F.col("e") / STEP))
    steps = pairs.groupBy(key, "step").agg(F.sum(F.exp(F.col("e") - F.col("step") * STEP)).alias("s"))
    top = F.max("step").over(Window.partitionBy(key))
    merged = steps.withColumn("top", top).groupBy(key).agg(F.max("top").alias("top"), F.sum(F.col("s") * F.exp((F.col("step") - F.col("top")) * STEP)).alias("s"))
    constant = math.log(count) + len(columns) * math.log(bandwidth * math.sqrt(2 * math.pi))
    return merged.select(key, (F.col("top") * STEP + F.log("s") - constant).alias("log_density"))


def domias_kernel(release: DataFrame, reference: DataFrame, targets: DataFrame, columns: list[str], key: str) -> DataFrame:
    unit, n, m = _standard(release, columns), release.count(), reference.count()
    width = scott_bandwidth(n, len(columns))
    one = log_density(targets, release, columns, unit, key, width, n).withColumnRenamed("log_density", "a")
    two = log_density(targets, reference, columns, unit, key, width, m).withColumnRenamed("log_density", "b")
    return targets.select(key, "member").join(one, key).join(two, key).select(key, "member", (F.col("a") - F.col("b")).alias("score"))


def exact_matches(release: DataFrame, targets: DataFrame, columns: list[str]) -> DataFrame:
    """One row: targets, unique_matches, risk. A target counts if exactly one
    release row equals it; equality is null-safe nowhere, as in SQL."""
    unique = release.groupBy(*columns).count().where("count = 1").select(*columns)
    hit = targets.join(unique, columns, "left_semi").agg(F.count("*").alias("unique_matches"))
    return targets.agg(F.count("*").alias("targets")).join(hit).select("targets", "unique_matches", (F.col("unique_matches") / F.greatest(F.lit(1), F.col("targets"))).alias("risk"))


def attribute_inference(release: DataFrame, targets: DataFrame, reference: DataFrame, schema: PublicSchema, target: str, seed: int = 0) -> dict[str, float]:
    """What a release tells about the attribute `target` of the targets: a random
    forest trained on the release, against the reference population's majority and
    a forest trained on that population, which never saw the release. Features are
    the declared columns that all three tables have, categories one-hot over the
    union of the three tables' values."""
    from .utility import forest_predictions, macro_f1, union_encoder

    for name, df in (("release", release), ("targets", targets), ("reference", reference)):
        if target not in df.columns:
            raise ValueError(f"no column {target!r} in the {name}")
    features = [c for c in schema.shared(release, targets, reference) if c != target]
    if not features:
        raise ValueError("no shared columns to infer from")
    numbers = [c for c in features if schema[c].kind == NUMERICAL]
    categories = [c for c in features if schema[c].kind != NUMERICAL]
    encoder = union_encoder([release, targets, reference], categories) if categories else None

    def scored(train: DataFrame) -> Row:
        said = forest_predictions(train, targets, numbers, target, trees=50, seed=seed, categories=categories, encoder=encoder)
        return macro_f1(said).first()

    counts = reference.groupBy(F.col(target).cast("string").alias("y")).agg(F.count("*").alias("n"))
    top = counts.agg(F.max_by("y", F.struct("n", "y")).alias("y"), F.count("*").alias("classes"), (F.max("n") / F.sum("n")).alias("share")).first()
    known = targets.agg(F.avg(F.col(target).cast("string").eqNullSafe(F.lit(top["y"])).cast("double")).alias("marginal"), F.count("*").alias("n")).first()
    attack, conditional = scored(release), scored(reference)["accuracy"]
    return {
        "attack": attack["accuracy"], "attack_macro_f1": attack["macro_f1"], "marginal": known["marginal"], "conditional": conditional,
        "over_marginal": attack["accuracy"] - known["marginal"], "over_conditional": attack["accuracy"] - conditional,
        "targets": known["n"], "classes": top["classes"], "majority_share": top["share"],
    }
