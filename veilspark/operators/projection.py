"""A three-dimensional view of a release beside its source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeded
from ..plans.ranking import smallest

#: Points per cloud, clipping, the share that sets the span.
POINTS, CLIP, SPAN_SHARE = 700, 2.5, 0.98


def _standardised(df: DataFrame, columns: list[str], unit) -> DataFrame:
    return df.select("rid", *[((F.coalesce(F.col(c), F.lit(unit["m" + c])) - unit["m" + c]) / (unit["s" + c] or 1.0)).alias(c) for c in columns])


def project(real: DataFrame, clouds: dict[str, DataFrame], columns: list[str], key: str = "rid") -> dict[str, DataFrame]:
    """(rid, x, y, z) per cloud in the principal axes of the real table: columns
    standardised on it, axes turned so that their largest weight is positive, the
    98th percentile of |coordinate| scaled to 1, clipped, four decimals; an exact
    sample of at most POINTS rows each."""
    from pyspark.ml.feature import PCA, VectorAssembler

    if len(columns) < 3:
        raise ValueError("a projection takes three numeric columns")
    unit = real.agg(*[F.avg(c).alias("m" + c) for c in columns], *[F.stddev_pop(c).alias("s" + c) for c in columns]).first()
    assemble = VectorAssembler(inputCols=columns, outputCol="__v")
    base = _standardised(real.withColumnRenamed(key, "rid"), columns, unit)
    axes = PCA(k=3, inputCol="__v", outputCol="__p").fit(assemble.transform(base)).pc.toArray().copy()
    for k in range(3):
        if axes[abs(axes[:, k]).argmax(), k] < 0:
            axes[:, k] *= -1

    def coordinates(df: DataFrame) -> DataFrame:
        z = _standardised(df.withColumnRenamed(key, "rid"), columns, unit)
        return z.select("rid", *[sum((F.col(c) * float(axes[i, k]) for i, c in enumerate(columns)), F.lit(0.0)).alias(n) for k, n in enumerate("xyz")])

    span = coordinates(real).agg(F.expr(f"percentile(greatest(abs(x), abs(y), abs(z)), {SPAN_SHARE})")).first()[0] or 1.0
    out = {}
    for name, df in clouds.items():
        points = smallest(coordinates(df), seeded.key(f"cloud{name}", "rid"), "rid", POINTS)
        points = points.where("chosen").drop("chosen")
        out[name] = points.select("rid", *[F.round(F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), F.col(c) / span)), 4).alias(c) for c in "xyz"])
    return out
