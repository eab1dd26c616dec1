"""Noisy counts of a stream per tumbling window (an extension: the batch
operators have no streaming counterpart).

A window is released once, after the watermark has passed it, so each event
counts in one release; every release is one Laplace query of sensitivity one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import seeded


def window_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n) per tumbling window; works on streams and tables alike."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    stream = events.withWatermark(time, late) if events.isStreaming else events
    return stream.groupBy(F.window(time, width).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def noisy_window_counts(events: DataFrame, scale: float, salt: str = "window", **options) -> DataFrame:
    """Window counts with replayable discrete Laplace noise, not below zero."""
    noise = seeded.discrete_laplace(scale, salt, F.date_format("start", "yyyyMMddHHmmss"), F.col("kind"))
    return window_counts(events, **options).select("start", "kind", F.greatest(F.lit(0).cast("bigint"), F.col("n") + noise).alias("n"))
