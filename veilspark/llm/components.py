"""Connected components of a link table by alternating large and small stars.

Before the first round each task contracts its own links, CHUNK at a time, to stars
around their smallest nodes, twice over: chains shrink without a shuffle. Every round is
two grouped minima and two joins; intermediate links go to the shared folder. Nothing is
gathered on the driver but whether a round has anything left to do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links contracted at a time in a task.
CHUNK = 1 << 19


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _least(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _stars(links: DataFrame) -> bool:
    """True if every node has one smaller end and no centre is an end: done."""
    ends = links.select(F.col("b").alias("u"), F.lit(1).alias("below"), F.lit(0).alias("centre"))
    ends = ends.union(links.select("a", F.lit(0), F.lit(1)))
    roles = ends.groupBy("u").agg(F.sum("below").alias("below"), F.max("centre").alias("centre"))
    return roles.where("below > 1 or below = 1 and centre = 1").isEmpty()


def stars_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest node, node) with the same components as the links (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(root[x], root[y]), np.minimum(root[x], root[y]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    ends = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[ends]], nodes[ends]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0

    def contracted() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(k).to_numpy() for h in held]) for k in range(2))
        return pa.RecordBatch.from_arrays([pa.array(v) for v in stars_of(a, b)], ["a", "b"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield contracted()
            held, rows = [], 0
    if rows:
        yield contracted()


def components(links: DataFrame) -> DataFrame:
    """node, label (its component's smallest node) for every node in links (a, b: long)."""
    links = links.where("a <> b").select("a", "b")
    # the second pass reads the first one's small files many at a time
    links = materialize(links.mapInArrow(_contract, "a long, b long"), "links")
    links = materialize(links.mapInArrow(_contract, "a long, b long").distinct(), "links")
    while not _stars(links):
        both = _both_ways(links)
        large = both.join(_least(both), "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        # small star: each node and its smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("l"))
        links = materialize(small.select("l.a", "l.b").where("a <> b").distinct(), "links")
    labels = links.groupBy("b").agg(F.min("a").alias("label")).withColumnRenamed("b", "node")
    return labels.union(links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after further links (a, b): only the links' components are
    searched anew, each old component standing as its label."""
    by_a, by_b = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    named = links.join(by_a, "a", "left").join(by_b, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    over = materialize(components(named), "labels")
    moved = labels.join(over.select(F.col("node").alias("label"), F.col("label").alias("now")), "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    added = over.join(labels.select("node"), "node", "left_anti")
    return materialize(moved.unionByName(added), "labels")
