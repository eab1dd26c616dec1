"""Merkle manifest of a document table, with a proof for every row.

A leaf is the digest of a row. Per language the leaves ascend by doc_id; every
FANOUT consecutive nodes become one, level by level, until one is left: the
subroot. The subroots, ordered by language, become the root in the same way.

A block is an aligned run of FANOUT**LEVELS leaves of a language. Each block
hashes its own subtree. Then, round by round, blocks meet in aligned groups of at
most FANOUT, one from each sibling subtree (those whose place in their subtree is
the same), and swap the roots of these subtrees. All of them hash the common
parent, which is done once in each of them, and keep their siblings. So after
the last round every block has its upper proof, and nothing is sent down again.
Blocks of a subtree that ends early stand in for the places that it lacks. The
subroots swap among themselves in the same rounds.

Ranks come from a deal by ranges (`common.positions`), so a language with a third
of all rows is spread over many tasks; a block's leaves are bounded, and so is a
group of the exchange.

Edge cases: null fields are `-`; a null lang is a language of its own, first in
the order; a null doc_id comes first; rows of equal lang and doc_id go by their
leaf, and repeated rows are leaves of their own; a table without rows has no root;
very long texts are hashed in place, once; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, positions

FANOUT = 8
#: Levels of the subtree of one block, which has 4096 leaves at most.
LEVELS = 4

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(text: Column | None = None) -> Column:
    """Digest of a row of documents, with another text if one is given."""
    values = [F.col(c).cast("string") for c in FIELDS]
    if text is not None:
        values[-1] = text
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda now, step: F.sha2(F.concat(step["left"], now, step["right"]), 256))


def _hash(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _levels(leaves: list[str], most: int) -> list[list[str]]:
    """The levels of a tree, leaves first: `most` above them, or where `most` is 0 as many as it takes."""
    out = [leaves]
    while len(out) <= most if most else len(out[-1]) > 1:
        out.append([_hash(out[-1][i : i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def _siblings(level: list[str], i: int) -> tuple[str, str]:
    at = i - i % FANOUT
    return "".join(level[at:i]), "".join(level[i + 1 : at + FANOUT])


def _block_levels(rows: pa.Table) -> list[list[str]]:
    leaves = rows.column("leaf").take(pa.compute.sort_indices(rows.column("position")))
    return _levels(leaves.to_pylist(), LEVELS if rows.column("slots")[0].as_py() > 1 else 0)


def _block_root(rows: pa.Table) -> pa.Table:
    head = rows.select(["tree", "slot", "slots"]).slice(0, 1)
    return head.append_column("node", pa.array([_block_levels(rows)[-1][0]]))


def exchanged(state: DataFrame) -> DataFrame:
    """tree, slot, node (the tree's root), path (the siblings on the way) from
    tree, slot (from 0), slots (their number in the tree), node."""
    state = state.withColumn("path", F.expr(f"cast(array() as {PATH})"))
    most = state.agg(F.max("slots")).first()[0] or 0
    width = 1
    while width < most:
        child = F.floor(F.col("slot") / width)
        lane = F.col("slot") % width
        size = F.least(F.lit(width).cast("long"), F.col("slots") - child * width)
        # a subtree that ends early is also sent to the places it lacks, where it has siblings
        lanes = F.when((size < width) & (child % FANOUT > 0), F.sequence(lane, F.lit(width - 1).cast("long"), size)).otherwise(F.array(lane))
        sent = state.withColumn("child", child).withColumn("lane", lane).withColumn("to", F.explode(lanes))
        own = F.col("to") == F.col("lane")
        row = F.struct("child", "node", "slot", own.alias("own"), F.when(own, F.col("path")).alias("path"))
        met = sent.groupBy("tree", "slots", F.floor(F.col("child") / FANOUT).alias("parent"), "to").agg(F.array_sort(F.collect_list(row)).alias("met"))
        met = met.withColumn("nodes", F.col("met.node")).select("tree", "slots", "nodes", F.posexplode("met").alias("i", "m")).where("m.own")
        left = F.array_join(F.slice("nodes", F.lit(1), F.col("i")), "")
        right = F.array_join(F.slice("nodes", F.col("i") + 2, F.lit(FANOUT)), "")
        step = F.array(F.struct(left.alias("left"), right.alias("right")))
        going = F.col("slots") > width  # one node is left of the others
        state = met.select(
            "tree", "slots", F.col("m.slot").alias("slot"),
            F.when(going, F.sha2(F.array_join("nodes", ""), 256)).otherwise(F.col("m.node")).alias("node"),
            F.when(going, F.concat("m.path", step)).otherwise(F.col("m.path")).alias("path"),
        )
        width *= FANOUT
    return materialize(state.select("tree", "slot", "node", "path"), "exchange")


def _manifest(docs: DataFrame, emit: Callable, schema: str, **extra: Column) -> DataFrame:
    """The rows that emit makes of every block's leaves and its upper proof."""
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    leaves = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf_digest().alias("leaf"), *[v.alias(k) for k, v in extra.items()])
    block = FANOUT**LEVELS
    placed = positions(leaves, ["tree"], ["doc_id", "leaf"], "leaves")
    placed = placed.withColumn("slot", F.floor(F.col("position") / block)).withColumn("slots", F.ceil(F.col("total") / block)).drop("total")
    roots = placed.select("tree", "slot", "slots", "position", "leaf").groupBy("tree", "slot").applyInArrow(_block_root, "tree string, slot long, slots long, node string")
    blocks = exchanged(materialize(roots, "blocks"))

    subroots = positions(blocks.where("slot = 0").select("tree", "node"), [], ["tree"], "subroots")
    subroots = subroots.select(F.lit("").alias("over"), "tree", F.col("position").alias("slot"), F.col("total").alias("slots"), "node")
    tops = exchanged(subroots.select(F.col("over").alias("tree"), "slot", "slots", "node"))
    tops = tops.select("slot", F.col("node").alias("root"), F.col("path").alias("rest")).join(subroots.select("slot", "tree"), "slot").drop("slot")
    upper = blocks.withColumnRenamed("node", "subroot").join(tops, "tree").select("tree", "slot", "subroot", "root", F.concat("path", "rest").alias("path"))

    def told(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.take(pa.compute.sort_indices(rows.column("position")))
        levels = _block_levels(rows)
        above = [(s["left"], s["right"]) for s in upper.column("path")[0].as_py()]
        out = defaultdict(list)
        subroot, root = upper.column("subroot")[0].as_py(), upper.column("root")[0].as_py()
        for i, row in enumerate(rows.to_pylist()):
            steps = [_siblings(level, i // FANOUT**k) for k, level in enumerate(levels[:-1])] + above
            for k, v in emit(row, steps, subroot, root).items():
                out[k].append(v)
        return pa.Table.from_pydict(out, schema=kind)

    kind = pa.schema([(n, _KINDS[t]) for n, t in (c.strip().split(" ", 1) for c in schema.split(";"))])
    return placed.groupBy("tree", "slot").cogroup(upper.groupBy("tree", "slot")).applyInArrow(told, schema.replace(";", ","))


_KINDS = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), PATH: pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))}


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof of every row of documents; `proof` is
    the way from the leaf to the root, each step's siblings on either side."""

    def emit(row: dict, steps: list, subroot: str, root: str) -> dict:
        return {"doc_id": row["doc_id"], "leaf": row["leaf"], "subroot": subroot, "root": root, "proof": [{"left": a, "right": b} for a, b in steps]}

    return _manifest(docs, emit, f"doc_id long; leaf string; subroot string; root string; proof {PATH}")


def verified(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, verified for each row of documents: whether its leaf is in the
    manifest under its doc_id and leads to the manifest's root."""
    now = docs.select(F.col("doc_id").cast("long").alias("doc_id"), leaf_digest().alias("now"), F.monotonically_increasing_id().alias("row"))
    checks = now.join(told, "doc_id", "left").groupBy("row", "doc_id")
    return checks.agg(F.coalesce(F.max((F.col("now") == F.col("leaf")) & (folded(F.col("now"), F.col("proof")) == F.col("root"))), F.lit(False)).alias("verified")).drop("row")


def manifest_digest(docs: DataFrame) -> DataFrame:
    """Every row's leaf, subroot, root, the digest of its siblings, and the root
    that its leaf leads to after A-Z of the text were lower-cased in the rows
    where 3 divides crc32(doc_id)."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    now = F.when(tampered, leaf_digest(F.translate("text", UPPER, LOWER)))

    def emit(row: dict, steps: list, subroot: str, root: str) -> dict:
        found = row["now"] or row["leaf"]
        for left, right in steps:
            found = _hash([left, found, right])
        proof = _hash([x for step in steps for x in step])
        return {"doc_id": row["doc_id"], "leaf": row["leaf"], "subroot": subroot, "root": root, "proof_sha256": proof, "folded_root": found, "verified": found == root}

    columns = "doc_id long; leaf string; subroot string; root string; proof_sha256 string; folded_root string; verified boolean"
    return _manifest(docs, emit, columns, now=now)


def brute_force(rows: list[tuple]) -> list[tuple]:
    """Plain reference for tests: the digest's rows of (doc_id, text, lang, source, n_chars)."""

    def leaf(doc: int, text: str, lang: str, source: str, n: int) -> str:
        parts = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
        return _hash(["-" if p is None else f"{len(p.encode())}:{p}" for p in parts])

    trees: dict = defaultdict(list)
    for doc, text, lang, source, n in rows:
        low = text.translate(str.maketrans(UPPER, LOWER)) if text is not None else None
        now = leaf(doc, low if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text, lang, source, n)
        trees[lang].append((doc is not None, doc or 0, leaf(doc, text, lang, source, n), now, doc))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    local = {x: _levels([t[2] for t in sorted(trees[x])], 0) for x in langs}
    top = _levels([local[x][-1][0] for x in langs], 0)
    out = []
    for j, x in enumerate(langs):
        for i, (_, _, own, now, doc) in enumerate(sorted(trees[x])):
            steps = [_siblings(v, i // FANOUT**k) for k, v in enumerate(local[x][:-1])] + [_siblings(v, j // FANOUT**k) for k, v in enumerate(top[:-1])]
            found = now
            for left, right in steps:
                found = _hash([left, found, right])
            root = top[-1][0]
            out.append((doc, own, local[x][-1][0], root, _hash([v for s in steps for v in s]), found, found == root))
    return out
