"""SimHash near duplicates with pigeonring filtering.

A document's fingerprint has a bit wherever over half of its shingles' hashes
have it. Only different fingerprints are compared, each once.

Cut into SEGMENTS segments on a ring, two fingerprints at a distance of at most
`budget` have a segment from which every chain of l consecutive segments differs
in at most l * budget / SEGMENTS bits (pigeonring principle). A chain of two is
looked up by hashing: each fingerprint is stored under its two segments and asks
for them with all differences that the chain allows. What meets must stay within
the budgets of the longer chains before the whole distance is counted.

Each asker meets at most CROWD fingerprints of a key, so pairs grow with the
fingerprints, not with the square of a crowd. A pair that only meets in crowded
keys has both its ends in them; these fingerprints are looked up by chains of
three. Those still crowded, one cluster of very similar fingerprints, go another
exact way: two fingerprints at a distance of up to four have a common point at
distance two at most from each. Whatever names the same point lies within four,
so it is linked to the point's smallest fingerprint, without any pairs.

Edge cases: a null or empty text and one without words have fingerprint zero,
linked like any other; fewer words than a shingle are one shingle; a very long
text is hashed in runs of whole words; copies and rows of one doc_id with unlike
texts are judged by their own fingerprints; a null doc_id is never the smallest
of a component (a component of such rows only has a null component_id); an empty
table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SLICE_BYTES, SPACE, given_back, materialize, slices, text_buffer
from .components import components

SHINGLE, SEED, BITS, BUDGET = 4, 42, 64, 4
#: Widths of the segments on the ring.
SEGMENTS = (13, 13, 13, 13, 12)
#: Stored fingerprints of a key that its askers meet one by one.
CROWD = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _runs(data: np.ndarray) -> Iterator[np.ndarray]:
    """A text's bytes in runs of whole words, about SLICE_BYTES long; each but the
    first begins with the last SHINGLE - 1 words before it."""
    at, tail = 0, np.zeros(0, np.uint8)
    while at < len(data):
        end = at + SLICE_BYTES
        if end >= len(data):
            end = len(data)
        else:
            while not SPACE[data[end : end + 4096]].any() and end < len(data):
                end += 4096
            end = min(len(data), end + int(np.argmax(np.append(SPACE[data[end : end + 4096]], True))))
        run = np.concatenate([tail, data[at:end]])
        yield run
        kept = run.tobytes().split()[-(SHINGLE - 1) :]
        tail = np.frombuffer(b" ".join(kept) + b" ", np.uint8)
        at = end


def _shingles(data: np.ndarray, offsets: np.ndarray, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every shingle, and how many each text has. `whole`: fewer words
    than a shingle are one."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(n_words), np.int64)
    # words with one space after each
    lengths = ends - starts
    laid = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    joined[np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)] = _LOWER[data[inside]]
    raw = joined.tobytes()
    n = np.maximum(n_words - SHINGLE + 1, (n_words > 0) if whole else 0)
    at = np.repeat(first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    upto = np.minimum(at + SHINGLE, np.repeat(first[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    spans = zip(laid[at].tolist(), (laid[upto] + lengths[upto]).tolist(), strict=True)
    return np.fromiter((digest(raw[a:b], SEED) for a, b in spans), np.uint64, len(at)), n


def _votes(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each text and bit the number of hashes that have it."""
    out = np.zeros((len(n), BITS), np.int64)
    if len(hashes):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = np.flatnonzero(n)
        out[full] = np.add.reduceat(bits, (np.cumsum(n) - n)[full], axis=0, dtype=np.int32)
    return out


def _fingerprints(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    if len(offsets) == 2 and len(data) > 2 * SLICE_BYTES:
        votes, total = np.zeros((1, BITS), np.int64), np.zeros(1, np.int64)
        short = len(data[:SLICE_BYTES].tobytes().split(None, SHINGLE)) < SHINGLE and len(data.tobytes().split(None, SHINGLE)) < SHINGLE
        for run in [data] if short else _runs(data):
            hashes, n = _shingles(run, np.array([0, len(run)]), whole=short)
            votes, total = votes + _votes(hashes, n), total + n
    else:
        hashes, total = _shingles(data, offsets)
        votes = _votes(hashes, total)
    bits = (2 * votes > total[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "fp": pa.array(_fingerprints(piece.column("text")), pa.int64())})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda b: given_back(run(b)), "doc_id long, fp long")


def _turned(fp: Column, ring: int) -> Column:
    """fp with the bits from segment `ring` on first, around the ring."""
    at = sum(SEGMENTS[:ring])
    return fp if at == 0 else F.shiftrightunsigned(fp, at).bitwiseOR(F.shiftleft(fp, BITS - at))


def _span(ring: int, chain: int) -> int:
    return sum(SEGMENTS[(ring + k) % len(SEGMENTS)] for k in range(chain))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allowed(ring: int, chain: int, budget: int) -> list[int]:
    """All differences of a chain whose every beginning stays within its budget."""
    found = [0]
    at = 0
    for k in range(chain):
        width, most = SEGMENTS[(ring + k) % len(SEGMENTS)], (k + 1) * budget // len(SEGMENTS)
        grown = []
        for mask in found:
            for n in range(most - mask.bit_count() + 1):
                grown += [mask | sum(1 << (at + b) for b in bits) for bits in combinations(range(width), n)]
        found, at = grown, at + width
    return found


def _viable(budget: int) -> Column:
    """Whether fingerprints a and b keep to the budgets of all chains from their segment, then in whole."""
    kept = F.lit(False)
    differ = F.col("a").bitwiseXOR(F.col("b"))
    for ring in range(len(SEGMENTS)):
        turned = _turned(differ, ring)
        chains = F.col("ring") == ring
        for chain in range(2, len(SEGMENTS)):
            chains &= F.bit_count(turned.bitwiseAND(F.lit((1 << _span(ring, chain)) - 1))) <= chain * budget // len(SEGMENTS)
        kept |= chains
    return kept & (F.bit_count(differ) <= budget)


def _looked_up(fps: DataFrame, chain: int, budget: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by chains, and the fingerprints stored under crowded keys."""
    keys = [F.struct(F.lit(r).alias("ring"), _turned(F.col("fp"), r).bitwiseAND(F.lit((1 << _span(r, chain)) - 1)).alias("key")) for r in range(len(SEGMENTS))]
    stored = fps.select("fp", F.inline(F.array(*keys)))
    crowded = stored.groupBy("ring", "key").count().where(F.col("count") > crowd).select("ring", "key", F.lit(True).alias("crowded"))
    crowded = materialize(crowded, "crowded")
    # what is exploded is many times what Spark takes it for, so it is never broadcast
    held = stored.hint("merge").join(crowded.hint("merge"), ["ring", "key"], "left")
    differences = F.array(*[F.array(*[F.lit(_signed(m)).cast("long") for m in allowed(r, chain, budget)]) for r in range(len(SEGMENTS))])
    asked = stored.select(F.col("fp").alias("a"), "ring", "key", F.explode(F.get(differences, F.col("ring"))).alias("other"))
    asked = asked.select("a", "ring", F.col("key").bitwiseXOR(F.col("other")).alias("key"))
    single = held.where("crowded is null").select(F.col("fp").alias("b"), "ring", "key")
    met = single.hint("merge").join(asked.hint("merge"), ["ring", "key"]).where("a <> b")
    return met.where(_viable(budget)).select("a", "b"), held.where("crowded").select("fp").distinct()


def _by_points(fps: DataFrame, budget: int) -> DataFrame:
    """Links among fps by the points within half the budget of each."""
    masks = [0] + [sum(1 << b for b in bits) for n in range(1, budget // 2 + 1) for bits in combinations(range(BITS), n)]
    named = fps.select("fp", F.explode(F.lit(np.array([_signed(m) for m in masks], np.int64))).alias("mask"))
    least = F.min("fp").over(Window.partitionBy("point"))
    return named.select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("point")).select(least.alias("a"), F.col("fp").alias("b")).where("a <> b").distinct()


def links(fps: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that connect exactly what links of at most `budget` differing
    bits (an even number) connect, among different fingerprints fp."""
    found, left = _looked_up(fps, 2, budget, crowd)
    left = materialize(left, "crowd")
    if not left.isEmpty():
        more, left = _looked_up(left, 3, budget, crowd)
        left = materialize(left, "crowd")
        found = found.unionAll(more)
        if not left.isEmpty():
            found = found.unionAll(_by_points(left, budget))
    return found


def near_duplicates(docs: DataFrame, budget: int = BUDGET, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest
    doc_id that links of at most `budget` bits reach) for every row."""
    rows = materialize(fingerprints(docs), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "different")
    labels = components(links(fps.select("fp"), budget, crowd)).withColumnRenamed("node", "fp")
    fps = fps.hint("merge").join(labels.hint("merge"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = fps.groupBy("label").agg(F.min("least").alias("component_id"))
    told = fps.select("fp", "label").hint("merge").join(least.hint("merge"), "label").select("fp", "component_id")
    return rows.hint("merge").join(told.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple], budget: int = BUDGET) -> list[tuple]:
    """Plain reference for tests: rows of (doc_id, text)."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    told = []
    for doc, text in rows:
        tokens = (text or "").translate(table).encode().split()
        grams = [b" ".join(tokens[i : i + SHINGLE]) for i in range(max(len(tokens) - SHINGLE + 1, len(tokens) > 0))]
        votes = [sum(h >> b & 1 for h in map(lambda g: xxhash.xxh64_intdigest(g, SEED), grams)) for b in range(BITS)]
        told.append((doc, sum(1 << b for b in range(BITS) if 2 * votes[b] > len(grams))))
    todo, label = {fp for _, fp in told}, {}
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            at = edge.pop()
            group.add(at)
            near = {x for x in todo if (x ^ at).bit_count() <= budget}
            todo -= near
            edge += near
        ids = [d for d, fp in told if fp in group and d is not None]
        label |= dict.fromkeys(group, min(ids, default=None))
    return [(d, f"{fp:016x}", label[fp]) for d, fp in told]
