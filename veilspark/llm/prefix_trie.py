"""Trie of conversation prefixes with count-min screening of prefix digests.

A turn is reduced at once to a SHA-256 of role and text and the text's code
points; texts never travel. The digest of a prefix is the running sum of four
32-bit halves of hashes of (turn digest, depth), so a conversation of any length
is summed in blocks of BLOCK turns, which are then shifted by the blocks before.

The blocks are dealt into parts. Each part enters the prefix digests of its
turns into a count-min sketch (`count_min`). An estimate of one proves that no
other conversation has the prefix: from there on the conversation is a tail, and
its nodes are emitted where they lie. Only prefixes with an estimate of two or
more are grouped exactly (they may still be single; that only costs a row).

Sums over subtrees need no walk: every node stands at its smallest member, whose
path it lies on, so the sum over a node's subtree is the sum, over its members,
of what stands on their paths from its depth on.

Edge cases: rows with a null conv_id are left out; null role or text is empty; a
null turn comes first; rows of one conversation with equal turns go by the
SHA-256 of role and text, and equal rows stay separate turns; very long texts are
hashed in place; a table without rows has no node, not even a root; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, positions
from .count_min import DEPTH, SKETCH, answers_of, counters, merge_shard, repeated, sketch

#: Turns summed together, turns of a part, and counters of a shard at most and for each turn.
BLOCK, PART_TURNS = 1024, 1 << 18
SHARD_CELLS, PER_TURN = 1 << 26, 4
#: Bytes of ids that are joined before they are hashed.
RUN_BYTES = 1 << 20

NODE = ["depth", "k1", "k2"]
_HALVES = ["s0", "s1", "s2", "s3"]
_LOW = (1 << 32) - 1


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 0), total, turn_digest, chars of every turn."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(framed, 256)).alias("turn_digest"), F.char_length(text).cast("long").alias("chars")
    )
    return positions(rows, ["conv_id"], ["turn", "turn_digest"], "turns").drop("turn")


def spliced(rows: DataFrame, head: Column, base: Column, longest: int) -> tuple[DataFrame, DataFrame]:
    """Turn rows and conversations after the first `head` turns (at most
    `longest`, an expression of conv_id) of each conversation were replaced by
    those of the conversation `base`, as many as it has."""
    convs = rows.where("position = 0").select("conv_id", "total", head.cast("long").alias("head"), base.cast("long").alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    convs = convs.join(lengths, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_total", F.lit(0))))
    convs = materialize(convs.select("conv_id", "total", "head", "base", "taken"), "convs")
    first = rows.where(F.col("position") < longest).select(F.col("conv_id").alias("base"), "position", "turn_digest", "chars")
    lent = convs.join(first, "base").where("position < head").select("conv_id", (F.col("position") + 1).alias("depth"), "turn_digest", "chars")
    own = rows.drop("total").join(convs, "conv_id").where("position >= head")
    own = own.select("conv_id", (F.col("position") - F.col("head") + F.col("taken") + 1).alias("depth"), "turn_digest", "chars")
    turns = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("total") - F.col("head"), F.lit(0))).alias("n_turns"))
    return lent.unionByName(own), turns


def whole(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn rows and conversations as they are."""
    turns = rows.select("conv_id", (F.col("position") + 1).alias("depth"), "turn_digest", "chars")
    return turns, rows.where("position = 0").select("conv_id", F.col("total").alias("n_turns"))


def _block() -> Column:
    return F.floor((F.col("depth") - 1) / BLOCK)


def _shifts(rows: DataFrame, values: list[str]) -> DataFrame:
    """What the blocks of a conversation before each later block add to `values`."""
    sums = rows.groupBy("conv_id", _block().alias("block")).agg(*[F.sum(v).alias(v) for v in values])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("conv_id", "block", *[F.sum(v).over(before).alias(f"b_{v}") for v in values]).where(F.col(f"b_{values[0]}").isNotNull())


def _digested(turns: DataFrame, parts: int, tasks: int) -> DataFrame:
    """part, conv_id, depth, own prefix k1, k2, parent's p1, p2, chars, in parts by blocks."""
    one, two = F.xxhash64("turn_digest", "depth"), F.xxhash64("depth", "turn_digest")
    halves = [one.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(two, 32)]
    rows = turns.select("conv_id", "depth", "chars", *[h.alias(s) for h, s in zip(halves, _HALVES, strict=True)]).withColumn("block", _block())
    rows = rows.join(_shifts(rows, _HALVES), ["conv_id", "block"], "left")
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("conv_id", "block"), F.lit(parts))).repartition(tasks, "part")
    upto = Window.partitionBy("part", "conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.select("part", "conv_id", "depth", "chars", *_HALVES, *[(F.coalesce(f"b_{s}", F.lit(0)) + F.sum(s).over(upto)).alias(f"u_{s}") for s in _HALVES])
    now = [F.col(f"u_{s}") for s in _HALVES]
    past = [F.col(f"u_{s}") - F.col(s) for s in _HALVES]
    return sums.select("part", "conv_id", "depth", "chars", *_key(now, "k"), *_key(past, "p"))


def _key(sums: list[Column], name: str) -> list[Column]:
    return [F.xxhash64(*sums).alias(f"{name}1"), F.xxhash64(*reversed(sums), F.lit(1)).alias(f"{name}2")]


_SCREENED = "conv_id long, depth long, chars long, k1 long, k2 long, p1 long, p2 long, shared boolean, inner boolean"


def _screen(rows: pa.Table, answers: pa.Table, shards: int, cells: int) -> pa.Table:
    """Which rows may be shared; from the first single prefix of a block on none
    is. A tail row is inner if the row before it is known here to be of the tail."""
    rows = rows.drop_columns(["part"]).sort_by([("conv_id", "ascending"), ("depth", "ascending")])
    conv, depth = rows.column("conv_id").to_numpy(), rows.column("depth").to_numpy()
    single = ~repeated(rows.column("k1").to_numpy().view(np.uint64), answers_of(answers, cells), shards, cells)
    first = np.ones(len(conv), bool)
    first[1:] = (conv[1:] != conv[:-1]) | ((depth[1:] - 1) // BLOCK != (depth[:-1] - 1) // BLOCK)
    begin = np.flatnonzero(first)
    seen = np.cumsum(single)
    tail = seen > np.repeat(seen[begin] - single[begin], np.diff(np.append(begin, len(conv)))) if len(conv) else single
    inner = np.zeros(len(conv), bool)
    inner[1:] = tail[1:] & tail[:-1] & ~first[1:]
    return rows.append_column("shared", pa.array(~tail)).append_column("inner", pa.array(inner))


def screened(turns: DataFrame, parts: int | None = None, cells: int | None = None) -> DataFrame:
    """Every turn's prefix digests with the verdict of the sketch, written once."""
    turns = materialize(turns, "prefixes")
    n = turns.count()
    tasks = max(4 * turns.sparkSession.sparkContext.defaultParallelism, -(-n // PART_TURNS))
    parts = parts or tasks
    cells = cells or min(SHARD_CELLS, 1 << max(10, (PER_TURN * n).bit_length()))
    shards = 1 << max(0, (PER_TURN * n // cells).bit_length() - 1)
    dealt = _digested(turns, parts, tasks)

    def enter(rows: pa.Table) -> pa.Table:
        keys = rows.column("k1").to_numpy().view(np.uint64)
        return sketch(rows.column("part")[0].as_py(), [[counters(keys, row, shards, cells)] for row in range(DEPTH)], cells)

    answers = dealt.groupBy("part").applyInArrow(enter, SKETCH).groupBy("shard", "row").applyInArrow(lambda t: merge_shard(t, cells), SKETCH)
    rows = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(lambda r, a: _screen(r, a, shards, cells), _SCREENED)
    return materialize(rows, "screened")


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by node and conv_id: the ids of a node, joined in runs."""
    key, run, size, first = None, [], 0, 0
    for batch in batches:
        out = defaultdict(list)
        for *now, conv in zip(*(batch.column(c).to_pylist() for c in (*NODE, "conv_id")), strict=True):
            if now != key or size > RUN_BYTES:
                if run:
                    _add_run(out, key, first, run)
                key, run, size, first = now, [], 0, conv
            run.append(str(conv))
            size += len(run[-1]) + 1
        yield _runs(out)
    if run:
        out = defaultdict(list)
        _add_run(out, key, first, run)
        yield _runs(out)


def _add_run(out: dict, key: list, first: int, run: list[str]) -> None:
    for c, v in zip((*NODE, "first", "ids"), (*key, first, ",".join(run)), strict=True):
        out[c].append(v)


def _runs(out: dict) -> pa.RecordBatch:
    kinds = {**dict.fromkeys((*NODE, "first"), pa.int64()), "ids": pa.string()}
    return pa.RecordBatch.from_pydict({c: pa.array(out.get(c, []), kind) for c, kind in kinds.items()})


def _hash_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs sorted by node and first id: the SHA-256 of each node's ids, read run by run."""
    key, state = None, None
    kinds = {**dict.fromkeys(NODE, pa.int64()), "ends_sha256": pa.string()}

    def told(done: list) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 4
        return pa.RecordBatch.from_pydict({c: pa.array(v, kind) for (c, kind), v in zip(kinds.items(), columns, strict=True)})

    for batch in batches:
        done = []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        yield told(done)
    if key is not None:
        yield told([(*key, state.hexdigest())])


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 from rows of (depth, k1, k2, conv_id): ids in
    ascending order, joined by commas. Rows are dealt by ranges, so a node's ids
    lie in many tasks; then runs of about RUN_BYTES follow one another through
    the hash, which has no parallel form."""
    order = [*NODE, "conv_id"]
    runs = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_hash_runs, "depth long, k1 long, k2 long, first long, ids string")
    nodes = runs.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return nodes.mapInArrow(_hash_nodes, "depth long, k1 long, k2 long, ends_sha256 string")


def _path_sums(rows: DataFrame, values: list[str]) -> DataFrame:
    """rows with the sums of `values` over their conversation from their depth on."""
    sums = rows.groupBy("conv_id").agg(*[F.sum(v).alias(f"t_{v}") for v in values])
    rows = rows.withColumn("block", _block()).join(_shifts(rows, values), ["conv_id", "block"], "left").join(sums, "conv_id")
    past = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    rest = [(F.col(f"t_{v}") - F.coalesce(f"b_{v}", F.lit(0)) - F.coalesce(F.sum(v).over(past), F.lit(0))).alias(v) for v in values]
    return rows.select("conv_id", *NODE, *rest)


def nodes(turns: DataFrame, convs: DataFrame, **sketch) -> DataFrame:
    """The trie of turns (conv_id, depth, turn_digest, chars) and convs (conv_id,
    n_turns): node (k1, k2), conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256, one row a node."""
    rows = screened(turns, **sketch)
    convs = convs.select("conv_id", "n_turns")
    root = _key([F.lit(0).cast("long")] * 4, "k")
    shared = rows.where("shared").select("conv_id", *NODE, "p1", "p2", "chars")
    none = F.lit(None).cast("long")
    shared = shared.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *root, none.alias("p1"), none.alias("p2"), F.lit(0).cast("long").alias("chars")))
    tails = rows.where("not shared")

    # nodes that may be shared, one row each
    exact = materialize(shared.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "chars")]), "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    kids = exact.where("depth > 0").select(*up).unionAll(tails.where("not inner").select(*up)).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    exact = materialize(exact.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")

    # every leaf stands at one conversation; so does what a node saves
    ending = tails.join(convs, "conv_id").where("depth = n_turns").select("conv_id")
    leaves = ending.unionAll(exact.where("n_children = 0").select("conv_id")).withColumn("leaf", F.lit(1).cast("long"))
    saved = exact.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    zero = F.lit(0).cast("long")
    paths = shared.select("conv_id", *NODE).join(saved, ["conv_id", "depth"], "left").withColumn("saved", F.coalesce("saved", zero))
    below = _path_sums(paths, ["saved"]).join(leaves, "conv_id", "left")
    below = below.groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.sum(F.coalesce("leaf", zero)).alias("n_leaves"))
    ends = ends_digest(shared.join(convs, "conv_id").where("depth = n_turns").select(*NODE, "conv_id"))

    parents = exact.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    # a parent that is not among the shared nodes is of the same tail
    above = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    known = exact.join(parents, ["depth", "p1", "p2"], "left").join(below, NODE).join(ends, NODE, "left")
    known = known.select("k1", "k2", "conv_id", "depth", above, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
    last = F.col("depth") == F.col("n_turns")
    one = F.lit(1).cast("long")
    local = tails.where("inner").withColumn("parent", F.col("conv_id")).unionByName(tails.where("not inner").join(parents, ["depth", "p1", "p2"], "left"))
    local = local.join(convs, "conv_id").select(
        "k1", "k2", "conv_id", "depth", above, one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"),
    )
    return known.unionByName(local)


def prefix_trie(conversations: DataFrame, **sketch) -> DataFrame:
    """The trie of the table's conversations (conv_id, turn, role, text) as they are."""
    return nodes(*whole(turn_rows(conversations)), **sketch)


def with_turns(trie: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of `prefix_trie` (the root left out) with role and text of their last turn."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.unhex("digest"))
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.sha2(framed, 256).alias("digest"))
    return trie.join(turns.select("conv_id", F.row_number().over(order).cast("long").alias("depth"), "role", "text"), ["conv_id", "depth"])


def trie_digest(conversations: DataFrame, **sketch) -> DataFrame:
    """The trie of conversations whose first turns, crc32(conv_id) % 6 of them,
    are replaced by those of the conversation at the head of their hundred."""
    conv = F.col("conv_id")
    parts = spliced(turn_rows(conversations), F.crc32(conv.cast("string").cast("binary")) % 6, conv - conv % 100, 5)
    return nodes(*parts, **sketch).drop("k1", "k2")


def brute_force(rows: list[tuple], splice: bool = True) -> set[tuple]:
    """Plain reference for tests: the nodes' rows from (conv_id, turn, role, text)."""
    import zlib

    told: dict = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told[conv].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    plain = {c: [t[-1] for t in sorted(ts)] for c, ts in told.items()}
    built = {}
    for c, ts in plain.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        built[c] = tuple((plain.get(base, [])[:h] + ts[h:]) if splice else ts)
    parent, chars, depth, members, ends, known = [None], [0], [0], [[]], [[]], {}
    for c in sorted(built):
        at = 0
        members[at].append(c)
        for turn in built[c]:
            if (at, turn) not in known:
                known[at, turn] = len(parent)
                for column, v in zip((parent, chars, depth, members, ends), (at, len(turn[1]), depth[at] + 1, [], []), strict=True):
                    column.append(v)
            at = known[at, turn]
            members[at].append(c)
        ends[at].append(c)
    kids = Counter(parent)
    leaves = [int(not kids[i]) for i in range(len(parent))]
    saved = [(len(m) - 1) * n for m, n in zip(members, chars, strict=True)]
    for i in range(len(parent) - 1, 0, -1):  # children come after their parents
        leaves[parent[i]] += leaves[i]
        saved[parent[i]] += saved[i]
    told = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() for e in ends]
    above = [None if p is None else members[p][0] for p in parent]
    return set(zip([m[0] for m in members], depth, above, map(len, members), [kids[i] for i in range(len(parent))], leaves, saved, told, strict=True)) if built else set()
