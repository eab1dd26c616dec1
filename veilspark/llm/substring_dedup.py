"""Substring deduplication of word windows with a count-min prefilter.

Documents are dealt by id into parts of about PART_BYTES of text.

Pass 1 builds a count-min sketch of every part, whose counters stop at two. A
window is entered under its minimiser: the smallest hash of the GRAM-word
sequences inside it. Equal windows have equal minimisers, so the counter of a
window's minimiser never underestimates the number of documents with the window,
and neighbouring windows share one entry. The counters are dealt into shards of
fixed size by the hash of the entry; their number grows with the corpus, at
PER_ENTRY counters an entry. The sketches of all parts are merged shard by shard
(only counters above zero travel), and each part gets back which of its own
counters are two or more in the merged sketch. So no task holds more than one
shard, nothing is broadcast, and an entry that a third of the corpus shares
counts once a part.

Pass 2 sends only windows whose estimate is two or more to an exact grouping on
two independent 64-bit window hashes, which names the first document of each.
Every such window returns as one row to its first document only, so a passage that
a third of the corpus shares costs one row on the way back, whatever its count.

Pass 3 takes those rows to the parts and removes the words of candidate windows
that are not the document's own. All passes read the same exchange of the texts.

Edge cases: null or empty text has no words; fewer words than a window has no
window; rows with the same doc_id do not remove each other's words; a row with
a null doc_id neither removes nor loses words and takes no part in the exchange;
a very long text is a part of its own size; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, range_hashes, slices, text_buffer, window_starts, words
from .count_min import DEPTH, SKETCH, answers_of, counters, merge_shard, repeated, sketch

#: Words of the sequences whose smallest hash stands for a window.
GRAM = 6
#: Counters of one shard of a sketch row, and counters for each expected entry.
SHARD_CELLS, PER_ENTRY = 1 << 21, 4
#: Bytes of text of a part and of a task, which takes its parts one after another.
PART_BYTES, TASK_BYTES = 8 << 20, 64 << 20

_FIRST, _SECOND, _GRAM = Powers(0xD1342543DE82EF95), Powers(0xAF251AF3B0F025B5), Powers(0xDA942042E4DD58B5)


def _windows(column: pa.Array, size: int) -> tuple:
    """(word starts per text, window starts, windows per text, minimiser of each window, both word hashes)"""
    hashes, other, first = words(*text_buffer(column), twice=True)
    at, counts = window_starts(first, size)
    if len(at) == 0:
        return first, at, counts, np.zeros(0, np.uint64), hashes, other
    gram = min(GRAM, size)
    grams = np.arange(len(hashes) - gram + 1)
    least = range_hashes(hashes, grams, grams + gram, _GRAM)
    span, width = size - gram + 1, 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return first, at, counts, least[at], hashes, other


def _entries(least: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The minimiser of every run of windows of one text that share it, and the run of each window."""
    new = np.ones(len(least), bool)
    new[1:] = least[1:] != least[:-1]
    new[(np.cumsum(counts) - counts)[counts > 0]] = True
    return least[new], np.cumsum(new) - 1


def _exact_keys(hashes: np.ndarray, other: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    one, two = range_hashes(hashes, at, at + size, _FIRST), range_hashes(other, at, at + size, _SECOND)
    return one.view(np.int64), two.view(np.int64)


def _part_sketch(docs: pa.Table, size: int, shards: int, cells: int) -> pa.Table:
    part = docs.column("part")[0].as_py()
    found: list[list[np.ndarray]] = [[] for _ in range(DEPTH)]
    for batch in docs.to_batches():
        for piece in slices(batch, "text"):
            _, _, counts, least, _, _ = _windows(piece.column("text"), size)
            entries, _ = _entries(least, counts)
            for row in range(DEPTH):
                found[row].append(counters(entries, row, shards, cells))
    return sketch(part, found, cells)


def _repeated(least: np.ndarray, counts: np.ndarray, answers: list[np.ndarray], shards: int, cells: int) -> np.ndarray:
    """Which windows have an estimate of two or more."""
    entries, run = _entries(least, counts)
    return repeated(entries, answers, shards, cells)[run]


def _owned(one: np.ndarray, two: np.ndarray, ids: np.ndarray, firsts: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which keys belong to a window whose first document is the given one;
    firsts (first hash, second hash, doc_id) are sorted by the first hash."""
    own = np.zeros(len(one), bool)
    low, high = np.searchsorted(firsts[0], one, "left"), np.searchsorted(firsts[0], one, "right")
    for step in range(int((high - low).max(initial=0))):
        at = np.minimum(low + step, len(firsts[0]) - 1)
        own |= (low + step < high) & (firsts[1][at] == two) & (firsts[2][at] == ids)
    return own


_KEPT = "doc_id long, n_words long, n_removed long, kept_text string"


def _kept_rows(ids: pa.Array, texts: pa.Array, gone: list) -> pa.RecordBatch:
    """The result rows; gone[i] marks the removed words of text i (None: none)."""
    n_words, n_removed, kept = [], [], []
    for text, marks in zip(texts, gone, strict=True):
        tokens = (text.as_py() or "").encode().split()
        rest = tokens if marks is None else list(compress(tokens, ~marks))
        n_words.append(len(tokens))
        n_removed.append(len(tokens) - len(rest))
        kept.append(b" ".join(rest))
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": ids,
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def _kept_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            yield _kept_rows(piece.column("doc_id"), piece.column("text"), [None] * piece.num_rows)


def substring_dedup(docs: DataFrame, size: int = 13, cells: int = SHARD_CELLS, per_entry: float = PER_ENTRY) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    entries = total // 6 * 2 // 9 + 1  # about six bytes a word, a minimiser for 2 of 9 words
    shards = 1 << max(0, int(per_entry * entries / cells)).bit_length()
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    parts = max(tasks, -(-total // PART_BYTES))
    dealt = (
        docs.where("doc_id is not null")
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long").alias("part"), "doc_id", "text")
        .repartition(tasks, "part")
    )

    answers = (
        dealt.groupBy("part")
        .applyInArrow(lambda t: _part_sketch(t, size, shards, cells), SKETCH)
        .groupBy("shard", "row")
        .applyInArrow(lambda t: merge_shard(t, cells), SKETCH)
    )

    def candidates(docs: pa.Table, answers: pa.Table) -> pa.Table:
        known = answers_of(answers, cells)
        out = []
        for batch in docs.to_batches():
            for piece in slices(batch, "text"):
                _, at, counts, least, hashes, other = _windows(piece.column("text"), size)
                keep = _repeated(least, counts, known, shards, cells)
                one, two = _exact_keys(hashes, other, at[keep], size)
                ids = np.repeat(piece.column("doc_id").to_numpy(), counts)[keep]
                out.append(pa.RecordBatch.from_pydict({"h1": pa.array(one), "h2": pa.array(two), "doc_id": pa.array(ids)}))
        schema = pa.schema({"h1": pa.int64(), "h2": pa.int64(), "doc_id": pa.int64()})
        return pa.Table.from_batches(out, schema)

    firsts = (
        dealt.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(candidates, "h1 long, h2 long, doc_id long")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("doc_id"))
        .select(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("long").alias("part"), "h1", "h2", "doc_id")
    )

    def remove(docs: pa.Table, facts: pa.Table) -> pa.Table:
        known = answers_of(facts, cells)
        facts = facts.filter(pc.is_valid(facts.column("h1"))).sort_by("h1")
        firsts = tuple(facts.column(c).to_numpy() for c in ("h1", "h2", "doc_id"))
        out = []
        for batch in docs.to_batches():
            for piece in slices(batch, "text"):
                first, at, counts, least, hashes, other = _windows(piece.column("text"), size)
                gone = _repeated(least, counts, known, shards, cells)
                one, two = _exact_keys(hashes, other, at[gone], size)
                ids = np.repeat(piece.column("doc_id").to_numpy(), counts)
                gone[gone] = ~_owned(one, two, ids[gone], firsts)
                hits, n = at[gone], len(hashes) + 1
                covered = np.cumsum(np.bincount(hits, minlength=n) - np.bincount(hits + size, minlength=n)) > 0
                marks = [covered[first[i] : first[i + 1]] for i in range(piece.num_rows)]
                out.append(_kept_rows(piece.column("doc_id"), piece.column("text"), marks))
        return pa.Table.from_batches(out)

    facts = answers.unionByName(firsts, allowMissingColumns=True)
    kept = dealt.groupBy("part").cogroup(facts.groupBy("part")).applyInArrow(remove, _KEPT)
    return kept.unionByName(docs.where("doc_id is null").mapInArrow(_kept_whole, _KEPT))


def removal_digest(docs: DataFrame, size: int = 13, **sketch) -> DataFrame:
    """The operator's result with the kept text as its SHA-256."""
    return substring_dedup(docs, size, **sketch).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple], size: int = 13) -> dict:
    """Plain reference for tests: rows of (doc_id, text) with distinct ids."""
    split = {d: (t or "").encode().split() for d, t in rows}
    first: dict = {}
    for d in sorted(split):
        for i in range(len(split[d]) - size + 1):
            first.setdefault(tuple(split[d][i : i + size]), d)
    out = {}
    for d, tokens in split.items():
        gone = set()
        for i in range(len(tokens) - size + 1):
            if first[tuple(tokens[i : i + size])] < d:
                gone.update(range(i, i + size))
        kept = [w for i, w in enumerate(tokens) if i not in gone]
        out[d] = (len(tokens), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
