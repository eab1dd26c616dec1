"""Near-duplicate detection by Order MinHash with banded alignment.

A document's SHINGLE-word sequences are labelled with their occurrence number.
For each of TABLES hash orders the SAMPLE smallest labelled sequences are taken
and put back into text order; the ordered tuple is a bucket key, so that documents
meet if they share sequences in the same order (sensitive to edit similarity,
not only to common content). Candidates are confirmed by a banded alignment of
their words: a link needs 1 - edits / longer length >= SIMILARITY.

Of n words a share s of which is unedited, about s ** 5 of the sequences survive
scattered edits, a Jaccard similarity J = s ** 5 / (2 - s ** 5), and a pair meets in
a table with probability of about J ** SAMPLE: over 80 tables 0.95 at an edit
similarity of 0.8, 0.998 at 0.85, over 0.9999 at 0.9 (README: measured shares). Two
documents of at most SHORT words always meet: within SIMILARITY they share a run of
unedited words (of 2 words for 5, 3 for up to 15, else 4), and all their runs are keys.

Documents with equal words are one class from the start; only its smallest id is
sketched and compared. Each member of a bucket is aligned with the bucket's smallest
id, its head: first with the smallest of its heads, then with those of other
components. Pairs whose lengths or bags of words show more edits than a link may have
are never aligned, and their texts never travel: a lower bound of the edits, so no link
is lost. After that only pairs of members in different components are left:
* in buckets of at most SMALL members all of them are aligned;
* members of larger buckets go through an exact similarity join. Two texts within
  SIMILARITY share so many of their neighbouring word pairs, and of their words, that
  one of the rarest pairs and one of the rarest words of each (its prefixes) must be
  in common; a passage that many documents share is not rare, so it brings nothing
  together. Where at most SMALL members share a rare pair they meet; those of larger
  buckets meet where they share a rare word, and if many do, in salted blocks. Lengths and
  bags of words rule out most pairs exactly; a pair that shares several such words is
  named at the first of them only; and of one member's pairs with one component SMALL
  are aligned first, many times as many a round while any are left.
So thousands of near copies cost one alignment each, a frequent passage costs its
documents' prefixes, and no pair that shares a bucket is left out.

Edge cases: documents without words are classes of their own; those of fewer than K
words only match equal ones; a null text has no words; a null id has a null class.
Rows with one id and different texts are documents of their own, rows with equal id
and text are one. A very long text is sketched MOST_VALUES values at a time. Ties go
to the smaller id. Only doc_id and text are read, so other columns cannot clash; an
empty table has no classes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Powers, fresh, given_back, materialize, mix64, range_hashes, slices, small_batches, text_buffer, window_starts, words
from .components import components, with_links

#: Fewest words of a document that is compared, and words of a sketched sequence.
K = SHINGLE = 5
SAMPLE = 2
TABLES = 80
#: Two documents of at most so many words always meet.
SHORT = 120
SIMILARITY = 0.8
SMALL = 16
#: Members of a block of a large bucket; bins of a document's bag of words.
BLOCK = 2048
BINS = 512
#: Smallest crowded keys that a member carries, so that a pair is named at its first one.
FIRST = 64
#: Values hashed at a time for one document; more tables wait for the next pass.
MOST_VALUES = 1 << 21
#: Bits of the filter that keeps other texts out of a shuffle (more texts: a weaker
#: filter, equal results), and counters of the frequencies of word pairs and of words.
FILTER_BITS, COUNTERS = 1 << 25, 1 << 20

_SHINGLE, _RUN = Powers(0xE7037ED1A0B428DB), Powers(0x8EBC6AF09C88C6E3)
_SEEDS = mix64(np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_ODD = mix64(_SEEDS) | np.uint64(1)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _occurrences(values: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    count = np.empty(len(values), np.int64)
    count[order] = np.arange(len(values)) - np.repeat(heads, np.diff(np.append(heads, len(values))))
    return count


def order_keys(shingles: np.ndarray) -> np.ndarray:
    """The TABLES bucket keys of a document's sequence hashes in text order."""
    if len(shingles) == 0:
        return np.zeros(0, np.int64)
    labels = mix64(shingles + _occurrences(shingles).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    take, keys = min(SAMPLE, len(labels)), []
    step = max(1, MOST_VALUES // len(labels))
    for t in range(0, TABLES, step):
        seeds, odd = _SEEDS[t : t + step, None], _ODD[t : t + step, None]
        mixed = (labels[None, :] ^ seeds) * odd
        mixed ^= mixed >> np.uint64(32)
        at, every = np.empty((len(seeds), take), np.int64), np.arange(len(seeds))
        for k in range(take):
            at[:, k] = mixed.argmin(axis=1)
            mixed[every, at[:, k]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        chosen = shingles[np.sort(at, axis=1)]
        key = seeds[:, 0].copy()
        for k in range(take):
            key = mix64(key * np.uint64(0x5851F42D4C957F2D) + chosen[:, k])
        keys.append(key)
    return np.concatenate(keys).view(np.int64)


def run_keys(hashes: np.ndarray) -> np.ndarray:
    """Keys of the runs of neighbouring words of a short document."""
    n, keys = len(hashes), []
    for size, fits in ((2, n == 5), (3, 5 <= n <= 15), (4, 13 <= n <= SHORT)):
        if fits:
            at = np.arange(n - size + 1)
            keys.append(mix64(range_hashes(hashes, at, at + size, _RUN) ^ (_PAIR + np.uint64(size))).view(np.int64))
    return np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            data, offsets = text_buffer(part.column("text"))
            hashes, first = words(data, offsets)
            at, counts = window_starts(first, SHINGLE)
            shingles = range_hashes(hashes, at, at + SHINGLE, _SHINGLE)
            stops = np.cumsum(counts)
            digests, keys = [], []
            for i in range(part.num_rows):
                own = hashes[first[i] : first[i + 1]]
                digests.append(hashlib.sha256(b" ".join(data[offsets[i] : offsets[i + 1]].tobytes().split())).digest()[:16] if len(own) else None)
                # nothing within SIMILARITY of so short a document is longer than SHORT
                long = len(own) > SIMILARITY * SHORT
                keys.append(np.concatenate([order_keys(shingles[stops[i] - counts[i] : stops[i]] if long else shingles[:0]), run_keys(own)]))
            yield pa.RecordBatch.from_pydict(
                {
                    "node": part.column("node"),
                    "digest": pa.array(digests, pa.binary()),
                    "n": pa.array(np.diff(first), pa.int64()),
                    "keys": pa.array(keys, pa.list_(pa.int64())),
                }
            )


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Word edits between a and b if at most `most`, else most + 1. Bit-parallel
    columns of the alignment matrix, cut to the band of `most` diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    same = min(len(a), len(b))
    head = np.flatnonzero(a != b[: len(a)])
    start = int(head[0]) if len(head) else same
    a, b = a[start:], b[start:]
    if len(a):
        tail = np.flatnonzero(a[::-1] != b[::-1][: len(a)])
        stop = int(tail[0]) if len(tail) else len(a)
        a, b = a[: len(a) - stop], b[: len(b) - stop]
    if len(a) == 0:
        return len(b) if len(b) <= most else most + 1
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    m, n, step = len(a), len(b), max(64, most)
    lo, hi = 0, min(m, step + most)
    plus, minus, score = (1 << hi) - 1, 0, hi  # vertical differences of rows lo..hi; score is the value of row hi
    text = b.tolist()
    for j in range(0, n, step):
        down, reach = max(0, j - most), min(m, j + step + most)
        plus, minus = plus >> (down - lo), minus >> (down - lo)
        plus |= ((1 << (reach - hi)) - 1) << (hi - down)
        score += reach - hi
        lo, hi = down, reach
        width = hi - lo
        if width <= 0:
            return most + 1
        mask, top = (1 << width) - 1, 1 << (width - 1)
        for w in text[j : j + step]:
            equal = (where.get(w, 0) >> lo) & mask
            vertical = equal | minus
            across = (((equal & plus) + plus) ^ plus) | equal
            right = minus | (~(across | plus) & mask)
            wrong = plus & across
            if right & top:
                score += 1
            elif wrong & top:
                score -= 1
            right = (right << 1 | 1) & mask
            wrong = (wrong << 1) & mask
            plus = wrong | (~(vertical | right) & mask)
            minus = right & vertical
        if hi == m and score - max(0, n - j - step) > most:
            return most + 1
    return min(score, most + 1)


def allowed_edits(longer: int) -> int:
    return int((1 - SIMILARITY) * longer + 1e-9)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for x, y in zip(batch.column("ta"), batch.column("tb"), strict=True):
            numbers: dict[bytes, int] = {}
            one, two = (np.array([numbers.setdefault(w, len(numbers)) for w in t.as_py().encode().split()], np.int64) for t in (x, y))
            most = allowed_edits(max(len(one), len(two)))
            good.append(banded_distance(one, two, most) <= most)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "good"])


def _probes(nodes: np.ndarray) -> list[np.ndarray]:
    return [(mix64(nodes.view(np.uint64) + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(FILTER_BITS - 1)).astype(np.int64) for k in (1, 2, 3)]


def _filter_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    for batch in batches:
        for at in _probes(batch.column("node").to_numpy().astype(np.int64)):
            np.bitwise_or.at(table, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at].view(np.int64))], ["word", "bits"])


def some_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """docs (node, text) without most of those that are not in nodes: a Bloom filter
    of FILTER_BITS, whatever the number of nodes, stands before the shuffle."""
    found = nodes.select("node").distinct().mapInArrow(lambda it: given_back(_filter_words(it)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be(node: pd.Series) -> pd.Series:
        ok = np.ones(len(node), bool)
        for at in _probes(node.to_numpy(np.int64)):
            ok &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
        return pd.Series(ok)

    return docs.where(may_be("node"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose documents (node, text) align."""
    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    # small files are read many at a time: few tasks of Python, however many dealt the joins
    both = materialize(both.select("a", "b", "ta", "tb"), "aligned")
    checked = both.mapInArrow(lambda it: given_back(_align(it)), "a long, b long, good boolean")
    return materialize(checked.where("good").select("a", "b"), "verified")


def _fitting(na: Column, nb: Column) -> Column:
    return F.abs(na - nb) <= F.floor(F.lit(1 - SIMILARITY) * F.greatest(na, nb) + 1e-9)


def _word_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, n and the sorted 16-bit word hashes of each text."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = words(*text_buffer(part.column("text")))
            low = hashes.astype(np.uint16)
            bags = [np.sort(low[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(first)), pa.array(bags, pa.binary())], ["node", "n", "bag"])


def bag_edits(one: list[bytes], two: list[bytes]) -> np.ndarray:
    """For each pair of bags of 16-bit word hashes a lower bound of the word edits
    between the texts: an edit takes at most one word away and brings at most one."""
    codes = []
    for side, bags in enumerate((one, two)):
        rows = np.repeat(np.arange(len(bags), dtype=np.uint64), [len(b) // 2 for b in bags])
        codes.append((rows << np.uint64(16) | np.frombuffer(b"".join(bags), np.uint16)) << np.uint64(1) | np.uint64(side))
    ordered = np.sort(np.concatenate(codes))
    if len(ordered) == 0:
        return np.zeros(len(one), np.int64)
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] >> np.uint64(1) != ordered[:-1] >> np.uint64(1)]))
    more = np.add.reduceat(np.where(ordered & np.uint64(1), 1, -1), heads)
    row = (ordered[heads] >> np.uint64(17)).astype(np.int64)
    gone, come = (np.bincount(row, np.maximum(x, 0), len(one)) for x in (-more, more))
    return np.maximum(gone, come).astype(np.int64)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "ba"):
            allowed = [allowed_edits(n) for n in np.maximum(part.column("na").to_numpy(), part.column("nb").to_numpy()).tolist()]
            ok = bag_edits(part.column("ba").to_pylist(), part.column("bb").to_pylist()) <= np.array(allowed)
            yield part.select(["a", "b"]).filter(pa.array(ok))


def _new(pairs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), each once, without those seen before."""
    each = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(each if seen is None else each.join(seen, ["a", "b"], "left_anti"), "seen")


def _close(each: DataFrame, bags: DataFrame) -> DataFrame:
    """The pairs (a, b) whose lengths and bags of words allow a link."""
    by_a, by_b = (bags.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("bag").alias("b" + c)) for c in "ab")
    both = each.join(by_b, "b").join(by_a, "a").where(_fitting(F.col("na"), F.col("nb")))
    both = materialize(both.select("a", "b", "na", "nb", "ba", "bb"), "compared")
    return both.mapInArrow(lambda it: given_back(_alike(it)), "a long, b long")


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _small_pairs(named: DataFrame) -> DataFrame:
    """(a, b) of different labels and fitting lengths in buckets (key, node, n, label) of at most SMALL members."""
    mixed = named.groupBy("key").agg(F.collect_list(F.struct("node", "label", "n")).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")

    def partners(x: Column, i: Column) -> Column:
        found = F.filter(F.slice("m", i + 2, F.size("m")), lambda y: (y["label"] != x["label"]) & _fitting(x["n"], y["n"]))
        return F.transform(found, lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))

    return mixed.select(F.explode(F.flatten(F.transform("m", partners))).alias("p")).select("p.*")


# ------------------------------------------------------------ exact join of crowded buckets


def labelled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Labelled hashes of a document's runs of `size` words."""
    at = np.arange(max(0, len(hashes) - size + 1))
    found = range_hashes(hashes, at, at + size, _RUN)
    return mix64(found + _occurrences(found).astype(np.uint64) * _GOLDEN) if len(found) else found


def prefix_size(n: int, size: int) -> int:
    """Of the runs of `size` words of a document of n words, in any order common to
    all documents, the first so many include one of every document within SIMILARITY:
    an edit breaks `size` of them, so with m words in the longer document at least
    m - size + 1 - size * allowed_edits(m) are shared."""
    shared = min(m - size + 1 - size * allowed_edits(m) for m in (n, -(-n // 5) * 5))
    return n - size + 1 - shared + 1


def _cells(runs: np.ndarray, size: int) -> np.ndarray:
    return (runs & np.uint64(COUNTERS - 1)).astype(np.int64) + (size - 1) * COUNTERS


def _count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * COUNTERS, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = words(*text_buffer(part.column("text")))
            found = [_cells(labelled(hashes[a:b], size), size) for a, b in zip(first[:-1], first[1:], strict=True) for size in (1, 2)]
            cells, counts = np.unique(np.concatenate(found), return_counts=True)
            total[cells] += counts
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "c"])


def _prefixes(batches: Iterator[pa.RecordBatch], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, first = words(*text_buffer(part.column("text")))
            rare, bags = ([], []), []
            for a, b in zip(first[:-1], first[1:], strict=True):
                for size in (1, 2):
                    own = labelled(hashes[a:b], size)
                    rare[size - 1].append(own[np.lexsort((own, counts[_cells(own, size)]))[: prefix_size(int(b - a), size)]].view(np.int64))
                bags.append(np.minimum(np.bincount(hashes[a:b].view(np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes())
            lists = [pa.array(r, pa.list_(pa.int64())) for r in rare]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(np.diff(first)), *lists, pa.array(bags, pa.binary())], ["node", "n", "words", "pairs", "bag"])


def _apart(bags: np.ndarray, bag: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """A lower bound of the edits from binned bags of words and the lengths' difference."""
    shared = np.minimum(bags, bag).sum(1, dtype=np.int64)
    return (bags.sum(1, dtype=np.int64) + bag.sum(dtype=np.int64) - 2 * shared + np.abs(gap)) // 2


def _bags(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def _matches(group: pa.Table) -> pa.Table:
    """Pairs (a, b, r) of a block of left members with a block of right ones, without
    those that lengths or bags of words rule out, that have one label, or that share a
    smaller one of their first keys and meet there. r counts the pairs of one left
    member with one right label, the most alike first."""
    left = group.column("left").to_numpy().astype(bool)
    node, n, label = (group.column(c).to_numpy() for c in ("node", "n", "label"))
    bag, main, most = _bags(group.column("bag")), group.column("main")[0].as_py(), group.column("most")[0].as_py()
    key, lists = group.column("key")[0].as_py(), group.column("first").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    smaller = np.full((len(node), FIRST), key)  # the key itself stands where there is no smaller one
    smaller[np.repeat(np.arange(len(node)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    right, out = np.flatnonzero(~left), []
    if not left.any():  # one block holds the whole bucket
        left = label != main
    for i in np.flatnonzero(left):
        allowed = np.floor((1 - SIMILARITY) * np.maximum(n[i], n[right]) + 1e-9)
        # two left members of a bucket meet once, from the larger id's side
        fits = (np.abs(n[right] - n[i]) <= allowed) & (label[right] != label[i]) & ((label[right] == main) | (node[right] < node[i]))
        at, allowed = right[fits], allowed[fits]
        if len(at) == 0:
            continue
        apart = _apart(bag[at], bag[i], n[at] - n[i])
        at, apart = at[apart <= allowed], apart[apart <= allowed]
        later = np.isin(smaller[at], smaller[i][smaller[i] < key]).any(axis=1)
        at, apart = at[~later], apart[~later]
        at = at[np.lexsort((node[at], apart, label[at]))]
        out += [(node[i], node[j], r) for j, r in zip(at.tolist(), _occurrences(label[at]).tolist() if len(at) else (), strict=True) if r <= most]
    columns = list(zip(*out, strict=True)) or [()] * 3
    return pa.table({c: pa.array(v, pa.int64()) for c, v in zip("abr", columns, strict=True)})


def both_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def crowded_prefixes(texts: DataFrame) -> DataFrame:
    """node, n, words and pairs (its rarest), bag of every text. Frequencies are
    counted by hash, so they order runs of words roughly; any order that is the same
    for all documents is right."""
    counted = texts.mapInArrow(lambda it: given_back(_count_runs(it)), "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(2 * COUNTERS, np.int64)
    counts[counted["cell"].to_numpy()] = counted["c"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    schema = "node long, n long, words array<long>, pairs array<long>, bag binary"
    return materialize(texts.mapInArrow(lambda it: given_back(_prefixes(it, shared.value)), schema), "prefixes")


def _shared(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, node, n) of keys whose members have several labels, with their number."""
    named = _named(rows, labels)
    per = named.groupBy("key").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    return materialize(named.join(per.select("key", "size"), "key").select("key", "node", "n", "size"), "rare")


def across(named: DataFrame, prints: DataFrame, most: int) -> DataFrame:
    """(a, b, r) of the pairs of different labels in each bucket (key, node, label),
    with r < most for the pairs to align and r = most where there are more. The members
    outside of a bucket's most frequent label meet all members, in blocks of BLOCK."""
    per = named.groupBy("key", "label").agg(F.count("*").alias("c")).groupBy("key")
    per = per.agg(F.max(F.struct("c", "label")).alias("m"), F.sum("c").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    per = per.select("key", F.col("m.label").alias("main"), F.ceil(F.col("s") / BLOCK).alias("rb"), F.ceil((F.col("s") - F.col("m.c")) / BLOCK).alias("lb"))
    mixed = named.join(per, "key").join(prints, "node")
    own_l, own_r = F.pmod(F.xxhash64("node"), "lb").cast("int"), F.pmod(F.xxhash64("node"), "rb").cast("int")
    kept = ["key", "main", "node", "n", "label", "bag", "first", F.lit(most).alias("most")]
    every_r, every_l = F.explode(F.expr("sequence(0, int(rb) - 1)")), F.explode(F.expr("sequence(0, int(lb) - 1)"))
    left = mixed.where("label <> main and lb * rb > 1").select(*kept, F.lit(True).alias("left"), own_l.alias("l"), every_r.alias("q"))
    both = left.unionByName(mixed.select(*kept, F.lit(False).alias("left"), every_l.alias("l"), own_r.alias("q")))
    return materialize(both.groupBy("key", "l", "q").applyInArrow(_matches, "a long, b long, r long"), "across")


# ------------------------------------------------------------ classes


def _numbered(docs: DataFrame, node: str) -> tuple[DataFrame, bool]:
    """The rows of docs that have an id, with a number of their text's own; True if
    ids repeat. It is the id where that occurs once."""
    known = docs.where("doc_id is not null")
    again = known.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("again"))
    if again.isEmpty():
        return known.withColumn(node, F.col("doc_id")), False
    marked = known.join(again.withColumnRenamed("again", node), "doc_id", "left")
    return marked.withColumn(node, F.when(F.col(node), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id"))), True


def _classes(docs: DataFrame) -> DataFrame:
    """node, label for every row of docs (node, text), whose nodes are distinct."""
    with small_batches(docs.sparkSession):
        return _compared(docs)


def _compared(docs: DataFrame) -> DataFrame:
    sketches = materialize(docs.mapInArrow(lambda it: given_back(_sketch(it)), "node long, digest binary, n long, keys array<long>"), "sketches")
    worded = sketches.where("digest is not null")
    classes = materialize(worded.groupBy("digest").agg(F.min("node").alias("node")), "classes")
    rows = worded.groupBy("digest").agg(F.min("node").alias("node"), F.first("n").cast("int").alias("n"), F.first("keys").alias("keys")).select(F.explode("keys").alias("key"), "node", "n")
    shared = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("least")).where("size > 1")
    members = materialize(rows.join(shared, "key").select("key", "node", "n", "size", F.col("least.node").alias("head"), F.col("least.n").alias("head_n")), "members")
    # one head a member links the most part of a large group; the other heads follow
    stars = members.where("node <> head").where(_fitting(F.col("n"), F.col("head_n"))).select("head", "node").distinct()
    first = stars.groupBy("node").agg(F.min("head").alias("head"))
    worn = some_texts(docs, members).mapInArrow(lambda it: given_back(_word_bags(it)), "node long, n long, bag binary")
    bags = materialize(worn, "bags")
    seen = _new(first.select(F.col("head").alias("a"), F.col("node").alias("b")))
    tried = materialize(_close(seen, bags), "pairs")
    labels = materialize(components(verified(tried, some_texts(docs, both_ends(tried)))), "labels")

    def linked(pairs: DataFrame, texts: DataFrame | None = None) -> None:
        nonlocal seen, labels
        unseen = _new(pairs, seen)
        seen = seen.union(unseen)
        new = materialize(_close(unseen, bags), "pairs")
        good = None if new.isEmpty() else verified(new, some_texts(docs, both_ends(new)) if texts is None else texts)
        if good is not None and not good.isEmpty():
            labels = with_links(labels, good)

    by_head = labels.select(F.col("node").alias("head"), F.col("label").alias("other"))
    apart = _named(stars, labels).join(by_head, "head", "left").where(F.coalesce("other", "head") != F.col("label"))
    linked(apart.select(F.col("head").alias("a"), F.col("node").alias("b")))
    linked(_small_pairs(_named(members.where(F.col("size") <= SMALL).select("key", "node", "n"), labels)))
    large = _named(members.where(F.col("size") > SMALL).select("key", "node"), labels)
    mixed = large.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    crowd = materialize(large.join(mixed, "key", "left_semi").select("node").distinct(), "crowd")
    if not crowd.isEmpty():
        texts = materialize(some_texts(docs, crowd).join(crowd, "node", "left_semi"), "crowd")
        prefixes = crowded_prefixes(texts)
        by_pair = _shared(prefixes.select(F.explode("pairs").alias("key"), "node", "n"), labels)
        dense = by_pair.where(F.col("size") > SMALL).select("node").distinct()
        by_word = _shared(prefixes.join(dense, "node", "left_semi").select(F.explode("words").alias("key"), "node", "n"), labels)
        few = by_pair.where(F.col("size") <= SMALL).unionByName(by_word.where(F.col("size") <= SMALL)).select("key", "node", "n")
        many = by_word.where(F.col("size") > SMALL).select("key", "node")
        own = many.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRST).alias("first"))
        prints = materialize(prefixes.select("node", "n", "bag").join(own, "node"), "prints")
        linked(_small_pairs(_named(few, labels)), texts)
        most = SMALL
        while not many.isEmpty():
            found = across(_named(many, labels), prints, most)
            linked(found.where(F.col("r") < most).select("a", "b"), texts)
            if found.where(F.col("r") == most).isEmpty():
                break
            most *= SMALL * SMALL
    named = _named(classes.select("digest", "node"), labels).select("digest", "label")
    return sketches.select("node", "digest").join(named, "digest", "left").select("node", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, repeated = _numbered(docs, "node")
    if repeated:
        rows = materialize(rows, "rows")
        ids = rows.select("node", "doc_id").distinct()
        found = _classes(rows.select("node", "text").dropDuplicates(["node"])).join(ids, "node")
        least = found.groupBy("label").agg(F.min("doc_id").alias("class_id"))
        classes = rows.select("doc_id", "node").join(found.select("node", "label"), "node").join(least, "label").select("doc_id", "class_id")
    else:
        classes = _classes(rows.select("node", "text")).select(F.col("node").alias("doc_id"), F.col("label").alias("class_id"))
    return classes.unionByName(docs.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id")))


def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each class, of the smallest id;
    rows without an id stay."""
    (node,) = fresh(docs, "node")
    plain = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows, repeated = _numbered(plain, node)
    if repeated:
        rows = materialize(rows.dropDuplicates([node]), "rows")
        ids = rows.select(F.col(node).alias("node"), "doc_id")
        found = _classes(rows.select(F.col(node).alias("node"), "text")).join(ids, "node")
        kept = found.groupBy("label").agg(F.min(F.struct("doc_id", "node"))["node"].alias(node)).select(node)
    else:
        found = _classes(rows.select(F.col(node).alias("node"), "text"))
        kept = found.where("node = label").select(F.col("node").alias(node))
    stay = rows.join(kept, node, "left_semi").drop(node)
    return stay.unionByName(plain.where("doc_id is null")).select(*[F.col(c).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def brute_force(rows: list[tuple]) -> dict:
    """Classes of (doc_id, text) from all pairs, for tests on small fixtures."""
    split = {d: (t or "").encode().split() for d, t in rows}
    ids = sorted(split)
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = split[a], split[b]
            if not x or not y or (x != y and min(len(x), len(y)) < K):
                continue
            most = allowed_edits(max(len(x), len(y)))
            if abs(len(x) - len(y)) > most:
                continue
            row = list(range(len(y) + 1))
            for p, w in enumerate(x, 1):
                above, row[0] = row[0], p
                for q, v in enumerate(y, 1):
                    above, row[q] = row[q], min(row[q] + 1, row[q - 1] + 1, above + (w != v))
            if row[-1] <= most:
                up[max(root(a), root(b))] = min(root(a), root(b))
    return {d: root(d) for d in ids}
