"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised (A-Z lower-cased, words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`
joined by single spaces). The automaton holds every window of WINDOW words of
every benchmark item (an item of fewer words is one window), each with a space
at both ends. One pass over a normalised text finds all occurrences; their
positions are mapped to word numbers and to code points of the original text.

The benchmark is a test set, not a corpus: its texts are gathered in groups of
at most GROUP_BYTES, one automaton a group, and each further group is a further
pass over the documents; nothing is cut off.

Edge cases: null or empty texts and items have no words; equal windows of
several items count for each of them; rows are never merged or dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, slices

WINDOW = 10
#: Bytes of item text in one automaton (about 60 bytes of memory for each of WINDOW times as many).
GROUP_BYTES = 1 << 20

#: Every byte to itself in lower case if it belongs to a word, else to a space.
_FOLD = bytes((b + 32 if 65 <= b <= 90 else b) if (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def word_list(text: str | None) -> list[bytes]:
    return [w for w in normal_words(text) if w]


def item_windows(text: str | None) -> set[bytes]:
    tokens = word_list(text)
    return {b" ".join(tokens[i : i + WINDOW]) for i in range(max(1, len(tokens) - WINDOW + 1))} if tokens else set()


def build_automaton(items: list[tuple]):
    """Automaton over the windows of (item_id, text); None if there are none."""
    import ahocorasick

    owners: dict[bytes, set] = {}
    for item, text in items:
        for window in item_windows(text):
            owners.setdefault(window, set()).add(item)
    if not owners:
        return None
    automaton = ahocorasick.Automaton()
    for window, own in owners.items():
        automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, tuple(own)))
    automaton.make_automaton()
    return automaton


def find(tokens: list[bytes], automaton) -> tuple[list[tuple[int, int]], set]:
    """Word intervals [first, last) of the hits, joined, and the items hit."""
    if not tokens or automaton is None:
        return [], set()
    line = f" {b' '.join(tokens).decode('latin-1')} "
    ends, runs, items = None, [], set()
    for last, (length, own) in automaton.iter(line):
        if ends is None:  # position of the space after each word
            ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        stop = int(np.searchsorted(ends, last)) + 1
        items.update(own)
        if runs and stop - length <= runs[-1][1]:
            runs[-1] = (min(runs[-1][0], stop - length), max(runs[-1][1], stop))
        else:
            runs.append((stop - length, stop))
    if len(runs) > 1:
        joined = []
        for a, b in sorted(runs):
            if joined and a <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(joined[-1][1], b))
            else:
                joined.append((a, b))
        runs = joined
    return runs, items


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code point spans of word intervals."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    starts = np.flatnonzero(folded & ~np.concatenate([[False], folded[:-1]]))
    stops = np.flatnonzero(folded & ~np.concatenate([folded[1:], [False]])) + 1
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[stops[b - 1]])) for a, b in runs]


def item_groups(benchmark: DataFrame) -> Iterator[list[tuple]]:
    group, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        group.append((r["item_id"], r["text"]))
        size += len(r["text"] or "")
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


_FOUND = "doc_id long, text string, n_words long, runs array<struct<a:long,b:long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text, n_words, n_hit, item_ids and spans (code points) for every row of docs."""
    spark = docs.sparkSession
    run_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def scan(group, first: bool):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for batch in batches:
                n_words, all_runs, all_items = [], [], []
                for i, value in enumerate(batch.column("text")):
                    tokens = word_list(value.as_py())
                    runs, items = find(tokens, automaton)
                    items = {str(x) for x in items if x is not None}
                    if not first:
                        runs += [(r["a"], r["b"]) for r in batch.column("runs")[i].as_py()]
                        items |= set(batch.column("items")[i].as_py())
                    n_words.append(len(tokens))
                    all_runs.append([{"a": a, "b": b} for a, b in runs])
                    all_items.append(sorted(items))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(all_runs, run_type), pa.array(all_items, pa.list_(pa.string()))],
                    ["doc_id", "text", "n_words", "runs", "items"],
                )

        return run

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    groups = 0
    for group in item_groups(benchmark):
        found = found.mapInArrow(scan(group, groups == 0), _FOUND)
        groups += 1
    if not groups:
        found = found.mapInArrow(scan([], True), _FOUND)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits, spans = [], []
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                joined = []
                for a, b in sorted((r["a"], r["b"]) for r in runs):
                    if joined and a <= joined[-1][1]:
                        joined[-1] = (joined[-1][0], max(joined[-1][1], b))
                    else:
                        joined.append((a, b))
                hits.append(sum(b - a for a, b in joined))
                spans.append([{"start": s, "end": e} for s, e in original_spans(batch.column("text")[i].as_py(), joined)] if joined else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), pa.array(hits, pa.int64()), batch.column("items"), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "item_ids", "spans"],
            )

    return found.mapInArrow(finish, "doc_id long, n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>")


def without_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    spark = docs.sparkSession

    def clean(group):
        shared = spark.sparkContext.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = build_automaton(shared.value)
            for part in (part for batch in batches for part in slices(batch, "text")):
                yield part.filter(pa.array([not find(word_list(t.as_py()), automaton)[0] for t in part.column("text")], pa.bool_()))

        return lambda it: given_back(run(it))

    for group in item_groups(benchmark):
        docs = docs.mapInArrow(clean(group), docs.schema)
    return docs


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def brute_force(text: str | None, items: list[tuple]) -> tuple[int, int, str]:
    """(n_words, n_hit, items_sha256) by comparing every window."""
    tokens, hit, own = word_list(text), set(), set()
    for item, body in items:
        for window in item_windows(body):
            parts = window.split(b" ")
            for i in range(len(tokens) - len(parts) + 1):
                if tokens[i : i + len(parts)] == parts:
                    hit.update(range(i, i + len(parts)))
                    own.add(str(item))
    return len(tokens), len(hit), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest()
