"""Count-min sketches in shards whose number grows with the corpus.

A part of the rows enters the hashes of its entries; only counters above zero
travel, as compressed gaps, to the shard that holds them, and each part gets
back which of its own counters are two or more in the merged sketch. Counters
stop at two. No task holds more than one shard and nothing is broadcast.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from .common import mix64

DEPTH = 2
SKETCH = "part long, shard long, row int, cells binary"


def counters(entries: np.ndarray, row: int, shards: int, cells: int) -> np.ndarray:
    """Counter of each entry in a sketch row: shard * cells + counter of the shard."""
    entries = mix64(entries)  # minimisers are small hashes
    shard = (entries >> np.uint64(33)) & np.uint64(shards - 1)
    cell = mix64(entries + np.uint64((row + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) & np.uint64(cells - 1)
    return (shard * np.uint64(cells) + cell).astype(np.int64)


def packed(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Rising counters of a shard with the mark "two or more", as compressed gaps."""
    return zlib.compress((np.diff(cells, prepend=0).astype(np.uint32) << 1 | twice).tobytes(), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps = np.frombuffer(zlib.decompress(raw), np.uint32)
    return np.cumsum(gaps >> 1, dtype=np.int64), (gaps & 1).astype(np.uint8)


def sketch(part: int, found: list[list[np.ndarray]], cells: int) -> pa.Table:
    """A part's counters (for each sketch row, arrays of counters hit), one row a shard."""
    out: dict[str, list] = {"shard": [], "row": [], "cells": []}
    for row in range(DEPTH):
        hit, n = np.unique(np.concatenate(found[row]), return_counts=True)
        shard = hit // cells
        begins = np.flatnonzero(np.diff(shard, prepend=-1))
        for begin, end in zip(begins, np.append(begins, len(hit))[1:], strict=True):
            out["shard"].append(int(shard[begin]))
            out["row"].append(row)
            out["cells"].append(packed(hit[begin:end] - shard[begin] * cells, (n[begin:end] > 1).astype(np.uint32)))
    return pa.table(
        {
            "part": pa.array([part] * len(out["row"]), pa.int64()),
            "shard": pa.array(out["shard"], pa.int64()),
            "row": pa.array(out["row"], pa.int32()),
            "cells": pa.array(out["cells"], pa.binary()),
        }
    )


def merge_shard(sketches: pa.Table, cells: int) -> pa.Table:
    """Adds up one shard of all parts' sketches; each part's counters of two or more."""
    total = np.zeros(cells, np.uint8)
    column = sketches.column("cells")
    for raw in column:
        hit, twice = unpacked(raw.as_py())
        total[hit] = np.minimum(2, total[hit] + 1 + twice)
    answers = []
    for raw in column:
        hit, _ = unpacked(raw.as_py())
        hit = hit[total[hit] == 2]
        answers.append(packed(hit, np.zeros(len(hit), np.uint32)))
    at = sketches.schema.get_field_index("cells")
    return sketches.set_column(at, "cells", pa.array(answers, pa.binary()))


def answers_of(table: pa.Table, cells: int) -> list[np.ndarray]:
    """For each sketch row the sorted counters that are two or more in the merged sketch."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(DEPTH)]
    for batch in table.to_batches():
        for shard, row, raw in zip(*(batch.column(c).to_pylist() for c in ("shard", "row", "cells")), strict=True):
            if raw is not None:
                found[row].append(unpacked(raw)[0] + shard * cells)
    return [np.sort(np.concatenate(f)) for f in found]


def repeated(entries: np.ndarray, answers: list[np.ndarray], shards: int, cells: int) -> np.ndarray:
    """Which entries have an estimate of two or more."""
    found = np.ones(len(entries), bool)
    for row, known in enumerate(answers):
        wanted = counters(entries, row, shards, cells)
        found &= np.append(known, -1)[np.searchsorted(known, wanted)] == wanted
    return found
