"""Shared helpers of the corpus operators: table access, scratch tables, and
vectorised word hashing over Arrow string buffers.

Null rules used everywhere: a null text is an empty text; a null id never
compares as smaller than another id and never joins to one.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text hashed at a time inside a task; bounds numpy temporaries.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch in the actions of small_batches.
BATCH_BYTES = 4 << 20

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster (`spark.checkpoint.dir`); a temporary
    one is set only where none is configured, as in local tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the
    lineage in a way that survives lost executors."""
    path = f"{scratch_root(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Of the actions inside, tasks of Python get Arrow batches of about BATCH_BYTES."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each changed until df has no column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def positions(df: DataFrame, by: list[str], order: list[str], tag: str) -> DataFrame:
    """df with `position` (from 0, in the order of `order`, nulls first) within
    each value of `by` (nulls are a value) and `total`, the number of its rows.

    Rows are dealt by ranges of (by, order), so a value of `by` with a third of
    all rows lies in many tasks; each range adds where the value's rows in
    earlier ranges end. Those facts are one row a value and range."""
    keys = [F.col(c).asc_nulls_first() for c in (*by, *order)]
    narrow = materialize(df, tag)  # dealing by ranges reads its input twice
    laid = materialize(narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), tag)
    laid = laid.withColumn("_range", F.shiftrightunsigned("_at", 33))
    spans = laid.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("_range").alias("_r"),
        *[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("total"),
    )
    same = F.col("_range") == F.col("_r")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return laid.join(spans, same).select(*df.columns, (F.col("_at") + F.col("_shift")).alias("position"), "total")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part has about `limit` bytes of `column`; one
    longer text is a part of its own."""
    n = batch.num_rows
    if n == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths, dtype=np.int64)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def by_distinct(chunks: pa.Array, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(values of all chunks in order, number of values per chunk), where encode
    gives the same for the different chunks, each of which it sees once."""
    coded = chunks.dictionary_encode()
    values, sizes = encode(coded.dictionary)
    rows = coded.indices.to_numpy()
    n = sizes[rows]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    shift = ((np.cumsum(sizes) - sizes)[rows] - (ends - n)).astype(kind)
    return values[np.repeat(shift, n) + np.arange(total, dtype=kind)], n


def give_back() -> None:
    """Freed memory of this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """batches; at the end of the task its freed memory goes back to the system,
    since workers live on for other stages."""
    yield from batches
    give_back()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its texts."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public MurmurHash3 fmix64 constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = -(-n // 65536) * 65536
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Polynomial hash modulo 2**64 of values[start:end] for every range, from
    one prefix sum, finalised by mix64."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts])


#: Separators of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_PLACE = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def words(data: np.ndarray, offsets: np.ndarray, twice: bool = False) -> tuple:
    """64-bit hash of every word, and for every text the index of its first
    word (n + 1 entries); with `twice` a second, independent hash in between.

    A word's hash is the sum of the mixed (byte, place) pairs, so no regular
    word collides by its structure, as it may in a polynomial modulo 2**64."""
    if len(data) == 0:
        none = np.zeros(0, np.uint64)
        return (none,) * (1 + twice) + (np.zeros(len(offsets), np.int64),)
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    lengths = ends - starts
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    pairs = mix64(((place << 8) + data[inside] + 1).astype(np.uint64) * _PLACE)
    found = []
    for _ in range(1 + twice):
        sums = np.add.reduceat(pairs, at) if len(at) else np.zeros(0, np.uint64)
        found.append(mix64(sums + lengths.astype(np.uint64) * _PLACE))
        if twice and len(found) == 1:
            pairs = mix64(pairs + _OTHER)
    return (*found, np.searchsorted(starts, offsets))


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of every window of `size` words that lies in one text, and
    for every text the number of its windows."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    base = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return base + np.arange(total), counts
