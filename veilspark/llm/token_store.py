"""Token ids in wavelet-matrix shards.

Documents are dealt in ascending id order (nulls first, equal ids by a hash of
their text), encoded, and packed into shards of about SHARD_TOKENS ids; a document
is never split. A shard is one compressed binary file, stored as one row of the
shard table so that Spark's own commit protocol covers it on any file system: a
header (document ids and lengths), then one bit-plane per bit of the largest id,
cut into blocks of BLOCK_BITS that are compressed one by one, with the place of
every block and the ones before it (the rank directory). A WaveletMatrix opened on
the file answers access, rank, select (occurrence lookup) and count by inflating
only the blocks that a question touches; decode reads them all.

Edge cases: a null or empty text is its end id alone; a null id is stored as
such; repeated rows are stored again; a very long text is a shard of its own
size; other columns are ignored; an empty table makes no shard.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_distinct, given_back, materialize, slices

END_ID = 2
SHARD_TOKENS = 1 << 20
MAGIC = b"VWM2"
#: Bits of a block, and blocks that an opened shard keeps inflated.
BLOCK_BITS = 1 << 16
KEPT_BLOCKS = 256
#: Bytes of text whose different words are encoded together.
SLICE_BYTES = 32 << 20
_TABLE = "part int, seq int, first_token long, n_tokens long, file binary"
_TOKENIZERS: dict[str, tuple] = {}


def _pack(values) -> bytes:
    body = zlib.compress(np.asarray(values).tobytes(), 1)
    return struct.pack("<Q", len(body)) + body


class WaveletMatrix:
    """Rank/select bit-planes of a sequence of non-negative integers, in a file."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.raw, self._kept = raw, {}
        self.n, n_docs, self.bits = struct.unpack_from("<QQB", raw, 4)
        at, parts = 21, []
        for _ in range(6):
            (size,) = struct.unpack_from("<Q", raw, at)
            parts.append(zlib.decompress(raw[at + 8 : at + 8 + size]))
            at += 8 + size
        known = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n_docs).astype(bool)
        ids = [int(i) if k else None for i, k in zip(np.frombuffer(parts[1], "<i8"), known, strict=True)]
        self.docs = (ids, np.frombuffer(parts[2], "<u8").astype(np.int64))
        self.zeros = [int(z) for z in np.frombuffer(parts[3], "<u8")]
        per = -(-self.n // BLOCK_BITS)
        self.ranks = np.frombuffer(parts[4], "<u8").astype(np.int64).reshape(self.bits, per)
        self.places = at + np.frombuffer(parts[5], "<u8").astype(np.int64)

    @staticmethod
    def build(ids: np.ndarray, docs: tuple = ((), ())) -> bytes:
        """The file of a sequence."""
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        order = ids.astype(np.uint32 if bits > 16 else np.uint16)
        zeros, ranks, bodies, step = [], [], [], BLOCK_BITS // 8
        for b in range(bits - 1, -1, -1):
            bit = (order & order.dtype.type(1 << b)) != 0
            plane = np.packbits(bit)
            low = order[~bit]
            zeros.append(len(low))
            order = np.concatenate([low, order[bit]])
            cuts = range(0, len(plane), step)
            ones = [int(np.bitwise_count(plane[a : a + step]).sum(dtype=np.int64)) for a in cuts]
            ranks += list(itertools.accumulate(ones, initial=0))[:-1]
            bodies += [zlib.compress(plane[a : a + step].tobytes(), 1) for a in cuts]
        own, lengths = docs
        head = struct.pack("<QQB", len(ids), len(own), bits)
        parts = [
            np.packbits(np.array([i is not None for i in own], bool)),
            np.array([0 if i is None else i for i in own], "<i8"),
            np.array(lengths, "<u8"),
            np.array(zeros, "<u8"),
            np.array(ranks, "<u8"),
            np.cumsum([0, *map(len, bodies)]).astype("<u8"),
        ]
        return MAGIC + head + b"".join(map(_pack, parts)) + b"".join(bodies)

    def _block(self, level: int, block: int) -> np.ndarray:
        k = level * self.ranks.shape[1] + block
        if k not in self._kept:
            if len(self._kept) >= KEPT_BLOCKS:
                self._kept.pop(next(iter(self._kept)))
            self._kept[k] = np.frombuffer(zlib.decompress(self.raw[self.places[k] : self.places[k + 1]]), np.uint8)
        return self._kept[k]

    def _bit(self, level: int, i: int) -> int:
        block, inside = divmod(i, BLOCK_BITS)
        return int(self._block(level, block)[inside >> 3] >> (7 - (inside & 7))) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.zeros[level]
        block, inside = divmod(i, BLOCK_BITS)
        if inside == 0:
            return int(self.ranks[level, block])
        part = self._block(level, block)[: (inside + 7) >> 3]
        ones = int(np.bitwise_count(part).sum(dtype=np.int64))
        if inside & 7:
            ones -= (int(part[-1]) & ((1 << (8 - (inside & 7))) - 1)).bit_count()
        return int(self.ranks[level, block]) + ones

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, i), self._ones(level, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where the occurrences of symbol among the first i ids lie below the last plane."""
        lo, hi = 0, i
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if symbol >> (self.bits - 1 - level) & 1:
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of symbol among the first i ids."""
        if symbol >> self.bits:
            return 0
        lo, hi = self._range(symbol, min(i, self.n))
        return hi - lo

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of symbol."""
        if not 0 <= k < self.count(symbol):
            raise IndexError(k)
        at = self._range(symbol, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            at = self._nth(level, bit, at - self.zeros[level] if bit else at)
        return at

    def _nth(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) bit of this value in a plane: the block
        from the directory, then the place in it."""
        starts = np.arange(self.ranks.shape[1]) * BLOCK_BITS
        before = self.ranks[level] if bit else starts - self.ranks[level]
        block = int(np.searchsorted(before, k, side="right")) - 1
        plane = np.unpackbits(self._block(level, block), count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))
        return block * BLOCK_BITS + int(np.flatnonzero(plane == bit)[k - before[block]])

    def occurrences(self, symbol: int) -> list[int]:
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the stable partition of every plane."""
        order = np.zeros(self.n, np.uint32 if self.bits > 16 else np.uint16)
        per = self.ranks.shape[1]
        for level in range(self.bits - 1, -1, -1):
            plane = b"".join(zlib.decompress(self.raw[self.places[k] : self.places[k + 1]]) for k in range(level * per, (level + 1) * per))
            bit = np.unpackbits(np.frombuffer(plane, np.uint8), count=self.n).view(bool)
            z, out = self.zeros[level], np.empty_like(order)
            out[~bit] = order[:z]
            out[bit] = order[z:] | order.dtype.type(1 << (self.bits - 1 - level))
            order = out
        return order


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizers(model: str) -> tuple:
    """The tokenizer; the same model cut at blanks only, for words of small letters,
    which normaliser and pre-tokenizer leave as they are; which ids end a word."""
    if model not in _TOKENIZERS:
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        whole = Tokenizer.from_file(model)
        spec = json.loads(whole.to_str())
        steps = [{"type": "WhitespaceSplit"}, *(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]
        bare = Tokenizer.from_str(json.dumps(spec | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": steps}, "added_tokens": []}))
        vocabulary = spec["model"]["vocab"]
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for word, i in vocabulary.items() if word.endswith(spec["model"]["end_of_word_suffix"])]] = True
        _TOKENIZERS[model] = whole, bare, ends
    return _TOKENIZERS[model]


def _flat(found: list) -> np.ndarray:
    lists = [e.ids for e in found]
    return np.fromiter(itertools.chain.from_iterable(lists), np.int32, sum(map(len, lists)))


def _encode_words(chunks: pa.Array, model: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all chunks in a row, ids per chunk)"""
    whole, bare, ends = _tokenizers(model)
    small = pc.match_substring_regex(chunks, "^[a-zà-öø-ÿ]+$").to_numpy(zero_copy_only=False)
    words = chunks.filter(pa.array(small)).to_pylist()
    lines = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    ids = _flat(bare.encode_batch_fast(lines, add_special_tokens=False))
    others = whole.encode_batch_fast(chunks.filter(pa.array(~small)).to_pylist(), add_special_tokens=False)
    sizes = np.zeros(len(chunks), np.int64)
    sizes[small] = np.diff(np.flatnonzero(ends[ids]), prepend=-1)
    sizes[~small] = np.fromiter((len(e.ids) for e in others), np.int64, len(others))
    order = np.concatenate([np.flatnonzero(small), np.flatnonzero(~small)])
    shift = np.empty(len(chunks), np.int64)
    shift[order] = np.cumsum(sizes[order]) - sizes[order]
    ids = np.concatenate([ids, _flat(others)])
    return ids[np.repeat(shift - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes


def encode_texts(texts: pa.Array, model: str) -> list[np.ndarray]:
    """Ids of whole texts. The tokenizer's pre-tokens never reach over a blank,
    so a text's ids are those of its blank-separated chunks in a row; a full stop
    or comma that ends a word is a pre-token of its own; case does not count
    outside of special tokens. So the different chunks are fewer."""
    plain = pc.replace_substring(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), "\t", " ")
    plain = pc.if_else(pc.match_substring(plain, "<|"), plain, pc.ascii_lower(plain))
    apart = pc.replace_substring_regex(plain, "([a-zà-öø-ÿ])([.,]) ", "\\1 \\2 ")
    split = pc.split_pattern(apart, " ")
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    ids, sizes = by_distinct(pc.list_flatten(split), lambda chunks: _encode_words(chunks, model))
    ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
    return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def write_shards(docs: DataFrame, model: str | None = None, partitions: int | None = None) -> DataFrame:
    """Encode docs (doc_id, text) and write the shard table; it is returned as read back."""
    spark = docs.sparkSession
    model = model or default_tokenizer()
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        runs, ids, size = [], [], 0

        def shard() -> pa.RecordBatch:
            file = WaveletMatrix.build(np.concatenate(runs), (ids, [len(r) for r in runs]))
            values = {"part": part, "seq": seq, "first_token": first, "n_tokens": size, "file": file}
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values.values(), kinds, strict=True)], list(values))

        end = np.array([END_ID], np.int32)
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                found = encode_texts(piece.column("text"), model)
                for doc, run in zip(piece.column("doc_id").to_pylist(), found, strict=True):
                    ids.append(doc)
                    runs.append(np.concatenate([run, end]))
                    size += len(run) + 1
                    if size >= SHARD_TOKENS:
                        yield shard()
                        runs, ids, seq, first, size = [], [], seq + 1, first + size, 0
        if ids:
            yield shard()

    # the text's hash splits the rows of one id, or of none
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mixed"))
    ordered = rows.repartitionByRange(partitions, "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed")
    return materialize(ordered.select("doc_id", "text").mapInArrow(lambda it: given_back(pack(it)), _TABLE), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) per document."""
    spark = shards.sparkSession

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, raw in zip(batch.column("part").to_pylist(), batch.column("first_token").to_pylist(), batch.column("file"), strict=True):
                matrix = WaveletMatrix(raw.as_py())
                tokens = matrix.decode().astype("<u4")
                ids, lengths = matrix.docs
                ends = np.cumsum(lengths)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part] * len(ids), pa.int32()),
                        "doc_id": pa.array(ids, pa.int64()),
                        "start": pa.array(first + ends - lengths, pa.int64()),
                        "n_tokens": pa.array(lengths, pa.int64()),
                        "ids": pa.array([tokens[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)], pa.binary()),
                    }
                )

    rows = shards.select("part", "first_token", "file").mapInArrow(unpack, "part int, doc_id long, start long, n_tokens long, ids binary")
    # one total per partition of the writing job, whatever the number of ids
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    bases, base = [], 0
    for r in totals:
        bases.append((r["part"], base))
        base += r["n"]
    known = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    return rows.join(known, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")


def token_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Write the shards, read them back: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(docs, model)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
