"""SentencePiece (BPE) encoding by suffix-array matching, and decoding.

The texts of a batch fall into chunks (a run of word marks and what follows up to
the next mark; no piece reaches over that border). The batch's different chunks are
concatenated and indexed by a suffix array over their first MAX_PIECE characters,
which stand packed in 64-bit keys, so that sorting and searching compare words.
Every piece is looked up in it by binary search, all pieces at once, which gives its
occurrence ranges and so the edges (start, end, piece) of the segmentation lattice.
The edges are sorted by end position within their chunk and relaxed in that order.
Nothing is kept from one batch to the next.

Relaxing follows merge order, not summed scores: in byte-pair encoding a prefix
has exactly one encoding, and a piece may follow the last piece of the encoding
of the text before it if and only if merging the two pieces' text gives those
two pieces back. That test walks down the merges of both sides of the border
and is done for all edges of one position at once.

Characters that are no piece become byte pieces. Encoding adds the model's word
mark in front; blanks become word marks. A word mark in the text itself reads
as a blank, so it decodes to a blank (as with the public library).

Edge cases: a null text has null ids and decodes to null; an empty text has no
ids; a very long text is a batch of its own; repeated rows, null ids and other
columns pass unchanged; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from .common import by_distinct, give_back, given_back, slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Code points in one suffix array; a longer chunk has one of its own.
INDEX_CHARS = 1 << 17
#: Bytes of text whose different chunks are encoded together.
SLICE_BYTES = 4 << 20
_BORDER = 0x110000
_START, _NONE, _UNKNOWN = -1, -2, -3
_MODELS: dict[str, PieceModel] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """Pieces, merge order, final merge of each piece, and merge lookup."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = np.zeros(256, np.int32)
        self.text: list[bytes] = [b""] * size
        names, scores = {}, {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                names[piece], scores[piece] = i, model.get_score(i)
                self.text[i] = piece.replace(MARK, " ").encode()
        self.text[model.unk_id()] = " ⁇ ".encode()
        self.n_pieces = size
        # characters that occur only inside pieces get symbols after the ids
        symbols = dict(names)
        for c in sorted({c for p in names for c in p} - set(names)):
            symbols[c] = size + len(symbols) - len(names)
        self.chars = {i: c for c, i in symbols.items() if i >= size}
        # merges in order: best score first; of equal scores the longer piece,
        # since an equal merge further left goes first and makes a run grow
        order = sorted((p for p in names if len(p) > 1), key=lambda p: (-scores[p], -len(p), names[p]))
        total = size + len(self.chars)
        self.rank = np.full(total, -1, np.int64)
        for r, p in enumerate(order):
            self.rank[names[p]] = r
        self.left, self.right = np.arange(total), np.arange(total)
        ranks = {p: r for r, p in enumerate(order)}
        keys, merged, usable = [], [], []
        for p in order:
            parts = self._merge(list(p), ranks)
            if len(parts) == 2:  # the last merge is never done inside _merge
                self.left[names[p]], self.right[names[p]] = symbols[parts[0]], symbols[parts[1]]
                usable.append(p)
            for k in range(1, len(p)):
                if p[:k] in symbols and p[k:] in symbols:
                    keys.append(symbols[p[:k]] * total + symbols[p[k:]])
                    merged.append(ranks[p])
        at = np.argsort(keys)
        self.keys, self.merged, self.total = np.array(keys, np.int64)[at], np.array(merged, np.int64)[at], total
        usable += [s for s in symbols if len(s) == 1]
        self.longest = max(map(len, usable))
        self.piece_ids = np.array([symbols[s] for s in usable], np.int32)
        self.piece_sizes = np.array([len(s) for s in usable], np.int64)
        self.piece_codes = np.full((len(usable), self.longest), -1, np.int64)
        for i, s in enumerate(usable):
            self.piece_codes[i, : len(s)] = [ord(c) for c in s]

    @staticmethod
    def _merge(parts: list[str], ranks: dict[str, int]) -> list[str]:
        """Merge by order until two parts are left or none can be merged."""
        while len(parts) > 2:
            best = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Order number of the merge of a and b; a very large one if there is none."""
        key = a.astype(np.int64) * self.total + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], 1 << 60)

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """True where the merged text of a and b is again exactly a and b."""
        ok = self.merge_rank(a, b) == 1 << 60
        live = np.flatnonzero(ok)
        a, b = a[live].astype(np.int64), b[live].astype(np.int64)
        while len(live):
            ra, rb = self.rank[a], self.rank[b]
            more = (ra >= 0) | (rb >= 0)
            live, a, b, ra, rb = live[more], a[more], b[more], ra[more], rb[more]
            undo_b = rb >= ra  # of two equal merges the left one was made first
            limit = np.where(undo_b, rb, ra)
            a, b = np.where(undo_b, a, self.right[a]), np.where(undo_b, self.left[b], b)
            cross = self.merge_rank(a, b)
            bad = np.where(undo_b, cross <= limit, cross < limit)
            ok[live[bad]] = False
            live, a, b = live[~bad], a[~bad], b[~bad]
        return ok

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes, at = [], [], 0
        while at < len(chunks):
            stop, size = at, 0
            while stop < len(chunks) and (stop == at or size + len(chunks[stop]) <= INDEX_CHARS):
                size += len(chunks[stop]) + 1
                stop += 1
            some = self._encode(chunks[at:stop])
            ids.append(some[0])
            sizes.append(some[1])
            at = stop
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        joined = "\0".join(chunks) + "\0"
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        begins = np.cumsum(lengths + 1) - lengths - 1
        codes[begins + lengths] = _BORDER  # sorts after every character
        starts, ends, symbols = edges(codes, self)
        owner = np.repeat(np.arange(len(chunks)), lengths + 1)
        covered = np.zeros(len(codes) + 1, bool)  # characters that are no symbol
        covered[starts[ends - starts == 1]] = True
        odd = np.flatnonzero(~covered[:-1] & (codes != _BORDER))
        starts, ends = np.concatenate([starts, odd]), np.concatenate([ends, odd + 1])
        symbols = np.concatenate([symbols, np.full(len(odd), _UNKNOWN, np.int32)])
        where = ends - begins[owner[starts]]
        order = np.argsort(where, kind="stable")
        starts, ends, symbols, where = starts[order], ends[order], symbols[order], where[order]
        last = np.full(len(codes) + 1, _NONE, np.int32)
        back = np.zeros(len(codes) + 1, np.int64)
        last[begins] = _START
        cuts = np.flatnonzero(np.diff(where, prepend=-1)) if len(where) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, [*cuts[1:], len(where)], strict=True):
            before, symbol = last[starts[lo:hi]], symbols[lo:hi]
            good = (before != _NONE) & ((before < 0) | (symbol < 0))
            test = np.flatnonzero((before >= 0) & (symbol >= 0))
            good[test] = self.stays(before[test], symbol[test])
            take = np.flatnonzero(good) + lo
            last[ends[take]] = symbols[take]
            back[ends[take]] = starts[take]
        # walk all chunks backwards together
        found, at, live = [], begins + lengths, np.arange(len(chunks))
        live = live[lengths > 0]
        while len(live):
            here = at[live]
            if (last[here] == _NONE).any():
                raise ValueError("no segmentation")
            found.append((live, back[here], last[here]))
            at[live] = back[here]
            live = live[at[live] > begins[live]]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(chunks), np.int64)
        position = np.concatenate([f[1] for f in found])
        symbol = np.concatenate([f[2] for f in found])
        order = np.argsort(position, kind="stable")
        position, symbol = position[order], symbol[order]
        return self._with_bytes(symbol, position, codes, owner, len(chunks))

    def _with_bytes(self, symbol, position, codes, owner, n) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero((symbol < 0) | (symbol >= self.n_pieces))
        own = owner[position]
        if len(odd):
            raw = [chr(codes[position[i]]).encode("utf-8", "surrogatepass") for i in odd]
            repeat = np.ones(len(symbol), np.int64)
            repeat[odd] = [len(r) for r in raw]
            own = np.repeat(own, repeat)
            spread = np.repeat(symbol, repeat)
            firsts = (np.cumsum(repeat) - repeat)[odd]
            at = np.repeat(firsts - np.cumsum(repeat[odd]) + repeat[odd], repeat[odd]) + np.arange(int(repeat[odd].sum()))
            spread[at] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            symbol = spread
        return symbol.astype(np.int32), np.bincount(own, minlength=n)

    def decode(self, ids: np.ndarray) -> str:
        text = self.text
        raw = b"".join([text[i] for i in ids.tolist()])
        return raw.decode("utf-8", "replace").removeprefix(" ")


def packed_keys(dense: np.ndarray, depth: int, bits: int) -> list[np.ndarray]:
    """The first depth symbols of every suffix, 64 // bits of them in a key; the
    rows of a matrix are texts of their own, a single row is all suffixes of one."""
    per = 64 // bits
    wide = dense if dense.ndim == 2 else None
    n, keys = len(dense), []
    if wide is None:
        dense = np.concatenate([dense, np.zeros(depth + per, dense.dtype)])
    for at in range(0, depth, per):
        key = np.zeros(n, np.uint64)
        for k in range(at, at + per):
            key <<= np.uint64(bits)
            if wide is None:
                key |= dense[k : k + n].astype(np.uint64)
            elif k < depth:
                key |= wide[:, k].astype(np.uint64)
        keys.append(key)
    return keys


def suffix_array(keys: list[np.ndarray]) -> np.ndarray:
    """Positions in the order of their packed symbols."""
    return np.lexsort(keys[::-1]).astype(np.int32)


def _bound(ordered: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    """First rank in [low, high) whose key is not below want, or is above it."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        right = ordered[mid] <= want[open_] if after else ordered[mid] < want[open_]
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def edges(codes: np.ndarray, model: PieceModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, symbol) of every occurrence of every piece."""
    seen = np.zeros(_BORDER + 1, bool)
    seen[codes] = True
    symbol_of = np.where(seen, np.cumsum(seen), 0)  # 0: does not occur
    bits = 8 if symbol_of[-1] < 256 and seen.sum() < 256 else 16 if seen.sum() < 65536 else 32
    per = 64 // bits
    keys = packed_keys(symbol_of[codes], model.longest, bits)
    order = suffix_array(keys)
    inside = np.arange(model.longest)[None, :] < model.piece_sizes[:, None]
    wanted = np.where(inside, symbol_of[model.piece_codes], 0)
    live = np.flatnonzero((wanted > 0).sum(1) == model.piece_sizes)
    floors = packed_keys(wanted, model.longest, bits)
    lo, hi = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
    hi[live] = len(codes)
    for k, (key, floor) in enumerate(zip(keys, floors, strict=True)):
        live = live[(model.piece_sizes[live] > k * per) & (lo[live] < hi[live])]
        if len(live) == 0:
            break
        ordered, low = key[order], floor[live]
        rest = np.clip((k + 1) * per - model.piece_sizes[live], 0, per).astype(np.uint64) * np.uint64(bits)
        top = low | ((np.uint64(1) << rest) - np.uint64(1))
        if k == 0:
            lo[live], hi[live] = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, top, "right")
        else:
            lo[live], hi[live] = _bound(ordered, lo[live], hi[live], low, False), _bound(ordered, lo[live], hi[live], top, True)
    n = np.maximum(hi - lo, 0)
    starts = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return starts, starts + np.repeat(model.piece_sizes.astype(np.int32), n), np.repeat(model.piece_ids, n)


def model_of(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(texts: pa.Array | list[str | None], path: str) -> list[np.ndarray]:
    """Ids of whole texts. Where blanks stand alone the chunks are the words with a
    mark in front; other texts are cut by the pattern CHUNK."""
    model = model_of(path)
    column = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
    odd = pc.match_substring_regex(column, f"^$|^ | $|  |{MARK}").to_numpy(zero_copy_only=False)
    plain = pc.split_pattern(column.filter(pa.array(~odd)), " ")
    cut = pa.array([CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in column.filter(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
    out: list = [None] * len(column)
    for rows, chunks, mark in ((np.flatnonzero(~odd), plain, MARK), (np.flatnonzero(odd), cut, "")):
        ids, sizes = by_distinct(pc.list_flatten(chunks), lambda some, mark=mark: model.encode_chunks([mark + c for c in some.to_pylist()]))
        counts = pc.list_value_length(chunks).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(counts)])]
        for i, a, b in zip(rows.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[a:b]
    return out


def encode(docs: DataFrame, model: str | None = None, decoded: bool = False) -> DataFrame:
    """docs with the column piece_ids (array<int>) of text, and with `decoded`
    also the ids' text, made in the same pass; columns of these names are replaced."""
    model = model or default_model()
    new = ["piece_ids", "decoded"] if decoded else ["piece_ids"]
    names = [c for c in docs.columns if c not in new]

    def encoded(part: pa.RecordBatch) -> pa.RecordBatch:
        known = part.column("text").is_valid().to_pylist()
        ids = [i if k else None for k, i in zip(known, encode_texts(part.column("text"), model), strict=True)]
        out = [pa.array(ids, pa.list_(pa.int32()))]
        if decoded:
            own = model_of(model)
            out.append(pa.array([None if i is None else own.decode(i) for i in ids], pa.string()))
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *out], [*names, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield encoded(part)
                give_back()

    schema = StructType([docs.schema[c] for c in names]).add("piece_ids", ArrayType(IntegerType()))
    return docs.mapInArrow(lambda it: given_back(run(it)), schema.add("decoded", StringType()) if decoded else schema)


def decode(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows with the column decoded, the text of piece_ids."""
    model = model or default_model()
    names = [c for c in rows.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [model_of(model).decode(x.values.to_numpy()) if x.is_valid else None for x in part.column("piece_ids")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "decoded"])

    return rows.mapInArrow(run, StructType([rows.schema[c] for c in names]).add("decoded", StringType()))


def codec_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_sha256, round_trip for every row of docs (doc_id, text)."""
    rows = encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model, decoded=True)
    return rows.select(
        "doc_id",
        F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(F.coalesce(F.col("piece_ids").cast("string"), F.lit("[]")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.translate("text", MARK, " ")).alias("round_trip"),
    )
