"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts every n-gram of every labelled text, as one matrix per
partition and language that it has, merged block by block in Spark. The
log-probability matrix has 64 KB a language (BUCKETS floats), whatever the corpus,
and is broadcast; texts are scored in batches by gathering the rows of their n-grams,
GATHERED floats at a time, and adding them up per text, on top of the log priors, the
languages' shares of the training rows. A prediction sees the text only.

Edge cases: a null text or one without a letter is `und` with score 0; without
labelled rows everything is `und`; ties go to the first language in order; repeated
rows count again; a very long text is cut into pieces of SLICE_CHARS, whose n-grams
add up to those of the whole; columns of clashing names are renamed while at work.
Every label value is a language, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, given_back, slices

BUCKETS = 1 << 14
NGRAMS = (1, 2, 3)
SLICE_CHARS = 1 << 18
BLOCK = 256
#: Matrix entries gathered at a time.
GATHERED = 1 << 20
SMOOTHING = 0.5
_ODD = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def _parts(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Lower-cased texts with a space on both sides, in runs of about SLICE_CHARS
    code points: (row of each piece, pieces, n-grams that may start in it). A
    longer text is cut after it was lower-cased; its pieces overlap by what the
    longest n-gram needs, and no n-gram starts in the overlap."""
    rows, run, starts, size = [], [], [], 0
    for i, t in enumerate(texts):
        low = f" {t.lower()} "
        for at in range(0, len(low), SLICE_CHARS):
            piece = low[at : at + SLICE_CHARS + max(NGRAMS) - 1]
            if run and size + len(piece) > SLICE_CHARS:
                yield np.array(rows), run, np.array(starts)
                rows, run, starts, size = [], [], [], 0
            rows.append(i)
            run.append(piece)
            starts.append(SLICE_CHARS)
            size += len(piece)
    if run:
        yield np.array(rows), run, np.array(starts)


def buckets(pieces: list[str], n: int, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of code points of the pieces, and their number a
    piece, of which at most `starts` begin in it."""
    lengths = np.array([len(t) for t in pieces], np.int64)
    codes = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = np.zeros(max(0, len(codes) - n + 1), np.uint32)
    for k in range(n):
        mixed = mixed * np.uint32(_ODD[0]) + codes[k : k + len(mixed)] * np.uint32(_ODD[1]) + np.uint32(n)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(_ODD[2])
    counts = np.maximum(lengths - n + 1, 0)
    if starts is not None:
        counts = np.minimum(counts, starts)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < np.repeat(counts, lengths)
    return (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)[inside[: len(mixed)]], counts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in (piece for batch in batches for piece in slices(batch, "text")):
        langs = batch.column("lang").to_pylist()
        for rows, run, starts in _parts(batch.column("text").to_pylist()):
            known = sorted({langs[i] for i in rows})
            row = np.array([known.index(langs[i]) for i in rows], np.int64)
            for n in NGRAMS:
                found, counts = buckets(run, n, starts)
                own = np.repeat(row, counts)
                for k, lang in enumerate(known):
                    added = np.bincount(found[own == k], minlength=BUCKETS)
                    total[lang] = total[lang] + added if lang in total else added
    for lang, n in total.items():
        for b in range(0, BUCKETS, BLOCK):
            if n[b : b + BLOCK].any():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "block": pa.array([b], pa.int32()), "n": pa.array([n[b : b + BLOCK].tobytes()], pa.binary())})


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["n"])
    return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "block": [pdf["block"].iloc[0]], "n": [total.tobytes()]})


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities as buckets x languages, log priors) from rows (text, lang)."""
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    priors = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(priors)
    counts = np.zeros((len(languages), BUCKETS))
    if languages:
        merged = rows.mapInArrow(lambda b: given_back(_count(b)), "lang string, block int, n binary").groupBy("lang", "block").applyInPandas(_add, "lang string, block int, n binary")
        for r in merged.toLocalIterator():
            counts[languages.index(r["lang"]), r["block"] : r["block"] + BLOCK] = np.frombuffer(r["n"], np.int64)
    counts += SMOOTHING
    prior = np.log(np.array([priors[v] for v in languages], float) / max(1, sum(priors.values())))
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32).copy() if languages else np.zeros((BUCKETS, 0), np.float32), prior


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with two columns added (columns of their names are replaced): the
    language of the largest log prior plus log-likelihood of all n-grams, and its
    score: its posterior, where the log-odds of a text with more than SHARP n-grams are
    scaled to those of SHARP, so that long texts keep a meaningful score. The scale
    is the same for all languages and never changes which is the best."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    (letter,) = fresh(docs, "has_letter")
    marked = docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    names = [c for c in docs.columns if c not in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, table, prior = shared.value
        for batch in (piece for batch in batches for piece in slices(batch, "text")):
            lettered = batch.column(letter).to_numpy(zero_copy_only=False)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            sums, size = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
            step = max(1, GATHERED // max(1, len(languages)))
            for rows, run, starts in _parts(texts) if languages else ():
                for n in NGRAMS:
                    found, counts = buckets(run, n, starts)
                    own = np.repeat(rows, counts)
                    for at in range(0, len(found), step):
                        some = own[at : at + step]
                        begins = np.flatnonzero(np.diff(some, prepend=-1))
                        sums[some[begins]] += np.add.reduceat(table[found[at : at + step]], begins, axis=0, dtype=np.float64)
                    np.add.at(size, rows, counts)
            if languages:
                sums += prior
                chosen = sums.argmax(axis=1)
                sums *= np.minimum(1.0, SHARP / np.maximum(size, 1))[:, None]
                odds = np.exp(sums - sums.max(axis=1, keepdims=True))
                odds /= odds.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(lettered):
                    best[i], score[i] = languages[chosen[i]], min(1.0, float(odds[i, chosen[i]]))
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(best, pa.string()), pa.array(score, pa.float64())], [*names, *out])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([docs.schema[c] for c in names]).add(out[0], StringType()).add(out[1], DoubleType())
    return marked.mapInArrow(lambda b: given_back(run(b)), schema)


#: Evidence, in n-grams, at which a text's score is capped.
SHARP = 400.0


def held_out(doc_id="doc_id"):
    """True where crc32 of the id as text leaves no remainder modulo 5; rows
    without an id are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train_on_documents(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    return train(docs.where(~held_out()))


def with_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of `least` or more."""
    lang, score = fresh(docs, "told_lang", "told_score")
    found = predict(docs, train_on_documents(docs), (lang, score))
    return found.where((F.col(lang) != "und") & (F.col(score) >= least)).select(docs.columns)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents."""
    model = train_on_documents(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def brute_force(labelled: list[tuple], texts: list[str | None]) -> list[tuple[str, float]]:
    """Plain reference for tests: (language, score) of the texts, learned from
    (text, lang) rows: counts a bucket in dictionaries, whole texts, no batches."""
    import unicodedata
    from collections import Counter
    from functools import cache
    from math import exp, log

    bucket = cache(lambda gram: int(buckets([gram], len(gram))[0][0]))

    def grams(text: str) -> list[int]:
        low = f" {text.lower()} "
        return [bucket(low[i : i + n]) for n in NGRAMS for i in range(len(low) - n + 1)]

    seen, rows = {}, Counter()
    for text, lang in labelled:
        if text is not None and lang is not None:
            seen.setdefault(lang, Counter()).update(grams(text))
            rows[lang] += 1
    out = []
    for text in texts:
        if not seen or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append(("und", 0.0))
            continue
        said = grams(text)
        odds = {}
        for lang in sorted(seen):
            total = sum(seen[lang].values()) + SMOOTHING * BUCKETS
            odds[lang] = log(rows[lang] / sum(rows.values())) + sum(log((seen[lang][b] + SMOOTHING) / total) for b in said)
        best = max(sorted(odds), key=odds.get)
        scale = min(1.0, SHARP / max(1, len(said)))
        out.append((best, 1 / sum(exp(scale * (v - odds[best])) for v in odds.values())))
    return out
