"""A corpus pipeline over the table `documents`: each stage is written as
Parquet in the shared folder and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontaminate, language_id, order_minhash, piece_codec, secret_scan
from veilspark.llm.common import materialize, read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go."""
    return language_id.with_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    return order_minhash.near_dedup(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.without_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secret_scan.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' piece ids, with a check of their decoding."""
    rows = piece_codec.encode(docs, decoded=True)
    exact = F.col("decoded").eqNullSafe(F.translate("text", piece_codec.MARK, " "))
    return rows.select("doc_id", "lang", "source", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), exact.alias("round_trip"), "piece_ids")


STAGES: list[tuple[str, Stage]] = [
    ("language ID", keep_known_language),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Language ID, near-duplicate classes and piece ids cannot be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
