import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns whose names clash with those the operators add."""
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [
        (1, None, "en", "s", 0),
        (2, "", None, None, None),
        (3, " \n\t ", "en", "s", 3),
        (4, long, "en", "s", len(long)),
        (5, long + " tail", "en", "s", 1),
        (6, f"a b c {passage} d e f", "de", "s", 1),
        (7, f"x {passage} y", "de", "s", 1),
        (7, f"x {passage} y", "de", "s", 1),
        (None, f"q {passage} r", None, "s", 1),
        (9, "12345 !!! ###", "en", "s", 1),
        (10, "x" * 50_000, "en", "s", 1),
        (11, "naïve Straße İstanbul ſecret=abcdefgh \U0001f600 password: hunter2000", "de", "s", 1),
    ]
    plain = spark.createDataFrame(rows, DOCS)
    extra = "struct<a:int>"
    from pyspark.sql import functions as F

    return plain.withColumns(
        {
            "score": F.lit("x"),
            "lang_pred": F.lit(1),
            "keys": F.lit(None).cast(extra),
            "digest": F.lit(2),
            "node": F.lit(3),
            "own": F.lit("o"),
            "h1": F.lit("h"),
            "spans": F.lit(True),
            "w": F.lit(0),
            "t": F.lit(0),
            "runs": F.lit(0),
            "items": F.lit(0),
            "piece_ids": F.lit("p"),
            "decoded": F.lit(1.5),
            "words": F.lit(1),
            "class_id": F.lit(9),
            "part": F.lit(1),
            "start": F.lit(1),
            "told_lang": F.lit(4),
            "has_letter": F.lit(5),
            "TOLD_SCORE": F.lit(5),
        }
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
