import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql.types import StringType, StructType

import corpus_pipeline
from veilspark.llm import decontaminate, language_id, order_minhash, piece_codec, secret_scan
from veilspark.llm.common import materialize, small_batches


def test_stages_in_turn(spark, sf, documents):
    docs = documents
    kept = [docs.count()]
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf), "test")
        kept.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.schema == documents.schema
        if name == "language ID":
            told = {r["doc_id"] for r in language_id.identify(before).where("lang_pred <> 'und' and score >= 0.5").collect()}
            assert {r["doc_id"] for r in docs.collect()} == told
        if name == "MinHash near-dedup":
            classes = {r["class_id"] for r in order_minhash.near_duplicates(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == classes
        if name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in bench.collect()]
            assert all(not decontaminate.brute_force(r["text"], items)[1] for r in docs.limit(40).collect())
        if name == "secret scans":
            assert all(not secret_scan.brute_force(r["text"]) for r in docs.collect())
    assert kept[1] <= kept[0] and kept[2] < kept[1] and kept[3] < kept[2] and kept[4] == kept[3] == kept[5]
    assert docs.where("not round_trip").count() == 0
    assert docs.count() == corpus_pipeline.run(spark, sf).count()


def test_odd_and_empty_documents(spark, sf, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf), "test")
        docs.count()


class Taken:
    """A table whose mapInArrow gives the function that tasks would run."""

    columns, schema = ["text"], StructType().add("text", StringType())

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("stage", ["clean", "redact", "encode"])
def test_large_batches_leave_in_parts(spark, stage):
    run = {
        "clean": lambda docs: decontaminate.without_contamination(docs, spark.createDataFrame([(1, "x y z")], "item_id long, text string")),
        "redact": secret_scan.redact,
        "encode": lambda docs: piece_codec.encode(docs, decoded=True),
    }[stage](Taken(spark))
    text = "several words of one text " * 4000
    parts = list(run(iter([pa.RecordBatch.from_pydict({"text": [text, None, ""] * 100})])))
    assert [t for part in parts for t in part.column("text").to_pylist()] == [text, None, ""] * 100
    assert max(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0 for part in parts) <= 4 << 20


def test_small_batches(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    docs = spark.range(0, 4000, 1, 1).selectExpr("id", "repeat(string(id % 10), 4000) as text")
    with small_batches(spark):
        small = docs.mapInArrow(sizes, "bytes long").collect()
    assert len(small) > 2 and max(r["bytes"] for r in small) < 6 << 20
    assert len(docs.mapInArrow(sizes, "bytes long").collect()) == 1
