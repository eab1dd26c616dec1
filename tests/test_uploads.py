"""Uploads, their catalogue, claims, and the table of ceilings."""

import pytest

from veilspark.operators import audit
from veilspark.sources import uploads
from veilspark.sources.claims import claim, give_up

CSV = "age, job\n 30 ,clerk\n?,clerk\n41,\n50, smith \n30,clerk\n"


@pytest.fixture
def file(tmp_path):
    (tmp_path / "people.csv").write_text(CSV)
    return f"file://{tmp_path}/people.csv"


def test_ingest_with_inferred_schema(spark, file):
    got = uploads.ingest(spark, file, "../my people!.csv")
    assert (got.name, got.rows, got.inferred, got.warnings) == ("mypeople", 3, True, (uploads.INFERRED,))
    assert sorted(map(tuple, got.table(spark).collect())) == [(30.0, "clerk"), (30.0, "clerk"), (50.0, "smith")]


def test_ingest_with_schema(spark, file):
    schema = '{"columns": [{"name": "age", "kind": "numerical", "lower": 0, "upper": 100}]}'
    got = uploads.ingest(spark, file, "p.csv", schema)
    assert not got.inferred and got.warnings == ()
    assert sorted(r[0] for r in got.table(spark).collect()) == [30.0, 30.0, 41.0, 50.0]
    for wrong in ({"schema_json": schema.replace("age", "size")}, {"most_bytes": 10}, {"name": "..."}):
        with pytest.raises(uploads.UploadError):
            uploads.ingest(spark, file, **({"name": "p", "schema_json": schema} | wrong))


def test_sample_is_the_same_however_dealt(spark):
    rows = [("a", 1)] * 300 + [("b", i) for i in range(100)] + [(None, 5), ("a", None)]
    df = spark.createDataFrame(rows, "s string, n int")
    one = sorted(map(str, uploads.sampled(df.repartition(7), 120).collect()))
    assert one == sorted(map(str, uploads.sampled(df.coalesce(1), 120).collect()))
    assert len(one) == 120
    # copies are drawn one by one: about 300 of 402 rows
    assert 70 < sum("s='a', n=1)" in r for r in one) < 108
    assert sorted(map(str, uploads.sampled(df, 1000).collect())) == sorted(str(r) for r in df.collect())
    assert uploads.sampled(df.where("false"), 5).count() == 0


def test_copies_beyond_one_block(spark, monkeypatch):
    monkeypatch.setattr(uploads, "BLOCK", 8)
    df = spark.range(50).selectExpr("1 AS x")
    assert uploads.sampled(df, 100).count() == 50
    assert uploads.sampled(df, 17).count() == 17


def test_catalogue_forgets_the_oldest(spark, file, tmp_path):
    upload = uploads.ingest(spark, file, "p")
    book = uploads.Catalogue(spark, f"file://{tmp_path}/catalogue", kept=2)
    assert book.entries().count() == 0
    for name in ("a", "b", "a", "c"):
        book.add(uploads.Upload(name, upload.path, upload.schema, upload.rows, True, upload.warnings))
    assert [r["name"] for r in book.entries().collect()] == ["c", "a"]
    assert book.get("a") == uploads.Upload("a", upload.path, upload.schema, 3, True, upload.warnings)
    with pytest.raises(uploads.UploadError):
        book.get("b")


def test_claims(spark, tmp_path):
    where = f"file://{tmp_path}/t"
    assert claim(spark, where, 3) and not claim(spark, where, 3) and claim(spark, where, 4)
    give_up(spark, where, 3)
    assert claim(spark, where, 3)


def test_interpolated_ceilings(spark):
    knots = audit.ceiling_table(spark, [10, 100, 20])
    rows = spark.createDataFrame([(4.0,), (10.0,), (15.0,), (100.0,), (999.0,), (None,)], "m double")
    got = {r["m"]: r for r in audit.interpolated(rows, "m", knots, "canaries", ["one_run"]).collect()}
    a, b, c = (audit.epsilon_ceiling(m) for m in (10, 20, 100))
    assert got[15.0]["one_run"] == pytest.approx((a + b) / 2)
    assert [got[m]["one_run"] for m in (4.0, 10.0, 100.0, 999.0, None)] == [a, a, c, c, None]
    assert [got[m]["in_range"] for m in (4.0, 10.0, 100.0, 999.0, None)] == [False, True, True, False, None]
