"""Small tables, odd texts and bounds of the library's operators."""

import math
import random

import pytest

from veilspark.functions import seeded
from veilspark.functions.special import binomial_tail
from veilspark.operators import attacks, audit, ledger, utility
from veilspark.operators.generators import leaky_release
from veilspark.operators.release import holdout_size
from veilspark.plans.ranking import smallest
from veilspark.schema import infer_nonprivate


@pytest.mark.parametrize("wanted", [0, 1, 7, 8, 9, 700])
def test_smallest_takes_all_of_a_short_table(spark, wanted):
    df = spark.range(8)
    got = smallest(df, seeded.key("s", "id"), "id", wanted).collect()
    assert len(got) == 8 and sum(r["chosen"] for r in got) == min(wanted, 8)
    assert smallest(df.limit(0), seeded.key("s", "id"), "id", wanted).count() == 0


def test_smallest_of_groups(spark):
    df = spark.createDataFrame([(g, i) for g, n in (("a", 3), ("b", 40), ("c", 1)) for i in range(n)], "g string, i long")
    wanted = spark.createDataFrame([("a", 9), ("b", 5), ("c", 0)], "g string, wanted long")
    got = {r["g"]: r["c"] for r in smallest(df, seeded.key("s", "g", "i"), "i", wanted, ["g"]).where("chosen").groupBy("g").agg({"*": "count"}).toDF("g", "c").collect()}
    assert got == {"a": 3, "b": 5}


def test_split_without_strata(spark):
    one = spark.createDataFrame([(i, 1) for i in range(10)], "id long, y int")
    single = spark.createDataFrame([(i, int(i == 3)) for i in range(10)], "id long, y int")
    both = spark.createDataFrame([(i, i % 2) for i in range(20)], "id long, y int")
    for df, n in ((one, 2), (single, 2), (both, 4), (one.limit(0), 0)):
        assert utility.class_split(df, "y", "id", "t").where("test").count() == n


def test_holdout_of_few_rows():
    assert [holdout_size(n) for n in (0, 1, 2, 19, 39, 40, 100)] == [0, 0, 1, 9, 19, 20, 30]


def test_epsilon_bound_is_where_the_tail_meets_alpha():
    for n, k in ((20, 15), (100, 60), (100, 100), (1000, 930), (60, 41), (5, 5)):
        eps = audit.epsilon_bound(k, n)
        if eps > 0:
            assert binomial_tail(k, n, 1 / (1 + math.exp(-eps))) == pytest.approx(0.05, rel=1e-6)
    assert audit.epsilon_bound(50, 100) == audit.epsilon_bound(0, 9) == audit.epsilon_bound(9, 9, delta=1.0) == 0
    assert audit.epsilon_bound(40, 40) == pytest.approx(audit.epsilon_ceiling(40))
    assert all(audit.epsilon_ceiling(audit.canaries_needed(e)) >= e > audit.epsilon_ceiling(audit.canaries_needed(e) - 1) for e in (0.5, 1.0, 2.0, 4.0))
    found = audit.compare_auditors(60)
    assert found["one_run_guesses"] == 60 and found["one_run_ceiling"] == pytest.approx(2.972, abs=1e-3)
    assert found["paired_canaries"] == 30 and found["paired_ceiling"] == pytest.approx(audit.paired_ceiling(30))
    assert (found["canaries_for_1"], found["canaries_for_4"], found["canaries_for_8"]) == (10, 166, 8932)
    assert audit.compare_auditors(1)["paired_ceiling"] == 0


def test_ledger_of_any_letters(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    private, public = ledger.generate_keys(spark, str(tmp_path))
    book.append([ledger.Entry('Zürich "日本" \\ /', "r", "laplace")], lambda payload: ledger.sign(spark, private, payload))
    book.append([ledger.Entry("plain", "r", "laplace")])
    assert all(r["hash_ok"] and r["link_ok"] for r in ledger.checked(book.rows()).collect())
    assert ledger.badly_signed(book.rows(), public) == [1]
    with pytest.raises(ValueError, match="control"):
        ledger.Entry("a\nb", "r", "laplace")


def test_inferred_schema(spark):
    df = spark.createDataFrame([(i, i % 3, "x" if i % 2 else None) for i in range(50)], "a long, b int, c string")
    schema = infer_nonprivate(df)
    assert schema.bounds("a") == (0.0, 49.0) and schema["b"].categories == ("0", "1", "2") and schema["c"].categories == ("x",)
    assert schema.bounds("b") is None and schema.bounds("none") is None and schema.shared(df, df.select("c", "a")) == ["a", "c"]
    assert infer_nonprivate(df.limit(0)).names == ["a", "b", "c"]


def test_modal_shares(spark):
    df = spark.createDataFrame([(float(i < 9), float(i)) for i in range(10)], "a double, b double")
    got = {r["column"]: (r["modal_share"], r["informative"]) for r in utility.modal_shares(df, ["a", "b"]).collect()}
    assert got == {"a": (0.9, False), "b": (0.1, True)}


def test_leaky_release_keeps_its_share(spark):
    df = spark.range(40).selectExpr("id as rid", "id * 2.0 as x", "id * 3.0 as y")
    got = leaky_release(df, ["x", "y"], 0.25).collect()
    assert len(got) == 40 and sum(r["verbatim"] for r in got) == 10 and all(r["y"] == r["rid"] * 3 for r in got if r["verbatim"])


@pytest.mark.parametrize("size", [3, 40, 4000])
def test_smallest_gaps_sort_only_what_is_near(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice([1.0, 2.0, 3.0]), round(rng.uniform(0, 50), rng.choice([0, 3]))) for _ in range(size)] + [(2.0, 7.0)] * 4 + [(None, 1.0)] * 9
    targets = [(i, rng.uniform(0, 4), rng.uniform(-5, 55)) for i in range(6)] + [(6, 2.0, 7.0)]
    unit = {"x": (0.0, 1.5), "y": (0.0, 10.0)}
    release = spark.createDataFrame(rows, "x double, y double").repartition(3)
    goal = spark.createDataFrame(targets, "rid long, x double, y double")
    found = attacks._smallest_gaps(goal, release, ["x", "y"], unit, "rid", 5)
    got = {r["rid"]: r["gaps"] for r in found.collect()}
    for rid, a, b in targets:
        want = sorted(math.sqrt(((a - x) / 1.5) ** 2 + ((b - y) / 10) ** 2) for x, y in rows if x is not None)[:5]
        assert got[rid] == pytest.approx(want, rel=1e-12)
    # no pair is ranked before the tables of bounds and counted distances
    assert "SPARK_PARTITION_ID" not in found._jdf.queryExecution().toString().upper()
