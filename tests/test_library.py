"""Schemas, sources, mechanisms, audits, ledger and releases."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import seeded
from veilspark.operators import attacks, audit, ledger, utility
from veilspark.operators.accounting import Accountant
from veilspark.operators.adaptive import AdaptiveTree, Aim
from veilspark.operators.generators import GaussianColumns, Independent, Pairwise, leaky_release, normalised
from veilspark.operators.noise import SeededNoise
from veilspark.operators.profile import discover, query_count
from veilspark.operators.release import Cell, Checkpoints, data_sheet, run_grid, run_release
from veilspark.plans.ranking import dense_index, smallest
from veilspark.schema import CATEGORICAL, NUMERICAL, ColumnSpec, PublicSchema, fallback_kinds, infer_nonprivate
from veilspark.sources import tables
from veilspark.streaming.windows import noisy_window_counts

XY = PublicSchema((ColumnSpec("x", NUMERICAL, 0, 100), ColumnSpec("y", NUMERICAL, 0, 100)))


@pytest.fixture(scope="module")
def correlated(spark):
    ids = spark.range(3000).withColumnRenamed("id", "rid")
    x = 100 * seeded.uniform("cx", "rid")
    y = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 0.9 * x + 6 * seeded.gaussian("cy", "rid")))
    return ids.select("rid", x.alias("x"), y.alias("y")).persist()


# schemas


def test_schema_rules():
    with pytest.raises(ValueError):
        ColumnSpec("a", NUMERICAL, 1, 1)
    with pytest.raises(ValueError):
        ColumnSpec("a", "date")
    with pytest.raises(ValueError):
        PublicSchema((ColumnSpec("a", CATEGORICAL), ColumnSpec("a", CATEGORICAL)))
    s = tables.PUBLIC["lineitem"]
    assert PublicSchema.from_json(s.to_json()) == s and s.bounds("l_tax") == (0, 0.08) and s.bounds("l_returnflag") is None


def test_clip_and_order(spark):
    s = PublicSchema((ColumnSpec("age", NUMERICAL, 0, 120), ColumnSpec("grp", CATEGORICAL, categories=("a", "b"))))
    df = spark.createDataFrame([("a", -5.0, 1), ("b", 30.0, 2), ("surprise", 500.0, 3), (None, float("nan"), 4), ("a", None, 5)], "grp string, age double, ignored int")
    rows = [tuple(r) for r in s.clip(df).collect()]
    assert rows == [(0.0, "a"), (30.0, "b"), (120.0, "__OTHER__"), (0.0, "__OTHER__"), (0.0, "a")]
    assert PublicSchema.of(s.clip(df)) == s and s.project(df).columns == ["age", "grp"]
    text = s.clip(df.select(F.lit("x1").alias("age"), "grp"))
    assert text.first()["age"] == 0.0
    with pytest.raises(ValueError, match="missing"):
        s.clip(df.drop("age"))


def test_bins_and_codes(spark):
    c = ColumnSpec("x", NUMERICAL, 0, 10)
    df = spark.createDataFrame([(v,) for v in (-3.0, 0.0, 0.99, 1.0, 9.99, 10.0, 99.0)], "x double")
    assert [r[0] for r in df.select(c.in_bins(10)).collect()] == [0, 0, 0, 1, 9, 9, 9]
    g = ColumnSpec("g", CATEGORICAL, categories=("a", "b"))
    assert [r[0] for r in spark.createDataFrame([("b",), ("z",), (None,)], "g string").select(g.code()).collect()] == [1, -1, -1]


def test_inference(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 15).alias("few"))
    s = infer_nonprivate(df)
    assert [c.kind for c in s.columns] == [NUMERICAL, CATEGORICAL, CATEGORICAL] and s.bounds("v") == (0, 49)
    assert fallback_kinds(df) == {"v": NUMERICAL, "g": CATEGORICAL, "few": NUMERICAL}


def test_csv(spark, tmp_path):
    (tmp_path / "gappy.csv").write_text("a, b\n1,x\n,y\n 3, z\nno,w\n")
    s = PublicSchema((ColumnSpec("b", CATEGORICAL), ColumnSpec("a", NUMERICAL, 0, 9)))
    assert [tuple(r) for r in tables.from_csv(spark, str(tmp_path / "gappy.csv"), s).orderBy("a").collect()] == [("x", 1.0), ("z", 3.0)]


def test_manifests(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).write_text(name)
    one = spark.createDataFrame(tables.manifest(spark, str(tmp_path / "*")).collect())
    digest = tables.combined_digest(one).first()[0]
    (tmp_path / "a").write_text("other")
    (tmp_path / "b").unlink()
    (tmp_path / "c").write_text("c")
    two = tables.manifest(spark, str(tmp_path / "*"))
    assert dict(tables.compare_manifests(one, two).collect()) == {"a": "changed", "b": "missing", "c": "new"}
    assert tables.combined_digest(two).first()[0] != digest


def test_registry(spark, sf):
    for name in tables.LOADERS:
        df, s = tables.load(spark, sf, name)
        assert s.clip(df).count() == df.count()
    with pytest.raises(KeyError):
        tables.load(spark, sf, "nothing")
    assert tables.toy(spark, 50).count() == 50


# exact ranks


def test_exact_ranks(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"))
    key = seeded.key("k", "id")
    order = [r["id"] for r in df.orderBy(key, "id").collect()]
    assert {r["id"] for r in smallest(df, key, "id", 137).where("chosen").collect()} == set(order[:137])
    assert smallest(df, key, "id", 0).where("chosen").count() == 0 and smallest(df, key, "id", 1000).where("chosen").count() == 1000
    ranks = {r["id"]: r["index"] for r in dense_index(df, key, "id").collect()}
    assert [ranks[i] for i in order] == list(range(1000))
    wanted = spark.createDataFrame([(0, 5), (1, 0), (2, 333)], "g int, wanted int")
    assert dict(smallest(df, key, "id", wanted, ["g"]).where("chosen").groupBy("g").count().collect()) == {0: 5, 2: 333}


# mechanisms


def fitted(mechanism, df, schema, eps=2.0):
    book = Accountant(eps * 1.02)
    return mechanism.fit(df, schema, book, eps), book


def corr(df):
    return df.agg(F.corr("x", "y")).first()[0]


def test_structure_separates_mechanisms(spark, correlated):
    found = {}
    for m in (Independent, Pairwise, AdaptiveTree, Aim):
        made, book = fitted(m(3, SeededNoise(5)), correlated, XY)
        out = made.generate(spark, 3000)
        assert 0.7 * 2.0 < book.total() <= 2.0 * 1.02 and out.count() == 3000
        assert out.where("x < 0 or x > 100 or y < 0 or y > 100").count() == 0
        found[m.name] = corr(out)
    assert corr(correlated) > 0.9 and abs(found["independent"]) < 0.15
    assert all(found[n] > 0.6 and found[n] > 3 * abs(found["independent"]) for n in ("pairwise", "adaptive_tree", "aim"))


def test_aim_orders_errors_on_a_cycle(spark):
    """Three columns with strong pairs that no chain holds: aim beats the chain, the chain beats independence."""
    ids = spark.range(6000).withColumnRenamed("id", "rid")
    a, b = 100 * seeded.uniform("a", "rid"), 100 * seeded.uniform("b", "rid")
    df = ids.select("rid", a.alias("x"), b.alias("z"), (0.5 * a + 0.5 * b).alias("y"))
    s = PublicSchema(tuple(ColumnSpec(c, NUMERICAL, 0, 100) for c in ("x", "z", "y")))
    errors = {}
    for m in (Independent, Pairwise, Aim):
        made, _ = fitted(m(1, SeededNoise(2)), df, s, 8.0)
        errors[m.name] = utility.correlation_error(df, made.generate(spark, 6000), ["x", "z", "y"])
    assert errors["aim"] < errors["pairwise"] < errors["independent"]


def test_aim_beliefs_match_direct_sums():
    made = Aim(0, SeededNoise())
    made.schema = PublicSchema(tuple(ColumnSpec(c, CATEGORICAL, categories=("0", "1", "2")) for c in "abcd"))
    made.sizes, made.total = dict.fromkeys("abcd", 3), 1.0
    rng = np.random.default_rng(0)
    made.measured = {("a", "b"): 0, ("b", "c"): 0, ("a", "c"): 0, ("c", "d"): 0}
    made.cliques = made._cliques()
    made.tree = made._tree(made.cliques)
    theta = [rng.normal(size=[3] * len(k)) for k in made.cliques]
    made.beliefs = made._beliefs(theta)
    joint = np.ones([3] * 4)
    for k, t in zip(made.cliques, theta, strict=True):
        joint = joint * np.exp(t).reshape([3 if c in k else 1 for c in "abcd"])
    joint /= joint.sum()
    for k, b in zip(made.cliques, made.beliefs, strict=True):
        assert np.allclose(b, joint.sum(axis=tuple(i for i, c in enumerate("abcd") if c not in k)))
    assert np.allclose(made._pair(("a", "d")), joint.sum(axis=(1, 2)))
    assert np.allclose(made._pair(("b", "d")), joint.sum(axis=(0, 2)))


def test_mechanism_rules(spark, correlated):
    with pytest.raises(RuntimeError):
        Pairwise().generate(spark, 5)
    with pytest.raises(RuntimeError):
        Independent().generate(spark, 5)
    for tree in ([("y", "x")], [("x", "y"), ("x", "y")], []):
        with pytest.raises(ValueError):
            Pairwise(tree=tree).fit(correlated, XY, Accountant(9), 1.0)
    made, _ = fitted(GaussianColumns(1, SeededNoise()), correlated, XY)
    assert made.generate(spark, 100).count() == 100
    assert normalised(np.array([[-1.0, 0.0], [3.0, 1.0]])).tolist() == [[0.5, 0.5], [0.75, 0.25]]


def test_profile(spark):
    df = spark.createDataFrame([("common", float(i)) for i in range(400)] + [("unique_person", 5.0)], "g string, v double")
    book = Accountant(1.0)
    p = discover(df, PublicSchema(), book, 0.5, SeededNoise(3))
    assert p.schema["g"].categories == ("common",) and p.suppressed == {"g": 1} and 0.45 < p.eps_spent <= 0.5
    assert query_count({"g": CATEGORICAL, "v": NUMERICAL}, PublicSchema()) == 3
    free = discover(df.select("v"), PublicSchema((ColumnSpec("v", NUMERICAL, 0, 400),)), Accountant(1.0), 0.5)
    assert free.eps_spent == 0 and free.public == {"v"}


# audits and attacks


@pytest.mark.parametrize(("share", "fires"), [(1.0, True), (0.0, False)])
def test_controls(spark, sf, share, fires):
    schema = PublicSchema((*XY.columns, ColumnSpec("c", CATEGORICAL, categories=("A", "B", "C"))))
    base = spark.range(800).select(F.col("id").alias("rid"), (20 + 60 * seeded.uniform("x", "id")).alias("x"), (20 + 60 * seeded.uniform("y", "id")).alias("y"), F.lit("A").alias("c"))
    cans = audit.canaries(spark, schema, 100)
    marked = audit.repaired(cans.withColumn("included", audit.included()))
    planted = audit.plant(base, marked.where("included").drop("included")).drop("is_canary")
    release = leaky_release(planted, schema.names, share)
    scores = audit.similarity(cans, release, schema).join(marked.select("canary_id", "included"), "canary_id")
    counts = audit.guesses(scores).first()
    found = audit.one_run(counts["correct"], counts["n_guess"])
    assert (found.epsilon > 0 and found.p_value < 0.05) == fires
    fit, other = planted, spark.range(5000, 5400).select(F.col("id").alias("rid"), (20 + 60 * seeded.uniform("x", "id")).alias("x"), (20 + 60 * seeded.uniform("y", "id")).alias("y"))
    goal = attacks.labelled(attacks.head(fit.where("rid >= 0"), "rid"), other, ["x", "y"], "rid")
    near = attacks.auc(attacks.nearest_scores(release, goal, ["x", "y"], "rid")).first()[0]
    ratio = attacks.auc(attacks.domias_neighbours(release, other, goal, ["x", "y"], "rid", 1)).first()[0]
    assert (near > 0.95 and ratio > 0.95) if fires else (abs(near - 0.5) < 0.1 and abs(ratio - 0.5) < 0.12)


def test_auc_counts_pairs(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 9, 300).astype(float), rng.random(300) < 0.4
    df = spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "score double, member boolean")
    pairs = np.mean([(a > b) + 0.5 * (a == b) for a in s[y] for b in s[~y]])
    assert attacks.auc(df).first()[0] == pytest.approx(pairs)
    assert attacks.tpr_at(attacks.roc_points(df), 1.0).first()["tpr"] == 1.0


def test_exact_match_needs_one_row(spark):
    release = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2)], "a string, b int")
    goal = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "a string, b int")
    assert tuple(attacks.exact_matches(release, goal, ["a", "b"]).first()) == (3, 1, pytest.approx(1 / 3))


def test_multiplicity(spark):
    def run(p):
        return [tuple(r) for r in audit.corrected(spark.createDataFrame(list(enumerate(p)), "id int, p double")).orderBy("id").select("bh", "bonferroni").collect()]

    found = run([0.001, 0.01, 0.03, 0.2, 0.5, 0.9])
    assert [round(b, 6) for b, _ in found] == [0.006, 0.03, 0.06, 0.3, 0.6, 0.9] and found[0][1] == 0.006
    assert all(b > 0.05 for b, _ in run([0.2] * 14)) and run([1e-6] + [0.6] * 13)[0][0] < 0.05


def test_utility_and_attribute_inference(spark):
    n = spark.range(900).select(F.col("id").alias("rid"), (18 + 62 * seeded.uniform("a", "id")).alias("age"), (10 + 50 * seeded.uniform("h", "id")).alias("hours"))
    df = n.withColumn("income", F.when(0.03 * F.col("age") + 0.05 * F.col("hours") + 0.4 * seeded.gaussian("n", "rid") > 3.2, ">50K").otherwise("<=50K")).persist()
    train, test = df.where("rid < 600"), df.where("rid >= 600")
    good = utility.utility(train, test, train, ["age", "hours"], "income")
    assert good["trtr"] > 0.7 and good["gap"] < 0.05 and good["mean_shift"] == pytest.approx(0, abs=1e-9)
    people = PublicSchema((ColumnSpec("age", "numerical", 18, 80), ColumnSpec("hours", "numerical", 10, 60), ColumnSpec("income", "categorical", categories=("<=50K", ">50K"))))
    found = attacks.attribute_inference(train, test, train, people, "income")
    assert found["attack"] > found["marginal"] + 0.05 and abs(found["over_conditional"]) < 0.05
    assert utility.macro_f1(spark.createDataFrame([("a", "a"), ("b", "a")], "y string, pred string")).first()["macro_f1"] == pytest.approx(1 / 3)


def test_informative_columns(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("spread"), F.when(F.col("id") < 95, 0.0).otherwise(F.col("id")).alias("mostly_zero"), F.lit(7.0).alias("constant"))
    found = utility.modal_shares(df, df.columns).where("informative").collect()
    assert [r["column"] for r in found] == ["spread"]


# ledger, releases, streams


def test_ledger_chain(spark, tmp_path):
    book = ledger.Ledger(spark, str(tmp_path / "ledger"))
    assert book.head() == (0, ledger.GENESIS)
    book.append([ledger.Entry("d", "r1", "gaussian", eps_spent=0.5), ledger.Entry("d", 'r"2\\', "laplace", eps_spent=1.0)])
    last = book.append([ledger.Entry("e", "r3", "laplace", eps_spent=2.0)])
    assert book.head() == (3, last) and book.rows("d").count() == 2
    assert tuple(ledger.broken_from(book.rows()).first()) == (3, None, 0)
    changed = book.rows().withColumn("eps_spent", F.when(F.col("seq") == 1, 99.0).otherwise(F.col("eps_spent")))
    assert tuple(ledger.broken_from(changed).first()) == (3, 1, 2)
    assert ledger.broken_from(book.rows().where("seq <> 0")).first()["first_bad"] == 1


def test_signatures(spark, tmp_path):
    private, public = ledger.generate_keys(spark, str(tmp_path))
    assert os.stat(private).st_mode & 0o777 == 0o600
    with pytest.raises(FileExistsError):
        ledger.generate_keys(spark, str(tmp_path))
    sheet = ledger.sign_sheet(spark, {"a": 1, "b": [1.5]}, private, public)
    ledger.verify_sheet(spark, json.loads(json.dumps(sheet)), public)
    with pytest.raises(ledger.BadSignature):
        ledger.verify_sheet(spark, sheet | {"a": 2}, public)
    _, other = ledger.generate_keys(spark, str(tmp_path), "other")
    with pytest.raises(ledger.BadSignature):
        ledger.verify_sheet(spark, sheet, other)
    with pytest.raises(ledger.BadSignature):
        ledger.verify_sheet(spark, sheet | {"signature": "AAAA"}, public)


def test_release(spark, correlated):
    df = correlated.where("rid < 600").withColumn("c", F.when(F.col("x") > 50, "A").otherwise("B"))
    schema = PublicSchema((*XY.columns, ColumnSpec("c", CATEGORICAL, categories=("A", "B"))))
    stages = []
    found = run_release(df, schema, Cell("pairwise", 4.0, canaries=20, records=60), noise=SeededNoise(1), on_stage=stages.append)
    assert stages == ["split", "canaries", "fit", "audit", "utility_fit", "utility", "attacks"]
    assert found["proved_eps"] <= 4.0 * 1.02 and found["rows"] == 420 and found["seeded_noise"] and 0 <= found["mia_auc"] <= 1
    paired = run_release(df, schema, Cell("independent", 4.0, canaries=20, auditor="paired", records=60), noise=SeededNoise(1))
    sheet = data_sheet([found, paired], (3, "h"))
    assert sheet["sum_eps"] > sheet["last_eps"] and sheet["attacks_run"] == ["domias", "mia"] and sheet["ledger_entries"] == 3
    with pytest.raises(ValueError):
        run_release(df, schema, Cell("nothing"))


def test_checkpoints(tmp_path):
    done = []

    def compute(cell):
        done.append(cell)
        if len(done) == 4:
            raise RuntimeError("lost")
        return {"seed": cell.seed}

    cells, store = [Cell("independent", 1.0, i) for i in range(6)], Checkpoints(str(tmp_path))
    with pytest.raises(RuntimeError):
        run_grid(cells, compute, store)
    (tmp_path / f"{cells[1].config_hash()}.json").write_text('{"config": {')
    assert [r["seed"] for r in run_grid(cells, compute, store)] == list(range(6)) and len(done) == 4 + 4
    assert Cell(eps=1).config_hash() == Cell(eps=1.0).config_hash() != Cell(eps=1.0, canaries=61).config_hash()


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = noisy_window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2.0)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("noisy").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("noisy").collect())) == sorted(map(tuple, noisy_window_counts(events, 2.0).collect()))


def test_projection(spark, correlated):
    from veilspark.operators.projection import project

    df = correlated.withColumn("w", seeded.uniform("w", "rid"))
    clouds = project(df, {"real": df, "few": df.where("rid < 50")}, ["x", "y", "w"])
    assert clouds["real"].count() == 700 and clouds["few"].count() == 50
    assert clouds["real"].where("abs(x) > 2.5 or abs(y) > 2.5 or abs(z) > 2.5").count() == 0
    r = clouds["few"].select("rid", F.col("x").alias("p")).join(df, "rid").agg(F.corr("p", "x")).first()[0]
    assert r > 0.9  # the first axis follows the correlated columns
    with pytest.raises(ValueError):
        project(df, {}, ["x", "y"])


def test_command_line(spark, tmp_path, capsys):
    from veilspark.cli import main

    assert main(["mechanisms"]) == 0 and "pairwise" in capsys.readouterr().out
    (tmp_path / "p.csv").write_text("age,city\n" + "".join(f"{i},{'ab'[i % 2]}\n" for i in range(120)))
    assert main(["infer-schema", str(tmp_path / "p.csv")]) == 0
    (tmp_path / "s.json").write_text(capsys.readouterr().out)
    assert main(["keygen", str(tmp_path)]) == 0
    private, public = capsys.readouterr().out.split()
    sheet = str(tmp_path / "sheet.json")
    assert main(["run", "--input", str(tmp_path / "p.csv"), "--schema", str(tmp_path / "s.json"), "--eps", "2", "--mechanism", "independent", "--canaries", "10", "--ledger", str(tmp_path / "l"), "--sign", private, "--output", sheet]) == 0
    assert main(["verify", sheet, "--key", public]) == 0
    (tmp_path / "bad.json").write_text(open(sheet).read().replace('"rows": 84', '"rows": 85'))
    assert main(["verify", str(tmp_path / "bad.json"), "--key", public]) == 1
