"""Queries over canaries, attacks and their statistics."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeded
from ..operators import attacks, audit, utility
from ..operators.generators import leaky_release
from ..schema import PublicSchema
from ..sources.scratch import materialized
from ..sources.tables import PUBLIC, order_summary, table
from . import query
from .sql import ORDER_SUMMARY, sql_key, sql_uniform

_SUMMARY = PUBLIC["order_summary"]
_NUMBERS = ["n_lines", "sum_qty", "sum_price"]
_CANARIES = 60


def canary_values(schema: PublicSchema, salt: str, ids: list[str]) -> dict[str, str]:
    """SQL of a canary's columns that the columns `ids` tell apart."""
    out = {}
    for c in schema.columns:
        if c.kind == "numerical":
            off = f"{sql_uniform(salt + 'v' + c.name, *ids)} * {audit.EDGE} * {c.width!r}"
            out[c.name] = f"CASE WHEN {sql_uniform(salt + 's' + c.name, *ids)} < 0.5 THEN {float(c.upper)!r} - {off} ELSE {float(c.lower)!r} + {off} END"
        else:
            levels = ", ".join(f"'{v}'" for v in c.categories)
            out[c.name] = f"([{levels}])[CAST(floor({sql_uniform(salt + 'c' + c.name, *ids)} * {len(c.categories)}) AS BIGINT) + 1]"
    return out


def _canary_sql(schema: PublicSchema, count: int, salt: str = "canary") -> str:
    values = ", ".join(f"{v} AS {c}" for c, v in canary_values(schema, salt, ["canary_id"]).items())
    return f"SELECT canary_id, {values} FROM (SELECT unnest(range({count})) AS canary_id)"


@query(f"""
WITH {ORDER_SUMMARY}, c AS ({_canary_sql(_SUMMARY, _CANARIES)})
SELECT rid, round(n_lines, 6) AS n_lines, round(sum_qty, 6) AS sum_qty, round(sum_price, 6) AS sum_price, false AS is_canary FROM os
UNION ALL SELECT -1 - canary_id, round(n_lines, 6), round(sum_qty, 6), round(sum_price, 6), true FROM c WHERE {sql_uniform('include', 'canary_id')} < 0.5""")
def canary_plant(spark, sf_dir):
    cans = audit.canaries(spark, _SUMMARY, _CANARIES)
    members = audit.repaired(cans.withColumn("included", audit.included())).where("included").drop("included")
    planted = audit.plant(order_summary(spark, sf_dir), members)
    return planted.select("rid", *[F.round(c, 6).alias(c) for c in _NUMBERS], "is_canary")


_MIXED = PublicSchema((*PUBLIC["lineitem"].of_kind("numerical")[:2], PUBLIC["lineitem"]["l_returnflag"], PUBLIC["lineitem"]["l_linestatus"]))
_SIMILAR = f"""
WITH c AS ({_canary_sql(_MIXED, _CANARIES)}), u AS (SELECT stddev_pop(l_quantity) AS s1, stddev_pop(l_extendedprice) AS s2 FROM lineitem),
near AS (SELECT canary_id, min(((c.l_quantity - l.l_quantity) / s1) ** 2 + ((c.l_extendedprice - l.l_extendedprice) / s2) ** 2) AS d2 FROM c, lineitem l, u GROUP BY 1),
scores AS (SELECT canary_id, 1 / (1 + sqrt(d2)) + ((SELECT count(*) FROM (SELECT DISTINCT l_returnflag AS v FROM lineitem) WHERE v = l_returnflag) + (SELECT count(*) FROM (SELECT DISTINCT l_linestatus AS v FROM lineitem) WHERE v = l_linestatus)) / 2.0 AS score FROM c JOIN near USING (canary_id)),
marked AS (SELECT canary_id, score, {sql_uniform('include', 'canary_id')} < 0.5 AS included, l_returnflag FROM scores JOIN c USING (canary_id))
"""


def _scored(spark, sf_dir):
    """Canaries over lineitem's columns, scored against the whole table."""
    cans = audit.canaries(spark, _MIXED, _CANARIES)
    scores = audit.similarity(cans, table(spark, sf_dir, "lineitem").select(*_MIXED.names), _MIXED)
    return audit.repaired(cans.select("canary_id", "l_returnflag").withColumn("included", audit.included())).join(scores, "canary_id")


@query(_SIMILAR + "SELECT canary_id, round(score, 6) AS score FROM scores")
def similarity_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("canary_id", F.round("score", 6).alias("score"))


@query(_SIMILAR + """, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, canary_id) AS r, sum(CAST(included AS INT)) OVER () AS k FROM marked)
SELECT CAST(sum(CASE WHEN r <= k AND included THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN r <= k AND NOT included THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN r > k AND included THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN r > k AND NOT included THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM r""")
def audit_confusion(spark, sf_dir):
    """The adversary names as many members as there are, best scores first."""
    k = F.sum(F.col("included").cast("int")).over(Window.partitionBy())
    r = F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "canary_id"))
    ranked = _scored(spark, sf_dir).withColumn("k", k).withColumn("r", r)
    said, is_in = F.col("r") <= F.col("k"), F.col("included")
    cells = {"tp": said & is_in, "fp": said & ~is_in, "fn": ~said & is_in, "tn": ~said & ~is_in}
    return ranked.agg(*[F.sum(c.cast("int")).alias(n) for n, c in cells.items()])


@query(_SIMILAR + """, r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, canary_id) AS r, count(*) OVER () AS m FROM marked),
g AS (SELECT *, m - CAST(round(m * 0.2) AS BIGINT) AS g FROM r)
SELECT max(m) AS m, max(g) AS n_guess, CAST(sum(CASE WHEN r <= g // 2 THEN CAST(included AS INT) WHEN r > m - (g - g // 2) THEN CAST(NOT included AS INT) ELSE 0 END) AS BIGINT) AS correct FROM g""")
def one_run_counts(spark, sf_dir):
    """Correct guesses with a fifth of the canaries, those in the middle, left out."""
    return audit.guesses(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)), abstain=0.2)


@query(_SIMILAR + """, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY round(score, 9) DESC, canary_id) AS r, count(*) OVER (PARTITION BY l_returnflag) AS m FROM marked)
SELECT l_returnflag AS level, max(m) AS m, CAST(sum(CASE WHEN r <= m // 2 THEN CAST(included AS INT) ELSE CAST(NOT included AS INT) END) AS BIGINT) AS correct FROM r GROUP BY 1""")
def subgroup_counts(spark, sf_dir):
    found = audit.guesses(_scored(spark, sf_dir).withColumn("score", F.round("score", 9)), by="l_returnflag")
    return found.select(F.col("l_returnflag").alias("level"), "m", "correct")


@query("""
WITH c AS (SELECT lang AS level, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT level, n * 1.0 / sum(n) OVER () AS share, count(*) OVER () AS k FROM c)
SELECT level, round(share, 8) AS share, CAST(floor(300 / k) AS BIGINT) AS balanced, CAST(round(300 * share) AS BIGINT) AS proportional FROM s WHERE floor(300 / k) >= 20 AND round(300 * share) >= 20""")
def subgroup_allocate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang")
    even = audit.allocate_subgroups(docs, "lang", 300).withColumnRenamed("canaries", "balanced")
    part = audit.allocate_subgroups(docs, "lang", 300, balanced=False).select("level", F.col("canaries").alias("proportional"))
    return even.join(part, "level").select("level", F.round("share", 8).alias("share"), "balanced", "proportional")


@query("""
WITH c AS (SELECT lang AS level, count(*) AS r FROM documents GROUP BY 1), a AS (SELECT level, r, power(0.05, 1.0 / r) AS a, power(0.025, 1.0 / r) AS b FROM c)
SELECT level, r, round(ln(a / (1 - a)), 6) AS one_run, round(ln(b / (1 - b)), 6) AS paired, round(greatest(1.0, ceil(ln(0.05) / ln(exp(2.0) / (1 + exp(2.0))))), 0) AS needed_for_two, r * 1e-5 > 0.1 * 0.05 AS delta_warning FROM a""")
def audit_ceiling(spark, sf_dir):
    """Largest bound that as many guesses as each subgroup has rows could show."""
    per = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("level")).agg(F.count("*").alias("r"))

    def top(alpha):
        a = F.pow(F.lit(alpha), 1.0 / F.col("r"))
        return F.round(F.log(a / (1 - a)), 6)

    needed = float(audit.canaries_needed(2.0))
    return per.select("level", "r", top(audit.ALPHA).alias("one_run"), top(audit.ALPHA / 2).alias("paired"), F.lit(needed).alias("needed_for_two"), (F.col("r") * 1e-5 > 0.1 * audit.ALPHA).alias("delta_warning"))


# ------------------------------------------------------------ attacks

_HOLD = f"""hold AS (SELECT *, row_number() OVER (ORDER BY {sql_key('attack', 'rid')}, rid) <= greatest(20, CAST(floor((SELECT count(*) FROM os) * 0.3) AS BIGINT)) AS h FROM os),
fit AS (SELECT rid, n_lines, sum_qty, sum_price FROM hold WHERE NOT h), held AS (SELECT rid, n_lines, sum_qty, sum_price FROM hold WHERE h),
k AS (SELECT *, row_number() OVER (ORDER BY {sql_key('leak', 'rid')}, rid) AS r FROM fit), nn AS (SELECT count(*) AS n FROM fit),
ix AS (SELECT *, row_number() OVER (ORDER BY {sql_key('leaki', 'rid')}, rid) - 1 AS ix FROM fit), slot AS (SELECT unnest(range(CAST(round(n * 0.5) AS BIGINT), n)) AS slot FROM nn),
rel AS (SELECT n_lines, sum_qty, sum_price FROM k, nn WHERE r <= round(n * 0.5) UNION ALL SELECT a.n_lines, b.sum_qty, c.sum_price FROM slot, nn
  JOIN ix a ON a.ix = CAST(floor({sql_uniform('leakn_lines', 'slot')} * n) AS BIGINT)
  JOIN ix b ON b.ix = CAST(floor({sql_uniform('leaksum_qty', 'slot')} * n) AS BIGINT)
  JOIN ix c ON c.ix = CAST(floor({sql_uniform('leaksum_price', 'slot')} * n) AS BIGINT)),
t AS (SELECT *, true AS member FROM (SELECT * FROM fit ORDER BY rid LIMIT 400) UNION ALL SELECT *, false FROM (SELECT * FROM held ORDER BY rid LIMIT 400)),
u AS (SELECT stddev_pop(n_lines) AS s1, stddev_pop(sum_qty) AS s2, stddev_pop(sum_price) AS s3 FROM rel)"""
_D2 = "((t.n_lines - q.n_lines) / s1) ** 2 + ((t.sum_qty - q.sum_qty) / s2) ** 2 + ((t.sum_price - q.sum_price) / s3) ** 2"
_NN = f"""
WITH {ORDER_SUMMARY}, {_HOLD}, sc AS (SELECT t.rid, member, round(1 / (1 + sqrt(min({_D2}))), 9) AS score FROM t, rel q, u GROUP BY ALL),
pt AS (SELECT score, sum(CAST(member AS INT)) AS p, sum(CAST(NOT member AS INT)) AS n, count(*) AS c FROM sc GROUP BY score),
rk AS (SELECT *, sum(c) OVER (ORDER BY score) - (c - 1) / 2.0 AS rank FROM pt),
roc AS (SELECT score, sum(p) OVER (ORDER BY score DESC) * 1.0 / sum(p) OVER () AS tpr, sum(n) OVER (ORDER BY score DESC) * 1.0 / sum(n) OVER () AS fpr FROM pt)
"""


def _setting(spark, sf_dir):
    """(fit, holdout, half-verbatim release, attacked records). The records are
    the first 400 of each kind by key: the attack's own limit."""
    from ..operators.release import holdout_size
    from ..plans.ranking import smallest

    rows = materialized(order_summary(spark, sf_dir), "summary")
    flagged = materialized(smallest(rows, seeded.key("attack", "rid"), "rid", holdout_size(rows.count()), name="h"), "split")
    fit, held = flagged.where("not h").drop("h"), flagged.where("h").drop("h")
    release = materialized(leaky_release(fit, _NUMBERS, 0.5), "release")
    targets = attacks.labelled(attacks.head(fit, "rid"), attacks.head(held, "rid"), _NUMBERS, "rid")
    return fit, held, release, materialized(targets, "targets")


def _nn_scores(spark, sf_dir):
    _, _, release, targets = _setting(spark, sf_dir)
    return materialized(attacks.nearest_scores(release, targets, _NUMBERS, "rid").withColumn("score", F.round("score", 9)), "scores")


@query(_NN + "SELECT round((sum(rank * p) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(c - p)), 8) AS auc, (SELECT round(greatest(0.0, max(tpr - fpr)), 8) FROM roc) AS advantage FROM rk")
def nn_mia_auc(spark, sf_dir):
    scores = _nn_scores(spark, sf_dir)
    return attacks.auc(scores).join(attacks.advantage(attacks.roc_points(scores))).select(F.round("auc", 8).alias("auc"), F.round("advantage", 8).alias("advantage"))


@query(_NN + "SELECT round(score, 6) AS score, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM roc")
def mia_roc_points(spark, sf_dir):
    return attacks.roc_points(_nn_scores(spark, sf_dir)).select(F.round("score", 6).alias("score"), F.round("tpr", 8).alias("tpr"), F.round("fpr", 8).alias("fpr"))


def _tpr_sql(f: float) -> str:
    return f"""SELECT CAST({f} AS DOUBLE) AS at_fpr, round(CASE WHEN b IS NULL THEN a.tpr ELSE a.tpr + ({f} - a.fpr) * (b.tpr - a.tpr) / (b.fpr - a.fpr) END, 8) AS tpr FROM
 (SELECT coalesce(max({{'fpr': fpr, 'tpr': tpr}}) FILTER (fpr <= {f}), {{'fpr': 0.0, 'tpr': 0.0}}) AS a, min({{'fpr': fpr, 'tpr': tpr}}) FILTER (fpr > {f}) AS b FROM roc)"""


@query(_NN + _tpr_sql(0.01) + " UNION ALL " + _tpr_sql(0.001))
def tpr_at_fpr(spark, sf_dir):
    points = materialized(attacks.roc_points(_nn_scores(spark, sf_dir)), "roc")
    return attacks.tpr_at(points, 0.01).unionAll(attacks.tpr_at(points, 0.001)).select("at_fpr", F.round("tpr", 8).alias("tpr"))


@query(f"""
WITH {ORDER_SUMMARY}, {_HOLD},
a AS (SELECT rid, list(sqrt(d) ORDER BY d) AS g FROM (SELECT t.rid, {_D2} AS d, row_number() OVER (PARTITION BY t.rid ORDER BY {_D2}) AS r FROM t, rel q, u) WHERE r <= 5 GROUP BY rid),
b AS (SELECT rid, list(sqrt(d) ORDER BY d) AS g FROM (SELECT t.rid, {_D2} AS d, row_number() OVER (PARTITION BY t.rid ORDER BY {_D2}) AS r FROM t, held q, u) WHERE r <= 6 GROUP BY rid)
SELECT t.rid, member, round(3 * (ln(greatest(1e-12, CASE WHEN b.g[1] <= 1e-12 THEN b.g[-1] ELSE b.g[least(5, len(b.g))] END)) - ln(greatest(1e-12, a.g[-1]))), 5) AS score FROM t JOIN a USING (rid) JOIN b USING (rid)""")
def domias_knn_scores(spark, sf_dir):
    _, held, release, targets = _setting(spark, sf_dir)
    return attacks.domias_neighbours(release, held, targets, _NUMBERS, "rid").select("rid", "member", F.round("score", 5).alias("score"))


def _kernel_sql() -> str:
    def density(rows: str) -> str:
        e = f"-({_D2}) / (2 * w * w)"
        return f"(SELECT rid, max(e) + ln(sum(exp(e - m))) - ln(max(cnt)) - 3 * ln(max(w) * sqrt(2 * pi())) AS ld FROM (SELECT t.rid, {e} AS e, max({e}) OVER (PARTITION BY t.rid) AS m, w, (SELECT count(*) FROM {rows}) AS cnt FROM t, {rows} q, u, bw) GROUP BY rid)"

    return f"""
WITH {ORDER_SUMMARY}, {_HOLD}, bw AS (SELECT greatest(1e-3, power(count(*), -1.0 / 7)) AS w FROM rel)
SELECT t.rid, member, round(a.ld - b.ld, 5) AS score FROM t JOIN {density('rel')} a USING (rid) JOIN {density('held')} b USING (rid)"""


@query(_kernel_sql())
def domias_kde_scores(spark, sf_dir):
    _, held, release, targets = _setting(spark, sf_dir)
    return attacks.domias_kernel(release, held, targets, _NUMBERS, "rid").select("rid", "member", F.round("score", 5).alias("score"))


@query(f"""
WITH {ORDER_SUMMARY}, {_HOLD}, one AS (SELECT n_lines, sum_qty, sum_price FROM rel GROUP BY ALL HAVING count(*) = 1)
SELECT count(*) AS targets, count(o.n_lines) AS unique_matches, round(count(o.n_lines) * 1.0 / greatest(1, count(*)), 8) AS risk
FROM fit LEFT JOIN one o ON fit.n_lines = o.n_lines AND fit.sum_qty = o.sum_qty AND fit.sum_price = o.sum_price""")
def exact_match_risk(spark, sf_dir):
    fit, _, release, _ = _setting(spark, sf_dir)
    return attacks.exact_matches(release, fit, _NUMBERS).select("targets", "unique_matches", F.round("risk", 8).alias("risk"))


# ------------------------------------------------------------ statistics


@query("""
WITH p AS (SELECT quality AS y, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT y AS c, count(*) FILTER (y = pred) AS tp, count(*) AS re, 0 AS said FROM p GROUP BY y UNION ALL SELECT pred, 0, 0, count(*) FROM p GROUP BY pred),
e AS (SELECT c, sum(tp) AS tp, sum(re) AS re, sum(said) AS said FROM c GROUP BY c)
SELECT round(avg(2.0 * tp / (re + said)), 8) AS macro_f1, round(sum(tp) * 1.0 / sum(re), 8) AS accuracy, round(max(re) * 1.0 / sum(re), 8) AS majority_share FROM e""")
def macro_f1(spark, sf_dir):
    """Document quality, predicted from length alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 2000).cast("int").alias("pred"))
    found = utility.macro_f1(table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("quality").alias("y"), "pred"))
    return found.select(*[F.round(c, 8).alias(c) for c in ("macro_f1", "accuracy", "majority_share")])


@query(f"""
WITH v AS (SELECT row_number() OVER (ORDER BY c_nationkey) - 1 AS pos, value FROM (SELECT c_nationkey, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1)),
n AS (SELECT count(*) AS n FROM v), d AS (SELECT i // n AS b, CAST(floor({sql_uniform('boot', 'i')} * n) AS BIGINT) AS pos FROM n, (SELECT unnest(range({utility.RESAMPLES} * (SELECT count(*) FROM v))) AS i)),
m AS (SELECT b, avg(value) AS m FROM d JOIN v USING (pos) GROUP BY b)
SELECT round((SELECT avg(value) FROM v), 4) AS mean, round((SELECT stddev_samp(value) FROM v), 4) AS sd, (SELECT n FROM n) AS n, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM m""")
def bootstrap_ci(spark, sf_dir):
    """Interval of the mean over nations of the mean balance."""
    per = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.avg("c_acctbal"), 4).alias("value"))
    values = per.select((F.row_number().over(Window.orderBy("c_nationkey")) - 1).cast("bigint").alias("pos"), "value")
    found = utility.bootstrap(values)
    return found.select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("""
WITH g AS (SELECT c_nationkey AS id, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), a AS (SELECT avg(c_acctbal) AS m FROM customer),
p AS (SELECT id, least(1.0, 2 * exp(-2.0 * n * power((g.m - a.m) / 11000.0, 2))) AS p FROM g, a),
r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS m FROM p)
SELECT id, round(p, 8) AS p, round(least(1.0, min(p * m / r) OVER (ORDER BY r DESC, id DESC ROWS UNBOUNDED PRECEDING)), 8) AS bh, round(least(1.0, p * m), 8) AS bonferroni FROM r""")
def bh_correction(spark, sf_dir):
    """Nations whose mean balance departs from the overall mean: Hoeffding
    p-values, adjusted over all nations."""
    df = table(spark, sf_dir, "customer")
    per = df.groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m")).join(df.agg(F.avg("c_acctbal").alias("a")))
    p = F.least(F.lit(1.0), 2 * F.exp(-2.0 * F.col("n") * F.pow((F.col("m") - F.col("a")) / 11000.0, 2)))
    return audit.corrected(per.select("id", p.alias("p"))).select("id", *[F.round(c, 8).alias(c) for c in ("p", "bh", "bonferroni")])


@query("""
WITH c AS (SELECT l_returnflag || '|' || l_linestatus AS cell, l_quantity AS x FROM lineitem)
SELECT cell, count(*) AS n, round(avg(x), 6) AS mean, round(max(x), 6) AS largest FROM c WHERE isfinite(x) GROUP BY cell""")
def grid_aggregation(spark, sf_dir):
    """Finite values of all cells of a grid, summed up per cell."""
    df = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus").alias("cell"), F.col("l_quantity").alias("x"))
    finite = df.where(~F.isnan("x") & (F.abs("x") < math.inf))
    return finite.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.max("x"), 6).alias("largest"))
