"""Queries over counts: marginals, moments, noisy domains, synthesis."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeded
from ..operators import utility
from ..operators.accounting import BudgetSplit, calibrate
from ..operators.generators import ONE_WAY_BINS, TREE_BINS, Independent, Pairwise, normalised
from ..operators.profile import threshold
from ..plans.marginals import MarginalPlan, category_counts, level_codes, level_counts, numeric_histogram
from ..schema import PublicSchema
from ..sources.tables import PUBLIC, order_summary, table
from ..streaming.windows import noisy_window_counts
from . import query
from .sql import ORDER_SUMMARY, bin_of, sql_discrete_laplace, sql_uniform

_LINES = PUBLIC["lineitem"]
_SUMMARY = PUBLIC["order_summary"]
_NUMBERS = ["n_lines", "sum_qty", "sum_price"]


@query("""
WITH h AS (SELECT least(9, CAST(floor((l_quantity - 5.0) / 40.0 * 10) AS INTEGER)) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 5 AND 45 GROUP BY 1)
SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM range(10) r(b) LEFT JOIN h ON h.bin = b""")
def marginal_numeric(spark, sf_dir):
    return numeric_histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 5.0, 45.0, ONE_WAY_BINS)


_RELEASED = ("1-URGENT", "3-MEDIUM", "5-LOW", "6-NEVER")


@query("""
SELECT level, count(o_orderkey) AS n FROM (SELECT unnest(['1-URGENT', '3-MEDIUM', '5-LOW', '6-NEVER']) AS level) LEFT JOIN orders ON o_orderpriority = level GROUP BY level""")
def marginal_categorical(spark, sf_dir):
    return category_counts(table(spark, sf_dir, "orders"), "o_orderpriority", _RELEASED)


@query("""
SELECT a, b, count(l_orderkey) AS n FROM (SELECT * FROM (SELECT unnest(['A', 'N', 'R']) AS a) CROSS JOIN (SELECT unnest(['F', 'O']) AS b)) LEFT JOIN lineitem ON l_returnflag = a AND l_linestatus = b GROUP BY a, b""")
def contingency_2way(spark, sf_dir):
    levels = spark.createDataFrame([(x, y) for x in _LINES["l_returnflag"].categories for y in _LINES["l_linestatus"].categories], "a string, b string")
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).agg(F.count("*").alias("n"))
    return levels.join(seen, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


_PLAN = MarginalPlan((("l_returnflag",), ("l_linestatus",), ("l_quantity",), ("l_discount",), ("l_returnflag", "l_linestatus"), ("l_quantity", "l_discount"), ("l_returnflag", "l_quantity")))


def _plan_sql() -> str:
    code = {
        "l_returnflag": "coalesce(list_position(['A', 'N', 'R'], l_returnflag), 0) - 1",
        "l_linestatus": "coalesce(list_position(['F', 'O'], l_linestatus), 0) - 1",
        "l_quantity": bin_of("l_quantity", 1, 50, TREE_BINS),
        "l_discount": bin_of("l_discount", 0, 0.1, TREE_BINS),
    }
    parts = [f"SELECT '{'|'.join(q)}' AS clique, CAST({code[q[0]]} AS INTEGER) AS a, {'CAST(' + code[q[1]] + ' AS INTEGER)' if len(q) > 1 else 'CAST(NULL AS INTEGER)'} AS b, count(*) AS n FROM lineitem GROUP BY 2, 3" for q in _PLAN.cliques]
    return " UNION ALL ".join(parts)


@query(_plan_sql())
def all_marginals_grouping_sets(spark, sf_dir):
    schema = PublicSchema(tuple(_LINES[c] for c in ("l_returnflag", "l_linestatus", "l_quantity", "l_discount")))
    return _PLAN.counts(level_codes(table(spark, sf_dir, "lineitem"), schema, TREE_BINS))


_MOMENTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd FROM (SELECT greatest({float(_LINES[c].lower)!r}, least({float(_LINES[c].upper)!r}, {c})) AS x FROM lineitem)" for c in _MOMENTS))
def clipped_moments(spark, sf_dir):
    df = _LINES.clip(table(spark, sf_dir, "lineitem"))
    one = df.agg(*[f(c).alias(k + c) for c in _MOMENTS for k, f in (("m", F.avg), ("s", F.stddev_samp))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.round(F.col("m" + c), 6).alias("mean"), F.round(F.col("s" + c), 6).alias("sd")) for c in _MOMENTS])
    return one.select(F.inline(rows))


def _modal_sql() -> str:
    one = "SELECT '{c}' AS column_name, round((SELECT max(k) * 1.0 / sum(k) FROM (SELECT count(*) AS k FROM os GROUP BY {c})), 8) AS modal_share, round(stddev_samp({c}), 4) AS spread, stddev_samp({c}) > 0 AND (SELECT max(k) * 1.0 / sum(k) FROM (SELECT count(*) AS k FROM os GROUP BY {c})) <= 0.85 AS informative FROM os"
    return f"WITH {ORDER_SUMMARY} " + " UNION ALL ".join(one.format(c=c) for c in _NUMBERS)


@query(_modal_sql())
def modal_share(spark, sf_dir):
    found = utility.modal_shares(order_summary(spark, sf_dir), _NUMBERS)
    return found.select(F.col("column").alias("column_name"), F.round("modal_share", 8).alias("modal_share"), F.round("spread", 4).alias("spread"), "informative")


@query(f"""
WITH {ORDER_SUMMARY}
SELECT 'n_lines' AS a, 'sum_qty' AS b, round(corr(n_lines, sum_qty), 6) AS r FROM os UNION ALL
SELECT 'n_lines', 'sum_price', round(corr(n_lines, sum_price), 6) FROM os UNION ALL
SELECT 'sum_qty', 'sum_price', round(corr(sum_qty, sum_price), 6) FROM os""")
def corr_matrix(spark, sf_dir):
    return utility.correlations(order_summary(spark, sf_dir), _NUMBERS).select("a", "b", F.round("r", 6).alias("r"))


@query("""
WITH r AS (SELECT avg(l_quantity) AS m1, avg(l_extendedprice) AS m2, stddev_samp(l_quantity) AS s1, stddev_samp(l_extendedprice) AS s2 FROM lineitem WHERE l_linestatus = 'F'),
t AS (SELECT avg(l_quantity) AS m1, avg(l_extendedprice) AS m2 FROM lineitem WHERE l_linestatus = 'O')
SELECT round((abs(r.m1 - t.m1) / (s1 + 1e-5) + abs(r.m2 - t.m2) / (s2 + 1e-5)) / 2, 8) AS mean_shift FROM r, t""")
def mean_shift(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    found = utility.mean_shift(df.where("l_linestatus = 'F'"), df.where("l_linestatus = 'O'"), ["l_quantity", "l_extendedprice"])
    return found.select(F.round("mean_shift", 8).alias("mean_shift"))


# ------------------------------------------------------------ noisy counts

_DOMAIN_SCALE = calibrate(0.5, mechanism="laplace", steps=1)


@query(f"""
WITH c AS (SELECT source AS level, count(*) AS n FROM documents GROUP BY 1), z AS (SELECT level, n, n + {sql_discrete_laplace(_DOMAIN_SCALE, 'domain', 'level')} AS noisy FROM c)
SELECT level, n, noisy, noisy >= {threshold(_DOMAIN_SCALE)!r} AS kept FROM z""")
def dp_domain_threshold(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("level")).agg(F.count("*").alias("n"))
    noisy = counts.withColumn("noisy", F.col("n") + seeded.discrete_laplace(_DOMAIN_SCALE, "domain", "level"))
    return noisy.withColumn("kept", F.col("noisy") >= threshold(_DOMAIN_SCALE))


_RANGE_SCALE = calibrate(0.5, mechanism="laplace", steps=2)


@query(f"""
SELECT min(l_extendedprice) + {sql_discrete_laplace(_RANGE_SCALE, 'range', "'lo'")} AS lower,
  greatest(min(l_extendedprice) + {sql_discrete_laplace(_RANGE_SCALE, 'range', "'lo'")} + 1.0, max(l_extendedprice) + {sql_discrete_laplace(_RANGE_SCALE, 'range', "'hi'")}) AS upper FROM lineitem""")
def dp_range(spark, sf_dir):
    one = table(spark, sf_dir, "lineitem").agg(F.min("l_extendedprice").alias("a"), F.max("l_extendedprice").alias("b"))
    low = F.col("a") + seeded.discrete_laplace(_RANGE_SCALE, "range", F.lit("lo"))
    return one.select(low.alias("lower"), F.greatest(low + 1.0, F.col("b") + seeded.discrete_laplace(_RANGE_SCALE, "range", F.lit("hi"))).alias("upper"))


_ONE_SCALE = calibrate(1.0, mechanism="laplace", steps=1)


@query(f"""
SELECT level, greatest(0, count(l_orderkey) + {sql_discrete_laplace(_ONE_SCALE, 'one', 'level')}) AS noisy FROM (SELECT unnest(['A', 'N', 'R']) AS level) LEFT JOIN lineitem ON l_returnflag = level GROUP BY level""")
def dp_marginal_1way(spark, sf_dir):
    counts = category_counts(_LINES.clip(table(spark, sf_dir, "lineitem")), "l_returnflag", _LINES["l_returnflag"].categories)
    return counts.select("level", F.greatest(F.lit(0), F.col("n") + seeded.discrete_laplace(_ONE_SCALE, "one", "level")).alias("noisy"))


@query(f"""
WITH c AS (SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H%M%S') AS w, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2)
SELECT w, kind, greatest(0, n + {sql_discrete_laplace(_ONE_SCALE, 'window', 'w', 'kind')}) AS n FROM c""")
def dp_window_counts(spark, sf_dir):
    found = noisy_window_counts(table(spark, sf_dir, "events"), _ONE_SCALE)
    return found.select(F.date_format("start", "yyyyMMddHHmmss").alias("w"), "kind", "n")


# ------------------------------------------------------------ synthesis

_EPS = BudgetSplit.of(2.0).synthesis_eps
_TREE_SCALE = calibrate(_EPS, mechanism="laplace", steps=3)


def _noisy_tables(spark, sf_dir, cliques, bins, scale):
    from ..operators.noise import SeededNoise

    tables = MarginalPlan(cliques).tables(level_codes(order_summary(spark, sf_dir), _SUMMARY, bins), level_counts(_SUMMARY, bins))
    return {q: np.maximum(0, t + np.reshape(SeededNoise("").laplace(scale, t.size, "|".join(q)), t.shape)) for q, t in tables.items()}


def _noisy_sql(q: tuple[str, ...], bins: int, scale: float) -> str:
    """(a, b, noisy) of all cells of a clique; the cell number is the noise's id."""
    spec = [_SUMMARY[c] for c in q]
    codes = [bin_of(c.name, c.lower, c.upper, bins) for c in spec]
    salt = "|".join(q)
    if len(q) == 1:
        return f"SELECT i AS b, greatest(0, coalesce(n, 0) + {sql_discrete_laplace(scale, salt, 'i')}) AS noisy FROM range({bins}) r(i) LEFT JOIN (SELECT {codes[0]} AS x, count(*) AS n FROM os GROUP BY 1) ON x = i"
    return f"SELECT i // {bins} AS a, i % {bins} AS b, greatest(0, coalesce(n, 0) + {sql_discrete_laplace(scale, salt, 'i')}) AS noisy FROM range({bins * bins}) r(i) LEFT JOIN (SELECT {codes[0]} * {bins} + {codes[1]} AS x, count(*) AS n FROM os GROUP BY 1) ON x = i"


@query(f"""
WITH {ORDER_SUMMARY}, c AS ({_noisy_sql(('n_lines', 'sum_qty'), TREE_BINS, _TREE_SCALE)})
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, round(CASE WHEN sum(noisy) OVER (PARTITION BY a) > 0 THEN noisy * 1.0 / sum(noisy) OVER (PARTITION BY a) ELSE 1.0 / {TREE_BINS} END, 9) AS p FROM c""")
def pairwise_conditionals(spark, sf_dir):
    q = ("n_lines", "sum_qty")
    schema = PublicSchema(tuple(_SUMMARY[c] for c in q))
    counts = MarginalPlan((q,)).counts(level_codes(order_summary(spark, sf_dir), schema, TREE_BINS)).select((F.col("a") * TREE_BINS + F.col("b")).alias("cell"), "n")
    cells = spark.range(TREE_BINS**2).select(F.col("id").alias("cell")).join(counts, "cell", "left")
    noisy = F.greatest(F.lit(0), F.coalesce("n", F.lit(0)) + seeded.discrete_laplace(_TREE_SCALE, "|".join(q), "cell"))
    row = Window.partitionBy("a")
    table_ = cells.select(F.floor(F.col("cell") / TREE_BINS).cast("int").alias("a"), (F.col("cell") % TREE_BINS).cast("int").alias("b"), noisy.alias("noisy"))
    p = F.when(F.sum("noisy").over(row) > 0, F.col("noisy") / F.sum("noisy").over(row)).otherwise(1.0 / TREE_BINS)
    return table_.select("a", "b", F.round(p, 9).alias("p"))


def _value_sql(c: str, level: str, bins: int) -> str:
    spec = _SUMMARY[c]
    return f"round({float(spec.lower)!r} + ({level} + {sql_uniform('0v' + c, 'rid')}) * {spec.width / bins!r}, 6)"


def _independent_sql() -> str:
    ctes = [ORDER_SUMMARY]
    for c in _NUMBERS:
        ctes.append(f"k_{c} AS ({_noisy_sql((c,), ONE_WAY_BINS, _TREE_SCALE)})")
        ctes.append(f"p_{c} AS (SELECT b, CASE WHEN sum(noisy) OVER () > 0 THEN noisy * 1.0 / sum(noisy) OVER () ELSE 1.0 / {ONE_WAY_BINS} END AS p FROM k_{c})")
        ctes.append(f"c_{c} AS (SELECT list(s ORDER BY b) AS cdf FROM (SELECT b, sum(p) OVER (ORDER BY b) AS s FROM p_{c}))")
    draw = lambda c: f"least({ONE_WAY_BINS - 1}, len(list_filter(c_{c}.cdf, lambda x: x <= {sql_uniform('0l' + c, 'rid')})))"
    return f"WITH {', '.join(ctes)} SELECT rid, {', '.join(_value_sql(c, draw(c), ONE_WAY_BINS) + ' AS ' + c for c in _NUMBERS)} FROM (SELECT unnest(range((SELECT count(*) FROM os))) AS rid), {', '.join('c_' + c for c in _NUMBERS)}"


@query(_independent_sql())
def synth_independent(spark, sf_dir):
    made = Independent(0)
    tables = _noisy_tables(spark, sf_dir, tuple((c,) for c in _NUMBERS), ONE_WAY_BINS, _TREE_SCALE)
    made.schema, made.probabilities = _SUMMARY, {q[0]: normalised(t) for q, t in tables.items()}
    rows = made.generate(spark, order_summary(spark, sf_dir).count())
    return rows.select("rid", *[F.round(c, 6).alias(c) for c in _NUMBERS])


def _pairwise_sql() -> str:
    B = TREE_BINS
    ctes = [ORDER_SUMMARY, f"k0 AS ({_noisy_sql(('n_lines',), B, _TREE_SCALE)})"]
    ctes.append(f"c0 AS (SELECT list(s ORDER BY b) AS cdf FROM (SELECT b, sum(p) OVER (ORDER BY b) AS s FROM (SELECT b, CASE WHEN sum(noisy) OVER () > 0 THEN noisy * 1.0 / sum(noisy) OVER () ELSE 1.0 / {B} END AS p FROM k0)))")
    for i, q in enumerate((("n_lines", "sum_qty"), ("sum_qty", "sum_price")), 1):
        ctes.append(f"k{i} AS ({_noisy_sql(q, B, _TREE_SCALE)})")
        ctes.append(f"c{i} AS (SELECT a, list(s ORDER BY b) AS cdf FROM (SELECT a, b, sum(p) OVER (PARTITION BY a ORDER BY b) AS s FROM (SELECT a, b, CASE WHEN sum(noisy) OVER (PARTITION BY a) > 0 THEN noisy * 1.0 / sum(noisy) OVER (PARTITION BY a) ELSE 1.0 / {B} END AS p FROM k{i})) GROUP BY a)")
    draw = lambda c: f"least({B - 1}, len(list_filter(cdf, lambda x: x <= {sql_uniform('0l' + c, 'rid')})))"
    ctes.append(f"s0 AS (SELECT rid, {draw('n_lines')} AS l0 FROM (SELECT unnest(range((SELECT count(*) FROM os))) AS rid), c0)")
    ctes.append(f"s1 AS (SELECT rid, l0, {draw('sum_qty')} AS l1 FROM s0 JOIN c1 ON c1.a = l0)")
    ctes.append(f"s2 AS (SELECT rid, l0, l1, {draw('sum_price')} AS l2 FROM s1 JOIN c2 ON c2.a = l1)")
    return f"WITH {', '.join(ctes)} SELECT rid, {', '.join(_value_sql(c, f'l{i}', B) + ' AS ' + c for i, c in enumerate(_NUMBERS))} FROM s2"


def replayed_pairwise(spark, sf_dir):
    """The pairwise mechanism over order_summary with replayable noise."""
    made = Pairwise(0)
    made.schema, made.edges = _SUMMARY, [("n_lines", "sum_qty"), ("sum_qty", "sum_price")]
    made._set(_noisy_tables(spark, sf_dir, (("n_lines",), *made.edges), TREE_BINS, _TREE_SCALE))
    return made.generate(spark, order_summary(spark, sf_dir).count())


@query(_pairwise_sql())
def synth_pairwise(spark, sf_dir):
    return replayed_pairwise(spark, sf_dir).select("rid", *[F.round(c, 6).alias(c) for c in _NUMBERS])


_PAIRS = (("n_lines", "sum_qty"), ("n_lines", "sum_price"), ("sum_qty", "sum_price"))
_PICK = calibrate(0.5, mechanism="laplace", sensitivity=2.0, steps=1)


def _noisy_max_sql() -> str:
    parts, B = [], TREE_BINS
    for x, y in _PAIRS:
        a, b = bin_of(x, _SUMMARY[x].lower, _SUMMARY[x].upper, B), bin_of(y, _SUMMARY[y].lower, _SUMMARY[y].upper, B)
        parts.append(f"SELECT '{x}|{y}' AS clique, i // {B} AS a, i % {B} AS b, coalesce(n, 0) AS n FROM range({B * B}) r(i) LEFT JOIN (SELECT {a} * {B} + {b} AS c, count(*) AS n FROM os GROUP BY 1) ON c = i")
    return f"""WITH {ORDER_SUMMARY}, cells AS ({' UNION ALL '.join(parts)}),
e AS (SELECT clique, abs(n - sum(n) OVER (PARTITION BY clique, a) * 1.0 * sum(n) OVER (PARTITION BY clique, b) / sum(n) OVER (PARTITION BY clique)) AS err FROM cells),
s AS (SELECT clique, sum(err) AS score FROM e GROUP BY clique),
z AS (SELECT clique, score, score + {sql_discrete_laplace(_PICK, 'pick', 'clique')} AS noisy FROM s)
SELECT clique, round(score, 4) AS score, noisy = max(noisy) OVER () AS chosen FROM z"""


@query(_noisy_max_sql())
def noisy_max_select(spark, sf_dir):
    """Each pair's L1 distance from independence, and the noisy maximum."""
    B = TREE_BINS
    counts = MarginalPlan(_PAIRS).counts(level_codes(order_summary(spark, sf_dir), _SUMMARY, B))
    domain = spark.createDataFrame([("|".join(q), i, j) for q in _PAIRS for i in range(B) for j in range(B)], "clique string, a int, b int")
    cells = domain.join(counts, ["clique", "a", "b"], "left").select("clique", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))
    total = lambda *c: F.sum("n").over(Window.partitionBy("clique", *c))
    err = F.abs(F.col("n") - total("a") * 1.0 * total("b") / total())
    scores = cells.withColumn("err", err).groupBy("clique").agg(F.sum("err").alias("score"))
    noisy = scores.withColumn("noisy", F.col("score") + seeded.discrete_laplace(_PICK, "pick", "clique"))
    return noisy.select("clique", F.round("score", 4).alias("score"), (F.col("noisy") == F.max("noisy").over(Window.partitionBy())).alias("chosen"))


@query(f"""
WITH {ORDER_SUMMARY}, r AS (SELECT min(n_lines) AS lo, max(n_lines) AS hi, count(*) AS n FROM os),
t AS (SELECT 'real' AS side, n_lines AS x FROM os UNION ALL SELECT 'other', CAST(l_linenumber AS DOUBLE) FROM lineitem),
k AS (SELECT side, CAST(least(23, floor((x - lo) / (hi - lo) * 24)) AS INTEGER) AS bin, count(*) AS c FROM t, r WHERE x BETWEEN lo AND hi GROUP BY 1, 2),
m AS (SELECT side, count(*) AS m FROM t GROUP BY 1),
g AS (SELECT side, m, CAST(b AS INTEGER) AS bin FROM m, range(24) q(b))
SELECT g.side, g.bin, round(coalesce(c, 0) * 1.0 / m, 9) AS share, round(1 - sum(coalesce(c, 0)) OVER (PARTITION BY g.side) * 1.0 / m, 9) AS out_of_range FROM g LEFT JOIN k ON k.side = g.side AND k.bin = g.bin""")
def marginal_histograms(spark, sf_dir):
    """Shares per bin of two tables on the first one's observed range."""
    real = order_summary(spark, sf_dir).select(F.lit("real").alias("side"), F.col("n_lines").alias("x"))
    other = table(spark, sf_dir, "lineitem").select(F.lit("other").alias("side"), F.col("l_linenumber").cast("double").alias("x"))
    span = real.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    both = real.unionAll(other).join(F.broadcast(span))
    at = F.least(F.lit(23), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 24).cast("int"))
    per = both.groupBy("side", F.when(F.col("x").between(F.col("lo"), F.col("hi")), at).alias("bin")).agg(F.count("*").alias("c"))
    whole = per.groupBy("side").agg(F.sum("c").alias("m"), F.coalesce(F.sum(F.when(F.col("bin").isNotNull(), F.col("c"))), F.lit(0)).alias("inside"))
    grid = whole.join(F.broadcast(spark.range(24).select(F.col("id").cast("int").alias("bin"))))
    found = grid.join(per.where("bin is not null"), ["side", "bin"], "left")
    return found.select("side", "bin", F.round(F.coalesce("c", F.lit(0)) / F.col("m"), 9).alias("share"), F.round(1 - F.col("inside") / F.col("m"), 9).alias("out_of_range"))

