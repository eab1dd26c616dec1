"""Row-level queries: public domains, kinds, splits, controls, ledger."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import seeded
from ..operators import ledger, utility
from ..operators.generators import leaky_release
from ..operators.release import holdout_size
from ..plans.ranking import smallest
from ..schema import CATEGORICAL, NUMERICAL, ColumnSpec, PublicSchema, distinct_counts, inferred, is_number
from ..sources.tables import PUBLIC, order_summary, safe_name, table
from . import query
from .sql import ORDER_SUMMARY, sql_key, sql_uniform


@query("""
SELECT event_id, greatest(0.0, least(500.0, coalesce(value, 0.0))) AS value,
  CASE WHEN event_type IN ('click', 'error', 'purchase', 'signup', 'view') THEN event_type ELSE '__OTHER__' END AS event_type FROM events""")
def clip_public_bounds(spark, sf_dir):
    return PUBLIC["events"].clip(table(spark, sf_dir, "events"), ["event_id"])


_NARROW = PublicSchema((ColumnSpec("p_size", NUMERICAL, 5, 40), ColumnSpec("p_type", CATEGORICAL, categories=("ECONOMY", "LARGE", "SMALL"))))


@query("""
SELECT p_partkey, greatest(5.0, least(40.0, CAST(p_size AS DOUBLE))) AS p_size,
  CASE WHEN p_type IN ('ECONOMY', 'LARGE', 'SMALL') THEN p_type ELSE '__OTHER__' END AS p_type FROM part""")
def domain_sentinel(spark, sf_dir):
    return _NARROW.clip(table(spark, sf_dir, "part"), ["p_partkey"])


@query("""
SELECT p_type AS value, count(*) AS n FROM part ANTI JOIN (SELECT unnest(['ECONOMY', 'LARGE', 'SMALL']) AS v) ON p_type = v GROUP BY p_type""")
def domain_difference(spark, sf_dir):
    known = spark.createDataFrame([(v,) for v in _NARROW["p_type"].categories], "p_type string")
    return table(spark, sf_dir, "part").join(F.broadcast(known), "p_type", "left_anti").groupBy(F.col("p_type").alias("value")).agg(F.count("*").alias("n"))


_KINDS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct, {'count(DISTINCT ' + c + ') > 10' if c not in ('p_brand', 'p_type') else 'false'} AS numeric_fallback, {'count(DISTINCT ' + c + ') > 20' if c not in ('p_brand', 'p_type') else 'false'} AS numeric_inferred FROM part" for c in _KINDS
    )
)
def column_kinds(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(*_KINDS)
    numbers = [f.name for f in df.schema.fields if is_number(f)]
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_distinct"), (F.col(c) > (10 if c in numbers else 1 << 62)).alias("numeric_fallback"), (F.col(c) > (20 if c in numbers else 1 << 62)).alias("numeric_inferred")) for c in _KINDS])
    return distinct_counts(df).select(F.inline(rows))


@query("""
SELECT 'c_acctbal' AS column_name, CAST(min(c_acctbal) AS DOUBLE) + 0.0 AS lower, CAST(max(c_acctbal) AS DOUBLE) AS upper, CAST(NULL AS VARCHAR) AS levels FROM customer
UNION ALL SELECT 'c_nationkey', CAST(min(c_nationkey) AS DOUBLE), CAST(max(c_nationkey) AS DOUBLE), NULL FROM customer
UNION ALL SELECT 'c_mktsegment', NULL, NULL, string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer)""")
def infer_schema_stats(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    found = inferred(df)
    return found.select(F.col("column").alias("column_name"), "lower", "upper", F.array_join("levels", ",").alias("levels"))


@query(f"""
SELECT o_orderkey, row_number() OVER (ORDER BY {sql_key('split', 'o_orderkey')}, o_orderkey) <= greatest(20, CAST(floor((SELECT count(*) FROM orders) * 0.3) AS BIGINT)) AS holdout FROM orders""")
def holdout_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return smallest(df, seeded.key("split", "o_orderkey"), "o_orderkey", holdout_size(df.count()), name="holdout")


@query(f"""
WITH c AS (SELECT *, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {sql_key('strata', 'doc_id')}, doc_id) <= round(n * 0.2) AS test FROM c""")
def stratified_split(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return utility.class_split(df, "quality", "doc_id", "strata")


@query(f"""
SELECT c_custkey, c_acctbal FROM customer ORDER BY {sql_key('sample', 'c_custkey')}, c_custkey LIMIT 700""")
def subsample_points(spark, sf_dir):
    """The exact-size sample behind a point cloud; its limit is the feature."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return smallest(df, seeded.key("sample", "c_custkey"), "c_custkey", 700).where("chosen").drop("chosen")


@query("""
SELECT o_orderstatus, o_orderkey, o_totalprice FROM (
  SELECT o_orderstatus, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 25""")
def top_k_guessed(spark, sf_dir):
    """Top 25 by score in each group, ties in order of the key."""
    df = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    order = Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return df.withColumn("r", F.row_number().over(order)).where("r <= 25").drop("r")


@query("""
WITH per AS (SELECT c_mktsegment AS level, count(*) AS n FROM customer GROUP BY 1)
SELECT (SELECT level FROM per ORDER BY n, level LIMIT 1) AS rarest, (SELECT level FROM per ORDER BY n DESC, level LIMIT 1) AS commonest, max(n) * 1.0 / sum(n) AS top_share FROM per""")
def rarest_and_commonest(spark, sf_dir):
    per = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("level")).agg(F.count("*").alias("n"))
    return per.agg(F.min(F.struct("n", "level"))["level"].alias("rarest"), F.min(F.struct((-F.col("n")).alias("m"), "level"))["level"].alias("commonest"), (F.max("n") / F.sum("n")).alias("top_share"))


@query(r"""
SELECT p_partkey, substr(regexp_replace(regexp_replace(p_name || '.csv', '\.[^.]*$', ''), '[^\p{L}\p{N}_-]', '', 'g'), 1, 64) AS file_name, lower(ltrim('  ' || p_brand)) AS brand FROM part""")
def upload_names(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return df.select("p_partkey", safe_name(F.concat("p_name", F.lit(".csv"))).alias("file_name"), F.lower(F.ltrim(F.concat(F.lit("  "), "p_brand"))).alias("brand"))


@query("""
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS no_number FROM events""")
def coerced_numbers(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("no_number"))


_LEAK = 0.25


@query(f"""
WITH {ORDER_SUMMARY}, n AS (SELECT count(*) AS n FROM os),
k AS (SELECT *, row_number() OVER (ORDER BY {sql_key('leak', 'rid')}, rid) AS r FROM os),
ix AS (SELECT *, row_number() OVER (ORDER BY {sql_key('leaki', 'rid')}, rid) - 1 AS ix FROM os),
slot AS (SELECT unnest(range(CAST(round(n * {_LEAK}) AS BIGINT), n)) AS slot FROM n)
SELECT rid, n_lines, sum_qty, sum_price, true AS verbatim FROM k, n WHERE r <= round(n * {_LEAK})
UNION ALL SELECT -1 - slot, a.n_lines, b.sum_qty, c.sum_price, false FROM slot, n
  JOIN ix a ON a.ix = CAST(floor({sql_uniform('leakn_lines', 'slot')} * n) AS BIGINT)
  JOIN ix b ON b.ix = CAST(floor({sql_uniform('leaksum_qty', 'slot')} * n) AS BIGINT)
  JOIN ix c ON c.ix = CAST(floor({sql_uniform('leaksum_price', 'slot')} * n) AS BIGINT)""")
def leaky_control(spark, sf_dir):
    return leaky_release(order_summary(spark, sf_dir), ["n_lines", "sum_qty", "sum_price"], _LEAK)


# ------------------------------------------------------------ ledger

_LEDGER_SQL = """
WITH RECURSIVE day AS (SELECT row_number() OVER (ORDER BY d) - 1 AS seq, d, n FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1)),
chain AS (
  SELECT CAST(-1 AS BIGINT) AS seq, repeat('0', 64) AS prev_hash, repeat('0', 64) AS hash, CAST(0 AS BIGINT) AS n
  UNION ALL
  SELECT day.seq, chain.hash, sha256('{"actor": "veilspark", "dataset_id": "events", "delta": "1.00000000e-05", "entry_id": "e' || day.seq || '", "eps_spent": "' || printf('%.8f', day.n / 1000.0) || '", "mechanism_name": "laplace", "noise_scale": "1.00000000", "prev_hash": "' || chain.hash || '", "run_id": "' || strftime(d, '%Y-%m-%d') || '", "seed": 42, "sensitivity": "1.00000000", "timestamp": "' || strftime(d, '%Y-%m-%d') || '"}'), day.n
  FROM day JOIN chain ON day.seq = chain.seq + 1)
"""


def _ledger_rows(spark, sf_dir):
    """A ledger with one release a day of events, written by the single writer."""
    from ..sources.scratch import scratch_path

    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    book = ledger.Ledger(spark, scratch_path(spark, "ledger"))
    book.append([ledger.Entry("events", r["d"], "laplace", eps_spent=r["n"] / 1000, entry_id=f"e{i}", timestamp=r["d"]) for i, r in enumerate(days)])
    return book.rows()


@query(_LEDGER_SQL + "SELECT seq, prev_hash, hash, true AS link_ok, true AS hash_ok FROM chain WHERE seq >= 0")
def ledger_verify(spark, sf_dir):
    return ledger.checked(_ledger_rows(spark, sf_dir)).select("seq", "prev_hash", "hash", "link_ok", "hash_ok")


@query(_LEDGER_SQL + "SELECT count(*) AS entries, CAST((count(*) // 2) AS BIGINT) AS first_bad, CAST(count(*) - count(*) // 2 AS BIGINT) AS broken FROM chain WHERE seq >= 0")
def ledger_tamper(spark, sf_dir):
    """One changed amount in the middle; everything from there on counts as broken."""
    rows = _ledger_rows(spark, sf_dir)
    middle = rows.count() // 2
    return ledger.broken_from(rows.withColumn("eps_spent", F.when(F.col("seq") == middle, 99.0).otherwise(F.col("eps_spent"))))


@query("""
WITH day AS (SELECT CAST(ts AS DATE) AS d, count(*) / 1000.0 AS eps FROM events GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, round(eps, 4) AS eps, round(sum(eps) OVER (ORDER BY d), 4) AS running, round(eps - lag(eps, 1, 0.0) OVER (ORDER BY d), 4) AS change FROM day""")
def spend_summary(spark, sf_dir):
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.count("*") / 1000.0).alias("eps"))
    order = Window.orderBy("day")
    return days.select("day", F.round("eps", 4).alias("eps"), F.round(F.sum("eps").over(order), 4).alias("running"), F.round(F.col("eps") - F.lag("eps", 1, 0.0).over(order), 4).alias("change"))


@query("""
WITH d AS (SELECT DISTINCT c_mktsegment AS name, count(*) AS w FROM customer GROUP BY 1),
s AS (SELECT name, greatest(0, CASE WHEN name = 'BUILDING' THEN -w ELSE w END) AS w FROM d)
SELECT name, round(CASE WHEN sum(w) OVER () > 0 THEN 2.0 * w / sum(w) OVER () ELSE 2.0 / count(*) OVER () END, 10) AS eps FROM s""")
def budget_allocate(spark, sf_dir):
    """Epsilon in proportion to weights, a negative weight counting as none."""
    w = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("w"))
    w = w.withColumn("w", F.greatest(F.lit(0), F.when(F.col("name") == "BUILDING", -F.col("w")).otherwise(F.col("w"))))
    every = Window.partitionBy()
    share = F.when(F.sum("w").over(every) > 0, 2.0 * F.col("w") / F.sum("w").over(every)).otherwise(2.0 / F.count("*").over(every))
    return w.select("name", F.round(share, 10).alias("eps"))


@query("""
SELECT coalesce(a.name, b.name) AS name, CASE WHEN b.h IS NULL THEN 'missing' WHEN a.h IS NULL THEN 'new' WHEN a.h = b.h THEN 'same' ELSE 'changed' END AS status
FROM (SELECT c_custkey AS name, sha256(CAST(c_nationkey AS VARCHAR)) AS h FROM customer) a
FULL JOIN (SELECT s_suppkey AS name, sha256(CAST(s_nationkey AS VARCHAR)) AS h FROM supplier) b ON a.name = b.name""")
def manifest_compare(spark, sf_dir):
    """Two manifests of (name, sha256), customers' and suppliers' nations by number."""
    from ..sources.tables import compare_manifests

    def manifest_of(name, key, value):
        return table(spark, sf_dir, name).select(F.col(key).alias("name"), F.sha2(F.col(value).cast("string"), 256).alias("sha256"))

    return compare_manifests(manifest_of("customer", "c_custkey", "c_nationkey"), manifest_of("supplier", "s_suppkey", "s_nationkey"))
