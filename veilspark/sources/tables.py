"""Sources and sinks: tables by name, CSV with public schemas, checksums and
result manifests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CATEGORICAL, NUMERICAL, ColumnSpec, PublicSchema

_N, _C = NUMERICAL, CATEGORICAL

#: Declared public domains: fixed constants, never computed from the data.
PUBLIC: dict[str, PublicSchema] = {
    "lineitem": PublicSchema((
        ColumnSpec("l_quantity", _N, 1, 50), ColumnSpec("l_extendedprice", _N, 0, 105000), ColumnSpec("l_discount", _N, 0, 0.1), ColumnSpec("l_tax", _N, 0, 0.08),
        ColumnSpec("l_returnflag", _C, categories=("A", "N", "R")), ColumnSpec("l_linestatus", _C, categories=("F", "O")),
    )),
    "orders": PublicSchema((
        ColumnSpec("o_totalprice", _N, 0, 500000), ColumnSpec("o_orderstatus", _C, categories=("F", "O", "P")),
        ColumnSpec("o_orderpriority", _C, categories=("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")),
    )),
    "customer": PublicSchema((ColumnSpec("c_acctbal", _N, -1000, 10000), ColumnSpec("c_mktsegment", _C, categories=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))),
    "supplier": PublicSchema((ColumnSpec("s_acctbal", _N, -1000, 10000),)),
    "part": PublicSchema((ColumnSpec("p_retailprice", _N, 900, 1000), ColumnSpec("p_size", _N, 1, 50), ColumnSpec("p_type", _C, categories=("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))),
    "events": PublicSchema((ColumnSpec("value", _N, 0, 500), ColumnSpec("event_type", _C, categories=("click", "error", "purchase", "signup", "view")))),
    "documents": PublicSchema((ColumnSpec("n_chars", _N, 0, 100000), ColumnSpec("lang", _C, categories=("de", "en", "es", "fr")))),
    "labels": PublicSchema((ColumnSpec("quality", _C, categories=("0", "1")), ColumnSpec("toxic", _C, categories=("0", "1")))),
    "order_summary": PublicSchema((ColumnSpec("n_lines", _N, 1, 20), ColumnSpec("sum_qty", _N, 0, 500), ColumnSpec("sum_price", _N, 0, 1000000))),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: rid, n_lines, sum_qty, sum_price (correlated columns)."""
    lines = table(spark, sf_dir, "lineitem")
    # sums of cents are exact, so that every engine adds up to the same value
    price = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100.0
    return lines.groupBy(F.col("l_orderkey").alias("rid")).agg(F.count("*").cast("double").alias("n_lines"), F.sum("l_quantity").alias("sum_qty"), price.alias("sum_price"))


def toy(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """Independent columns age, income, category, from replayable uniforms."""
    from ..functions import seeded

    ids = spark.range(rows).withColumnRenamed("id", "rid")
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.floor(seeded.uniform(f"{seed}c", "rid") * 3) + 1).cast("int"))
    income = 50000 + 15000 * seeded.gaussian(f"{seed}i", "rid")
    return ids.select("rid", F.floor(18 + 52 * seeded.uniform(f"{seed}a", "rid")).cast("double").alias("age"), F.greatest(F.lit(0.0), income).alias("income"), letter.alias("category"))


LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: (lambda spark, sf_dir, n=name: table(spark, sf_dir, n)) for name in PUBLIC if name != "order_summary"}
LOADERS["order_summary"] = order_summary


def load(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, PublicSchema]:
    """A registered table and its public schema."""
    if name not in LOADERS:
        raise KeyError(f"unknown table {name!r}; known: {sorted(LOADERS)}")
    return LOADERS[name](spark, sf_dir), PUBLIC[name]


def from_csv(spark: SparkSession, path: str, schema: PublicSchema, null: str = "") -> DataFrame:
    """Rows of a CSV file with header, blanks around values ignored, rows with a
    null in a declared column dropped; what is no number counts as missing here."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue=null)
    schema.require(raw)
    typed = [F.col(c.name).try_cast("double").alias(c.name) if c.kind == NUMERICAL else F.col(c.name) for c in schema.columns]
    return schema.project(raw.select(*typed).na.drop("any"))


def safe_name(name):
    """File name part of an uploaded data set: letters, digits, _ and -, 64 at most."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.left(F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", ""), F.lit(64))


def manifest(spark: SparkSession, pattern: str) -> DataFrame:
    """(name, sha256) of every file that the pattern matches."""
    files = spark.read.format("binaryFile").load(pattern)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def combined_digest(rows: DataFrame) -> DataFrame:
    """One hash over all (name, sha256) rows, in order of name."""
    return rows.agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("all")).select(F.sha2(F.array_join(F.transform("all", lambda x: F.concat_ws(":", x["name"], x["sha256"])), "\n"), 256).alias("digest"))


def compare_manifests(old: DataFrame, new: DataFrame) -> DataFrame:
    """name and status (same, changed, missing, new) of a full outer join."""
    joined = old.select("name", F.col("sha256").alias("a")).join(new.select("name", F.col("sha256").alias("b")), "name", "full_outer")
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "new").when(F.col("a") == F.col("b"), "same").otherwise("changed")
    return joined.select("name", status.alias("status"))
