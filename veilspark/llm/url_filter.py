"""URL filtering with DataFrame functions only: rules, then a list of blocked
canonical URLs behind a blocked Bloom filter.

A rule is (action, host, path); it fits its host and all subdomains where the
url's path starts with the rule's, and the longest fitting rule decides. Other
urls are looked up in the list: a Bloom filter of one 64-bit block per BLOCK_KEYS
listed urls, held as a table (block, bits), passes possible hits, and an exact
hash join with the list removes the false positives. Both joins go by their key,
block and url; Spark broadcasts the filter or the list where its size allows.
The pages are read once, by one chain of two joins.

Edge cases: a null url or one without `://` has an empty host and path, fits no
rule and is not listed, so it is allowed; repeated rows stay; very long urls are
judged whole; an empty table gives no row and an empty list blocks nothing; other
columns of the pages are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: The rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_KEYS = 4
PROBES = 6
#: Pages with less html than this put their canonical url on the query's list.
THIN_BYTES = 1000


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host, path and canonical (null without `://`) of the url."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    raw = F.regexp_extract("__rest", "^[^/?#]*", 0)
    tail = F.substr(F.col("__rest"), F.length("__raw") + 1)
    query = F.regexp_extract("__tail", "^[^?#]*\\?([^#]*)", 1)
    clean = F.regexp_replace(F.regexp_replace(query, "(^|&)utm_[^&]*", ""), "^&", "")
    site = F.regexp_replace(F.col("host"), "^(www|m)\\.", "")
    page = F.regexp_replace(F.col("path"), "/+$", "")
    return (
        df.withColumn("__rest", rest)
        .withColumn("__raw", raw)
        .withColumn("__tail", tail)
        .withColumn("host", F.translate("__raw", UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__tail", "^[^?#]*", 0))
        .withColumn("canonical", F.when(at > 0, F.concat(site, page, F.when(clean != "", F.concat(F.lit("?"), clean)).otherwise(""))))
        .drop("__rest", "__raw", "__tail")
    )


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its action; null where none fits."""
    name = action = None
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2]), reverse=True):
        fits = ((F.col("host") == host) | F.endswith("host", F.lit("." + host))) & F.startswith("path", F.lit(path))
        name = F.when(fits, host + path) if name is None else name.when(fits, host + path)
        action = F.when(fits, verdict) if action is None else action.when(fits, verdict)
    return name, action


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("canonical"), F.lit(blocks))


def _masked(df: DataFrame, blocks: int) -> DataFrame:
    """df with its canonical url's block number and bits in that block."""
    bits = F.lit(0).cast("bigint")
    for k in range(PROBES):
        bits = bits.bitwiseOR(F.expr(f"shiftleft(1L, cast(shiftright(__mixed, {6 * k}) & 63 as int))"))
    mixed = df.withColumn("__mixed", F.xxhash64("canonical", F.lit(1)))
    return mixed.withColumn("__bits", bits).withColumn("__block", _block(blocks)).drop("__mixed")


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url) and a list
    with the column `canonical`."""
    listed = materialize(listed.where("canonical is not null").select("canonical").distinct(), "listed")
    blocks = max(1, listed.count() // BLOCK_KEYS + 1)
    bloom = _masked(listed, blocks).groupBy("__block").agg(F.bit_or("__bits").alias("__filter"))
    name, action = rule_columns(rules)
    parts = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    probed = _masked(parts.withColumn("rule", name).withColumn("__action", action), blocks).join(bloom, "__block", "left")
    may = F.col("__action").isNull() & F.col("canonical").isNotNull() & (F.col("__filter").bitwiseAND(F.col("__bits")) == F.col("__bits"))
    # other pages ask for a key of their own, so that they neither match nor crowd one task
    asked = probed.withColumn("__may", F.coalesce(may, F.lit(False))).withColumn("__key", F.when(F.col("__may"), F.col("canonical")).otherwise(F.concat_ws(" ", F.lit("page"), "page_id")))
    found = asked.join(listed.select(F.col("canonical").alias("__key"), F.lit(True).alias("__in")), "__key", "left")
    listed_too = F.col("__may") & F.col("__in").isNotNull()
    return found.select("page_id", "host", "path", "rule", F.coalesce("__action", F.when(listed_too, "block").otherwise("allow")).alias("verdict"))


def thin_pages(pages: DataFrame, least: int = THIN_BYTES) -> DataFrame:
    """Canonical urls of the pages with little or no html: the query's list."""
    return with_parts(pages.where(F.coalesce(F.octet_length("html"), F.lit(0)) < least).select("url")).select("canonical")
