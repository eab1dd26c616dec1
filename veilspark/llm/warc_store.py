"""Content-addressed WARC archive.

An archive is two Parquet tables in one folder: `payloads` holds the bytes of
every different payload once under its SHA-256, `headers` holds the exact header
block of every record with the digest of its payload. Records are rebuilt by a
join on the digest; reading recomputes the SHA-256 of every stored payload and
fails on a mismatch, and checks the SHA-1 that the header declares.

Of records with equal payloads of at least REVISIT_BYTES the one with the
largest id is the response and the others are revisits that refer to it; rows
that share the largest id are all responses. A page shared by a third of all
rows is reduced to one payload before the shuffle (partial aggregation), and
its header rows meet one row of the payload side in a join that AQE can split.

A very long payload stays one value (a row of Parquet, up to 2 GB).

Edge cases: a table without rows is an archive without records; other columns of the
pages are ignored, whatever their names; null html is an empty payload; a null url leaves out its header
line; a null id is written as an empty id, never the largest.
"""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch_root

REVISIT_BYTES = 1000
CRLF = "\r\n"
_ID = "urn:page:"


def _payload() -> Column:
    return F.coalesce(F.encode("html", "UTF-8"), F.lit("").cast("binary"))


def _header(kind: Column, refers_to: Column, date: str) -> Column:
    """Exact header block of a record, as a string of \\r\\n lines."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise("")

    url = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    is_revisit = kind == "revisit"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Refers-To", F.when(is_revisit, F.concat(F.lit(f"<{_ID}"), refers_to.cast("string"), F.lit(">")))),
        line("WARC-Profile", F.when(is_revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(is_revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, date: str | None = None) -> None:
    """Write pages (page_id, url, html) as an archive below `path`; `date` is the
    WARC-Date of all records, by default the time of writing."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload().alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = materialize(rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes")), "warc")
    large = known.where(F.col("payload_bytes") >= REVISIT_BYTES)
    keeper = large.groupBy("digest").agg(F.max("page_id").alias("keeper"))
    kind = F.when(F.col("page_id").eqNullSafe(F.col("keeper")), "response").otherwise("revisit")
    linked = large.join(keeper, "digest").withColumn("kind", kind)
    single = known.where(F.col("payload_bytes") < REVISIT_BYTES).withColumn("keeper", F.lit(None).cast("long")).withColumn("kind", F.lit("response"))
    every = linked.unionByName(single)
    every.select("page_id", "digest", F.encode(_header(F.col("kind"), F.col("keeper"), date), "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The records' parsed header blocks with the digest of their payload."""
    text = F.decode("header", "UTF-8")  # (?d): only \n ends a line

    def value(pattern: str) -> Column:
        return F.regexp_extract(text, "(?dm)^" + pattern, 1)

    def number(pattern: str) -> Column:
        return F.when(value(pattern) != "", value(pattern)).cast("long")

    return spark.read.schema("page_id long, digest string, header binary").parquet(f"{path}/headers").select(
        number("WARC-Record-ID: <urn:page:(-?[0-9]*)>").alias("page_id"),
        value("WARC-Type: ([a-z]+)").alias("record_type"),
        number("WARC-Refers-To: <urn:page:(-?[0-9]+)>").alias("refers_to"),
        value("WARC-Payload-Digest: sha1:([0-9a-f]+)").alias("declared"),
        number("Content-Length: ([0-9]+)").alias("length"),
        "digest",
        "header",
    )


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(digest, payload) with every digest verified."""
    rows = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    bad = F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("string")
    return rows.select(F.when(F.sha2("payload", 256) == F.col("digest"), F.col("digest")).otherwise(bad).alias("digest"), "payload")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, record_type, refers_to, payload (the full one, of revisits too),
    payload_digest (its SHA-1), and record: the original bytes, a header block and
    the block of Content-Length bytes, which a revisit does not have. A declared
    digest or length that differs is an error."""
    joined = read_headers(spark, path).join(read_payloads(spark, path), "digest")
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))

    def checked(declared: str, found: Column, value: Column) -> Column:
        return F.when(F.col(declared).eqNullSafe(found), value).otherwise(F.raise_error(F.concat(F.lit(f"declared {declared} differs for "), F.col("digest"))))

    sha1 = F.sha1("payload")
    whole = F.concat(F.col("header"), body, F.lit(CRLF + CRLF).cast("binary"))
    record = checked("length", F.octet_length(body).cast("long"), whole)
    return joined.select("page_id", "record_type", "refers_to", "payload", checked("declared", sha1, sha1).alias("payload_digest"), record.cast("binary").alias("record"))


def archive_digest(pages: DataFrame) -> DataFrame:
    """Write an archive of pages in the shared folder, rebuild every record from
    it, and report per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{scratch_root(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(pages, path)
    rebuilt = F.octet_length("record") > 0
    return read_records(spark, path).where(rebuilt).select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
