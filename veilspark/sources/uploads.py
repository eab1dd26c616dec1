"""Uploaded tables: a CSV file becomes a bounded sample of rows with a public schema,
given or read off the data, and an entry in a catalogue of the newest uploads."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import NUMERICAL, PublicSchema, infer_nonprivate
from .claims import append_claimed, claim
from .scratch import scratch_path
from .tables import safe_name

#: Rows kept of an upload, its bytes, uploads kept, texts that mean null.
MOST_ROWS, MOST_BYTES, KEPT = 20_000, 25 * 1024 * 1024, 8
NULLS = ("?", "")
#: Copies of one row that are counted out together.
BLOCK = 1 << 16
INFERRED = "bounds and levels were read off the data: this schema is not private"


class UploadError(ValueError):
    pass


@dataclass(frozen=True)
class Upload:
    name: str
    path: str
    schema: PublicSchema
    rows: int
    inferred: bool
    warnings: tuple[str, ...] = ()

    def table(self, spark: SparkSession) -> DataFrame:
        return self.schema.project(spark.read.parquet(self.path))


def sampled(df: DataFrame, most: int) -> DataFrame:
    """`most` rows of df, all if it has fewer, the same ones however df is dealt: those
    of the smallest hash of content and copy number. Equal rows are counted first, so a
    row that fills the table is one row of the shuffle; its copies are dealt out in
    blocks and each is drawn by itself. Tasks keep their smallest `most` before they
    are merged. Nulls are part of the content."""
    counted = df.groupBy(*df.columns).agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
    last = F.least(F.col("__n"), (F.col("__b") + 1) * BLOCK) - 1
    copies = blocks.withColumn("__copy", F.explode(F.sequence(F.col("__b") * BLOCK, last)))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit("\x00"))

    drawn = F.md5(F.concat_ws("\x1f", F.lit(""), *[text(c) for c in df.columns], F.col("__copy").cast("string")))
    return copies.withColumn("__h", drawn).orderBy("__h", "__copy").limit(most).select(*df.columns)


def _numbers(rows: DataFrame) -> list[str]:
    """The columns of texts in which everything but null is a number."""
    if not rows.columns:
        return []
    tests = [(F.count(c) > 0) & (F.count(F.col(c).try_cast("double")) == F.count(c)) for c in rows.columns]
    found = rows.agg(*[t.alias(c) for t, c in zip(tests, rows.columns, strict=True)]).first()
    return [c for c in rows.columns if found[c]]


def ingest(spark: SparkSession, path: str, name: str, schema_json: str | None = None, nulls: tuple[str, ...] = NULLS, most_rows: int = MOST_ROWS, most_bytes: int | None = MOST_BYTES) -> Upload:
    """A CSV file with a header as a stored table. Blanks around values go; the texts in
    `nulls` are null. With schema_json the columns are that schema's and a value that is
    no number is null in a numeric one; else all columns stay and their domains are read
    off the sample, with a warning. Rows with a null are dropped before rows are drawn. A
    file above most_bytes (None: no limit), a name without a letter or digit, no rows or
    a missing column raise UploadError. The file's size is read without its content."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    if most_bytes is not None and size > most_bytes:
        raise UploadError(f"{size} bytes; at most {most_bytes}")
    clean = spark.range(1).select(safe_name(F.lit(name))).first()[0]
    if not clean:
        raise UploadError(f"no letter or digit in the name {name!r}")
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    bare = raw.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*nulls), F.trim(F.col(f"`{c}`"))).alias(c) for c in raw.columns])
    if schema_json is not None:
        schema = PublicSchema.from_json(schema_json)
        missing = sorted(set(schema.names) - set(raw.columns))
        if missing:
            raise UploadError(f"columns {missing} are not in the file")
        typed = bare.select(*[F.col(c.name).try_cast("double").alias(c.name) if c.kind == NUMERICAL else F.col(c.name) for c in schema.columns])
    else:
        numbers = _numbers(bare)
        typed = bare.select(*[F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in bare.columns])
    kept = scratch_path(spark, f"upload-{clean}")
    sampled(typed.na.drop("any"), most_rows).write.parquet(kept)
    rows = spark.read.schema(typed.schema).parquet(kept)
    if not (n := rows.count()):
        raise UploadError("no row without a null")
    if schema_json is None:
        schema = infer_nonprivate(rows)
    return Upload(clean, kept, schema, n, schema_json is None, (INFERRED,) if schema_json is None else ())


class Catalogue:
    """An append-only table of uploads of which the newest `kept` names are listed: the
    first in goes first, and a name that comes again takes the place of its older self."""

    COLUMNS = "seq long, name string, path string, rows long, inferred boolean, schema string, warnings array<string>"

    def __init__(self, spark: SparkSession, path: str, kept: int = KEPT) -> None:
        self.spark, self.path, self.kept = spark, path, kept

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.COLUMNS).parquet(self.path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            return self.spark.createDataFrame([], self.COLUMNS)

    def add(self, upload: Upload, tries: int = 5) -> int:
        """Number of the new entry; writers take numbers by claims, so none is used twice."""
        for _ in range(tries):
            seq = (self._all().agg(F.max("seq")).first()[0] or 0) + 1
            if claim(self.spark, self.path, seq):
                row = (seq, upload.name, upload.path, upload.rows, upload.inferred, upload.schema.to_json(), list(upload.warnings))
                append_claimed(self.spark.createDataFrame([row], self.COLUMNS), self.path, seq)
                return seq
            time.sleep(0.5)
        raise UploadError(f"entry {seq} is being written by another")

    def entries(self) -> DataFrame:
        """The listed uploads, the newest first."""
        newest = self._all().groupBy("name").agg(F.max_by(F.struct("*"), "seq").alias("e")).select("e.*")
        return newest.orderBy(F.desc("seq")).limit(self.kept)

    def get(self, name: str) -> Upload:
        r = self.entries().where(F.col("name") == name).first()
        if r is None:
            raise UploadError(f"no upload {name!r} among the newest {self.kept}")
        return Upload(r["name"], r["path"], PublicSchema.from_json(r["schema"]), r["rows"], r["inferred"], tuple(r["warnings"]))
