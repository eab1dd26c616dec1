"""Hash-chained ledger of releases, and signatures.

The chain lives in an append-only Parquet table and is verified as a query: each
row's hash over its canonical text, and its link to the row before. A writer takes
the number of its first entry by a claim before it writes, so that two writers who
read the same head cannot both append to it and fork the chain.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
import uuid
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.claims import append_claimed, claim, give_up

#: What the first entry links to, and the fields of an entry.
GENESIS = "0" * 64
FIELDS = "seq long, entry_id string, prev_hash string, timestamp string, dataset_id string, run_id string, mechanism_name string, sensitivity double, noise_scale double, eps_spent double, delta double, seed long, actor string, signature string, hash string"


@dataclass(frozen=True)
class Entry:
    dataset_id: str
    run_id: str
    mechanism_name: str
    sensitivity: float = 1.0
    noise_scale: float = 1.0
    eps_spent: float = 0.0
    delta: float = 1e-5
    seed: int = 42
    actor: str = "veilspark"
    entry_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    timestamp: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    prev_hash: str = GENESIS

    def __post_init__(self) -> None:
        if any(c < " " or c == "\x7f" for v in asdict(self).values() if isinstance(v, str) for c in v):
            raise ValueError("an entry's texts hold no control characters")

    def canonical(self) -> bytes:
        """Sorted-key JSON of what the hash covers; numbers in fixed formats."""
        data = asdict(self)
        for name in ("sensitivity", "noise_scale", "eps_spent"):
            data[name] = f"{data[name]:.8f}"
        data["delta"] = f"{self.delta:.8e}"
        return json.dumps(data, sort_keys=True, ensure_ascii=False).encode()

    def digest(self) -> str:
        return hashlib.sha256(self.canonical()).hexdigest()


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))


def canonical_column() -> Column:
    """The canonical text of an entry as an expression over its columns."""
    parts = {n: _quoted(F.col(n)) for n in ("actor", "dataset_id", "entry_id", "mechanism_name", "prev_hash", "run_id", "timestamp")}
    parts |= {n: _quoted(F.format_string("%.8f", F.col(n))) for n in ("eps_spent", "noise_scale", "sensitivity")}
    parts |= {"delta": _quoted(F.format_string("%.8e", F.col("delta"))), "seed": F.col("seed").cast("string")}
    pieces = [F.concat(F.lit(f'"{n}": '), parts[n]) for n in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pieces), F.lit("}"))


class HeadMoved(Exception):
    """Another writer appended, or is about to."""


class Ledger:
    """Append-only Parquet table; one of several writers appends at a time."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def rows(self, dataset_id: str | None = None) -> DataFrame:
        """Entries in order, of one data set if given."""
        try:
            df = self.spark.read.schema(FIELDS).parquet(self.path)
        except Exception as problem:
            if "PATH_NOT_FOUND" not in str(problem):
                raise
            df = self.spark.createDataFrame([], FIELDS)
        return (df if dataset_id is None else df.where(F.col("dataset_id") == dataset_id)).orderBy("seq")

    def head(self) -> tuple[int, str]:
        """(number of entries, hash of the last)."""
        last = self.rows().agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("h")).first()
        return last["n"], last["h"] or GENESIS

    def append(self, entries: list[Entry], sign=None, expected: str | None = None, tries: int = 5) -> str:
        """Append entries in order; returns the hash of the last. With `expected` the
        head has to be that hash still, else HeadMoved; without, a head that another
        writer takes is read again, `tries` times in all."""
        for _ in range(tries):
            n, link = self.head()
            if expected is not None and link != expected:
                raise HeadMoved(f"the head is {link}")
            if not entries:
                return link
            if claim(self.spark, self.path, n):
                break
            time.sleep(0.5)
        else:
            raise HeadMoved(f"entry {n} is being written; if its writer died, see abandon")
        rows = []
        for i, e in enumerate(entries):
            e = Entry(**(asdict(e) | {"prev_hash": link}))
            link = e.digest()
            rows.append((n + i, e.entry_id, e.prev_hash, e.timestamp, e.dataset_id, e.run_id, e.mechanism_name, float(e.sensitivity), float(e.noise_scale), float(e.eps_spent), float(e.delta), e.seed, e.actor, sign(e.canonical()) if sign else "", link))
        append_claimed(self.spark.createDataFrame(rows, FIELDS), self.path, n)
        return link

    def abandon(self) -> None:
        """Free the next number, whose writer died before it wrote. To be called by whoever
        knows that: a writer that is only slow would then fork the chain."""
        give_up(self.spark, self.path, self.head()[0])


def checked(rows: DataFrame) -> DataFrame:
    """rows with link_ok and hash_ok; a chain is sequential, so its links are one
    window in order of seq."""
    before = F.lag("hash", 1, GENESIS).over(Window.orderBy("seq"))
    return rows.withColumn("link_ok", F.col("prev_hash") == before).withColumn("hash_ok", F.sha2(canonical_column(), 256) == F.col("hash"))


def broken_from(rows: DataFrame) -> DataFrame:
    """One row: entries, first_bad (null if none), broken (entries from there on)."""
    bad = checked(rows).select("seq", (~(F.col("link_ok") & F.col("hash_ok"))).alias("bad"))
    one = bad.agg(F.count("*").alias("entries"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad"), F.max("seq").alias("last"))
    return one.select("entries", "first_bad", F.coalesce(F.col("last") - F.col("first_bad") + 1, F.lit(0)).alias("broken"))


# ------------------------------------------------------------ Ed25519 by the JVM


class BadSignature(Exception):
    pass


def badly_signed(rows: DataFrame, public_key: str) -> list[int]:
    """seq of the entries whose signature is missing or is not the key's over their
    canonical text. The ledger has one writer and is short; rows stream by one by one."""
    bad = []
    for r in rows.select("seq", "signature", canonical_column().alias("text")).orderBy("seq").toLocalIterator():
        try:
            verify(rows.sparkSession, public_key, r["text"].encode(), r["signature"] or "")
        except BadSignature:
            bad.append(r["seq"])
    return bad


def _java(spark: SparkSession):
    return spark.sparkContext._jvm.java.security


def generate_keys(spark: SparkSession, folder: str, name: str = "ledger") -> tuple[str, str]:
    """Write a PEM key pair (the private one readable by its owner only); an
    existing file is never overwritten."""
    paths = os.path.join(folder, f"{name}.key"), os.path.join(folder, f"{name}.pub")
    pair = _java(spark).KeyPairGenerator.getInstance("Ed25519").generateKeyPair()
    factory, named = _java(spark).KeyFactory.getInstance("Ed25519"), spark.sparkContext._jvm.java.lang.Class.forName
    keys = ("PRIVATE", pair.getPrivate(), "PKCS8EncodedKeySpec", 0o600), ("PUBLIC", pair.getPublic(), "X509EncodedKeySpec", 0o644)
    for path, (kind, key, spec, mode) in zip(paths, keys, strict=True):
        body = base64.encodebytes(bytes(factory.getKeySpec(key, named(f"java.security.spec.{spec}")).getEncoded())).decode()
        with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_EXCL, mode), "w") as f:
            f.write(f"-----BEGIN {kind} KEY-----\n{body}-----END {kind} KEY-----\n")
    return paths


def _der(path: str) -> bytes:
    with open(path) as f:
        return base64.b64decode("".join(x for x in f.read().splitlines() if not x.startswith("-----")))


def sign(spark: SparkSession, private_key: str, payload: bytes) -> str:
    security = _java(spark)
    key = security.KeyFactory.getInstance("Ed25519").generatePrivate(security.spec.PKCS8EncodedKeySpec(bytearray(_der(private_key))))
    s = security.Signature.getInstance("Ed25519")
    s.initSign(key)
    s.update(bytearray(payload))
    return base64.b64encode(bytes(s.sign())).decode()


def verify(spark: SparkSession, public_key: str, payload: bytes, signature: str) -> None:
    """Raises BadSignature; returns nothing."""
    security = _java(spark)
    key = security.KeyFactory.getInstance("Ed25519").generatePublic(security.spec.X509EncodedKeySpec(bytearray(_der(public_key))))
    s = security.Signature.getInstance("Ed25519")
    s.initVerify(key)
    s.update(bytearray(payload))
    try:
        good = s.verify(bytearray(base64.b64decode(signature)))
    except Exception as problem:
        raise BadSignature(str(problem)) from problem
    if not good:
        raise BadSignature("signature does not match")


def sign_sheet(spark: SparkSession, sheet: dict, private_key: str, public_key: str) -> dict:
    body = {k: v for k, v in sheet.items() if k not in ("signature", "public_key")}
    payload = json.dumps(body, sort_keys=True, separators=(",", ":")).encode()
    return body | {"signature": sign(spark, private_key, payload), "public_key": base64.b64encode(_der(public_key)).decode()}


def verify_sheet(spark: SparkSession, sheet: dict, expected_public_key: str) -> None:
    """The expected key is required, and the sheet's own key must be that one."""
    if base64.b64decode(sheet.get("public_key", "")) != _der(expected_public_key):
        raise BadSignature("the sheet carries another key")
    body = {k: v for k, v in sheet.items() if k not in ("signature", "public_key")}
    verify(spark, expected_public_key, json.dumps(body, sort_keys=True, separators=(",", ":")).encode(), sheet.get("signature", ""))
