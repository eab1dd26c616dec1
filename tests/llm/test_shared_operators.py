"""Prefix trie, Merkle manifest and SimHash against brute force and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veilspark.llm import merkle_manifest, prefix_trie, queries, simhash
from veilspark.llm.common import materialize

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CONV = "conv_id long, turn int, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(-120, 260), None]:
        for t in range(rng.randrange(0, 9)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yé", "", "\U0001f600z", None])))
    for c, n in ((999, 2300), (1999, 2100)):  # longer than two blocks, and a long common prefix
        rows += [(c, t, "u", "q" * (t % 3)) for t in range(n)]
    return rows + rows[:40] + [(7000 + k, 0, "u", "same") for k in range(400)]


@pytest.mark.parametrize("sketch", [{}, {"cells": 64, "parts": 5}])
def test_trie_equals_brute_force(spark, sketch):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONV).withColumns({"depth": F.lit("x"), "total": F.lit(1), "k1": F.lit(None).cast("struct<a:int>")})
    got = rows_of(prefix_trie.trie_digest(df, **sketch), *TRIE)
    assert got == sorted(prefix_trie.brute_force(rows), key=str)


def test_trie_without_splice_and_texts(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "v", "b"), (2, 0, "u", "a"), (2, 1, "v", "c"), (3, None, None, None)]
    df = spark.createDataFrame(rows, CONV)
    trie = prefix_trie.prefix_trie(df)
    assert rows_of(trie, *TRIE) == sorted(prefix_trie.brute_force(rows, splice=False), key=str)
    assert rows_of(prefix_trie.with_turns(trie, df), "conv_id", "depth", "role", "text") == [(1, 1, "u", "a"), (1, 2, "v", "b"), (2, 2, "v", "c"), (3, 1, "", "")]


def test_trie_of_nothing(spark):
    assert prefix_trie.trie_digest(spark.createDataFrame([], CONV)).count() == 0
    assert prefix_trie.trie_digest(spark.createDataFrame([(None, 1, "u", "x")], CONV)).count() == 0


def test_ends_of_a_crowded_node_span_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN_BYTES", 64)
    ends = spark.range(3000).select(F.lit(1).cast("long").alias("depth"), F.lit(5).cast("long").alias("k1"), (F.col("id") % 2).alias("k2"), (F.col("id") * 7 - 99).alias("conv_id"))
    import hashlib

    want = [(1, 5, k, hashlib.sha256(",".join(str(i * 7 - 99) for i in range(k, 3000, 2)).encode()).hexdigest()) for k in (0, 1)]
    assert rows_of(prefix_trie.ends_digest(ends)) == want


def odd_leaves():
    rng = random.Random(3)
    rows = [(i if i % 97 else None, f"T{i}É", rng.choice(["en"] * 30 + ["de", None, ""]), rng.choice([None, "s"]), i) for i in range(4096 * 11)]
    return rows + rows[:50] + [(5, None, f"l{k}", "s", None) for k in range(70)]


def test_manifest_equals_brute_force(spark):
    rows = odd_leaves()  # ragged blocks in the exchange, more languages than one run
    df = spark.createDataFrame(rows, DOCS).withColumns({"slot": F.lit("x"), "position": F.lit(2), "leaf": F.lit(3), "tree": F.lit(None).cast("struct<a:int>")})
    assert rows_of(merkle_manifest.manifest_digest(df)) == sorted(merkle_manifest.brute_force(rows), key=str)


def test_manifest_of_odd_documents(spark, odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert rows_of(merkle_manifest.manifest_digest(odd_documents)) == sorted(merkle_manifest.brute_force(rows), key=str)
    assert merkle_manifest.manifest_digest(no_documents).count() == 0
    one = odd_documents.where("doc_id = 4")
    leaf, subroot, root = merkle_manifest.manifest_digest(one).select("leaf", "subroot", "root").first()
    assert leaf == subroot == root


@pytest.mark.parametrize("n", [1, 2, 8, 9, 63, 65, 130])
def test_exchange_of_any_number(spark, n):
    nodes = [f"{k:02x}" for k in range(n)]
    state = spark.createDataFrame([("t", k, n, v) for k, v in enumerate(nodes)], "tree string, slot long, slots long, node string")
    levels = merkle_manifest._levels(nodes, 0)
    for r in merkle_manifest.exchanged(state).collect():
        assert r["node"] == levels[-1][0]
        assert [tuple(p) for p in r["path"]] == [merkle_manifest._siblings(level, r["slot"] // 8**k) for k, level in enumerate(levels[:-1])]


def test_proofs_verify_and_show_changes(spark, documents):
    told = merkle_manifest.manifest(documents)
    now = documents.withColumn("text", F.when(F.col("doc_id") == 7, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    found = {r["doc_id"]: r["verified"] for r in merkle_manifest.verified(now, told).collect()}
    assert not found.pop(7) and all(found.values())


def clusters(seed):
    rng = random.Random(seed)
    fps = set()
    for _ in range(30):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x - (1 << 64) if x >> 63 else x)
    return sorted(fps)


def grouped(fps, pairs):
    top = {x: x for x in fps}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        top[find(a)] = find(b)
    out = {}
    for x in fps:
        out.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("crowd", [32, 3, 1])
def test_simhash_links_lose_nothing(spark, crowd):
    fps = clusters(crowd)
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), crowd=crowd).collect()]
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in got)
    assert grouped(fps, got) == grouped(fps, near)


@pytest.mark.parametrize("chain", [2, 3])
def test_simhash_lookups_are_never_broadcast(spark, chain):
    fps = materialize(spark.createDataFrame([(x,) for x in clusters(chain)], "fp long"), "fps")
    met, left = simhash._looked_up(fps, chain, simhash.BUDGET, 3)
    assert met.count() and "Broadcast" not in met._jdf.queryExecution().toString() + left._jdf.queryExecution().toString()


def test_simhash_equals_brute_force(spark, document_rows, documents):
    assert rows_of(simhash.near_duplicates(documents)) == sorted(simhash.brute_force(document_rows), key=str)


def test_simhash_of_odd_documents(spark, odd_documents, no_documents):
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    assert rows_of(simhash.near_duplicates(odd_documents)) == sorted(simhash.brute_force(rows), key=str)
    assert simhash.near_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("text", [" ".join(f"w{i % 977} X{i}é" for i in range(250_000)) + " " + "z" * 3_000_000 + " q r", "a b " + "y" * 3_000_000, " " * 3_000_000])
def test_simhash_of_a_very_long_text(spark, text):
    assert rows_of(simhash.near_duplicates(spark.createDataFrame([(1, text)], "doc_id long, text string"))) == simhash.brute_force([(1, text)])


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_merkle_manifest"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"create view {table} as select * from read_parquet('{sf}/{table}.parquet')")
    df = queries.QUERIES[name](spark, sf)
    want = con.sql(queries.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert rows_of(df) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
