import random
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veilspark.llm import components, order_minhash, piece_codec, token_store, url_filter, warc_store
from veilspark.llm.common import scratch_root

# urls


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = next((rest[:i] for i, c in enumerate(rest) if c in "/?#"), rest)
    tail = rest[len(host) :]
    path = next((tail[:i] for i, c in enumerate(tail) if c in "?#"), tail)
    return "".join(c.lower() if c < "\x80" else c for c in host), path


def test_url_parts_rules_and_list(spark):
    urls = [
        "http://A.Net/x", "http://net", "http://net/", "http://xnet/", "https://example.net/en/a", "https://www.EXAMPLE.net/en", "http://a.example.com/de/",
        "http://example.com/fr/", "http://x.org/fr/1", "http://x.org/de/1", "nothing", "", None, "a://b://c/d", "http://É.org/fr/é?q#f", "http://h.org?x=/fr/",
        "http://h.org/p/?utm_source=a&b=1#top", "https://www.h.org/p?b=1", "http://h.org/q\u2028/z", "http://h.org/p?b=2",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("h.org/p?b=1",), ("h.org/p?b=1",), (None,)], "canonical string")
    got = {r["page_id"]: r for r in url_filter.judge(pages, listed).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path = plain_parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path), u
        rule = None
        for action, h, p in sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2])):
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                rule, verdict = h + p, action
        want = verdict if rule else ("block" if i in (16, 17) else "allow")
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, want), u


def test_url_filter_edges(spark):
    schema = "page_id long, url string, html string"
    none = spark.createDataFrame([], schema)
    assert url_filter.judge(none, url_filter.thin_pages(none)).count() == 0
    rows = spark.createDataFrame([(1, "http://a.org/x", "")] * 2 + [(None, "http://www.a.org/x/", "y" * 2000), (3, None, None)], schema)
    got = sorted((str(r["page_id"]), r["verdict"]) for r in url_filter.judge(rows, url_filter.thin_pages(rows)).collect())
    assert got == [("1", "block"), ("1", "block"), ("3", "allow"), ("None", "block")]


def test_bloom_filter_is_exact_without_broadcasts(spark):
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.format_string("http://s.com/%d", "id").alias("url"))
    pages = pages.unionByName(spark.createDataFrame([(5000, "http://s.com/" + "x" * 2_000_000), (5001, "http://h.org/" + "y" * 2_000_000)], pages.schema))
    listed = spark.range(0, 4000, 2).select(F.format_string("s.com/%d", "id").alias("canonical")).unionAll(spark.createDataFrame([("h.org/" + "y" * 2_000_000,)], "canonical string"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = url_filter.judge(pages, listed).persist()
        assert got.count() == 2002 and got.where("page_id < 5000 and (page_id % 2 = 0) <> (verdict = 'block')").count() == 0
        assert [r["verdict"] for r in got.where("page_id >= 5000").orderBy("page_id").collect()] == ["allow", "block"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_pages_are_read_once(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    plan = url_filter.judge(pages, url_filter.thin_pages(pages))._jdf.queryExecution().executedPlan().toString()
    assert plan.count(f"{sf}/pages.parquet") == 1


# WARC


def page_rows(spark):
    long = "<p>" + "é" * 600
    rows = [(1, "http://a/1", long), (2, "http://a/2\r\nWARC-Type: revisit", long), (3, None, long), (3, "http://a/3", long), (4, "http://a/4", "short"), (5, "http://a/5", "short"), (6, "u", None), (7, "u", ""), (None, "n", long)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)), long


def test_warc_round_trip(spark):
    pages, long = page_rows(spark)
    path = f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"
    warc_store.write_archive(pages, path)
    assert warc_store.read_payloads(spark, path).count() == 3
    records = warc_store.read_records(spark, path).collect()
    assert len(records) == 9
    for r in records:
        head, body = bytes(r["record"]).split(b"\r\n\r\n", 1)
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nWARC-Date: 20" in head and body.endswith(b"\r\n\r\n")
        if r["record_type"] == "response":
            assert f"Content-Length: {len(body) - 4}".encode() in head
    got = [(str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc_store.archive_digest(pages).collect()]
    n = len(long.encode())
    want = [("1", "revisit", 3, n), ("2", "revisit", 3, n), ("3", "response", None, n), ("3", "response", None, n), ("None", "revisit", 3, n)]
    want += [("4", "response", None, 5), ("5", "response", None, 5), ("6", "response", None, 0), ("7", "response", None, 0)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_warc_detects_a_wrong_payload(spark):
    path = f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"
    spark.createDataFrame([("0" * 64, bytearray(b"x"))], "digest string, payload binary").write.parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match its digest"):
        warc_store.read_payloads(spark, path).collect()


@pytest.mark.parametrize("old, new, told", [("Content-Length: 5", "Content-Length: 6", "length"), ("sha1:a", "sha1:b", "declared")])
def test_warc_detects_a_wrong_header(spark, old, new, told):
    path = f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"
    pages = spark.createDataFrame([(k, "u", f"{k:05d}") for k in range(40)], "page_id long, url string, html string")
    warc_store.write_archive(pages, path, "2020-01-01T00:00:00Z")
    assert warc_store.read_records(spark, path).where("contains(decode(record, 'UTF-8'), 'WARC-Date: 2020-01-01T00:00:00Z')").count() == 40
    other = f"{scratch_root(spark)}/test-{uuid.uuid4().hex}"
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{other}/payloads")
    changed = F.encode(F.replace(F.decode("header", "UTF-8"), F.lit(old), F.lit(new)), "UTF-8")
    spark.read.parquet(f"{path}/headers").withColumn("header", changed).write.parquet(f"{other}/headers")
    with pytest.raises(Exception, match=f"declared {told} differs"):
        warc_store.read_records(spark, other).collect()


def test_warc_of_a_very_long_payload(spark):
    html = "é<p>" * 3_000_000
    pages = spark.createDataFrame([(1, "u", html), (2, "u", html)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc_store.archive_digest(pages).collect()}
    assert got == {1: (15_000_000, "revisit", 2), 2: (15_000_000, "response", None)}


def test_warc_of_no_pages(spark):
    assert warc_store.archive_digest(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# tokens


def test_wavelet_matrix_queries(monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_BITS", 512)
    monkeypatch.setattr(token_store, "KEPT_BLOCKS", 5)
    rng = np.random.default_rng(1)
    for top in (2, 3, 900, 70_000):
        ids = rng.integers(0, top, 3000)
        m = token_store.WaveletMatrix(token_store.WaveletMatrix.build(ids, ([1, None], [1000, 2000])))
        assert (m.decode() == ids).all() and m.docs[0] == [1, None] and list(m.docs[1]) == [1000, 2000]
        for i in rng.integers(0, 3000, 40):
            assert m.access(int(i)) == ids[i]
        for s in {int(x) for x in ids[:12]} | {top - 1}:
            where = np.flatnonzero(ids == s)
            assert m.count(s) == len(where) and m.rank(s, 1234) == (ids[:1234] == s).sum()
            assert m.occurrences(s)[:20] == list(where[:20]) if len(where) < 60 else m.select(s, 7) == where[7]
    empty = token_store.WaveletMatrix(token_store.WaveletMatrix.build(np.zeros(0, np.int64)))
    assert len(empty.decode()) == 0 and empty.count(3) == 0


def test_chunked_encoding_equals_whole_texts(document_rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    rng = random.Random(2)
    parts = ["the", "ing", " ", "  ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\u2028", "\xa0", "é", "e\u0301", "\u0301", "Σ", "ΟΔΟΣ", "İ", "'s", "'LL", "12", "<|endoftext|>", "<|start", "oftext|>", "<|ENDOFTEXT|>", ". ", ", ", "end. The ", "a., b ", "é, ", "日本", "\U0001f600", "#$%"]
    texts = [t for _, t in document_rows] + ["", None] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(4000)]
    for text, ids in zip(texts, token_store.encode_texts(pa.array(texts, pa.string()), token_store.default_tokenizer()), strict=True):
        assert tokenizer.encode(text or "", add_special_tokens=False).ids == ids.tolist(), repr(text)


def test_token_digest(documents, document_rows, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "SHARD_TOKENS", 5000)
    tokenizer = Tokenizer.from_file(token_store.default_tokenizer())
    got = {r["doc_id"]: tuple(r)[1:] for r in token_store.token_digest(documents).collect()}
    start = 0
    for doc, text in sorted(document_rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert got[doc] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_edges(odd_documents, no_documents):
    got = token_store.token_digest(odd_documents).collect()
    assert len(got) == 12 and min(r["start"] for r in got) == 0
    assert next(r for r in got if r["doc_id"] is None)["start"] == 0
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert token_store.token_digest(no_documents).count() == 0


def test_a_lookup_inflates_few_blocks():
    ids = np.random.default_rng(3).integers(0, 40_000, 400_000)
    m = token_store.WaveletMatrix(token_store.WaveletMatrix.build(ids, ([1], [400_000])))
    assert m.access(123_456) == ids[123_456] and len(m._kept) <= m.bits < m.ranks.size
    assert m.rank(int(ids[5]), 300_000) == (ids[:300_000] == ids[5]).sum()


# pieces


def test_pieces_equal_the_library(document_rows):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model())
    rng = random.Random(4)
    parts = ["a", "the", "ing", " ", "  ", "\n", "1", "0", "=", "//", "é", "日", "▁", "\u0301", "\x00", "\U0001f600", "    ", "ŧ", "zz"]
    texts = [t for _, t in document_rows] + ["", " ", " " * 70, "q" * 3000] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    found = piece_codec.encode_texts(texts, piece_codec.default_model())
    model = piece_codec.model_of(piece_codec.default_model())
    for text, ids in zip(texts, found, strict=True):
        assert library.encode(text or "") == ids.tolist(), repr(text)
        assert model.decode(ids) == (text or "").replace("▁", " ")


def test_suffix_array_finds_every_occurrence():
    model = piece_codec.model_of(piece_codec.default_model())
    text = "▁the▁thing▁then▁een▁een"
    starts, ends, symbols = piece_codec.edges(np.array([ord(c) for c in text]), model)
    found = sorted((int(s), int(e)) for s, e in zip(starts, ends, strict=True))
    pieces = {"".join(chr(c) for c in row if c >= 0) for row in model.piece_codes}
    assert found == [(i, j) for i in range(len(text)) for j in range(i + 1, min(len(text), i + model.longest) + 1) if text[i:j] in pieces]


def test_piece_edges(odd_documents, no_documents):
    got = piece_codec.codec_digest(odd_documents).collect()
    assert len(got) == 12 and all(r["round_trip"] for r in got)
    assert {r["n_pieces"] for r in got if r["doc_id"] in (1, 2)} == {0}
    rows = piece_codec.encode(odd_documents)
    assert rows.columns[:3] == ["doc_id", "text", "lang"] and rows.where("doc_id = 1").first()["piece_ids"] is None
    assert piece_codec.codec_digest(no_documents).count() == 0
    twice = piece_codec.decode(rows).select("doc_id", "decoded")
    assert sorted(map(str, twice.collect())) == sorted(map(str, piece_codec.encode(odd_documents, decoded=True).select("doc_id", "decoded").collect()))


# near copies


def test_banded_distance_equals_plain():
    rng = random.Random(9)
    for _ in range(3000):
        a = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        b = list(a) if rng.random() < 0.5 else [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            if b:
                b[rng.randrange(len(b))] = rng.randint(0, 3)
        most = rng.randint(0, 12)
        row = list(range(len(b) + 1))
        for p, w in enumerate(a, 1):
            above, row[0] = row[0], p
            for q, v in enumerate(b, 1):
                above, row[q] = row[q], min(row[q] + 1, row[q - 1] + 1, above + (w != v))
        want = row[-1] if row[-1] <= most else most + 1
        assert order_minhash.banded_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == want


def test_banded_distance_of_long_texts():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 50, 700)
    b = np.delete(a, rng.integers(0, 700, 60))
    b[::30] = 99
    full = order_minhash.banded_distance(a, b, 700)
    for most in (full, full + 5, 200):
        assert order_minhash.banded_distance(a, b, most) == full
    assert order_minhash.banded_distance(a, b, full - 1) == full


def near_rows():
    rng = random.Random(11)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(60, 140))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "zz"
        rows.append((1000 - i, "  ".join(words)))
    rows += [(5000 + i, " ".join(f"u{rng.randint(0, 9000)}" for _ in range(50))) for i in range(40)]
    return rows


@pytest.mark.parametrize("small", [16, 2])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(order_minhash, "SMALL", small)
    rows = near_rows()
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == order_minhash.brute_force(rows)


def test_unrelated_members_of_a_large_bucket(spark, monkeypatch):
    """Several groups that share a passage meet in the same buckets."""
    monkeypatch.setattr(order_minhash, "SMALL", 2)
    monkeypatch.setattr(order_minhash, "SAMPLE", 1)
    shared = " ".join(f"s{i}" for i in range(60))
    rng = random.Random(1)
    rows = []
    for g in range(9):
        own = [f"g{g}x{i}" for i in range(50)]
        for k in range(3):
            words = list(own)
            words[rng.randrange(50)] = f"e{g}{k}"
            rows.append((g * 10 + k, shared + " " + " ".join(words)))
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == order_minhash.brute_force(rows)


def edited(rng, words, edits, keep=()):
    """words with that many of them replaced by new ones, none at the places to keep."""
    words = list(words)
    for i in rng.sample([i for i in range(len(words)) if i not in keep], edits):
        words[i] = f"n{rng.getrandbits(60)}"
    return words


def near_classes(spark, rows):
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    return {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(df).collect()}


def test_outlier_of_a_crowded_group(spark):
    """Every bucket of the outlier is crowded with almost equal copies."""
    rng, rows = random.Random(6), []
    for g in range(8):
        base = [f"g{g}w{i}" for i in range(200)]
        rows += [(100 * g + k, edited(rng, base, 1)) for k in range(40)] + [(100 * g + 99, edited(rng, base, 16))]
    got = near_classes(spark, rows)
    assert [got[100 * g + 99] for g in range(8)] == [100 * g for g in range(8)]


def test_recall_of_scattered_edits(spark):
    """Share of pairs found at word edit similarities of 0.8 to 0.95."""
    rng, rows, kinds = random.Random(8), [], {}
    for p in range(1200):
        n, share = (5, 10, 25, 60, 120, 150, 200, 250, 400, 600)[p % 10], (0.2, 0.15, 0.1, 0.05)[p // 10 % 4]
        base = [f"p{p}w{i}" for i in range(n)]
        rows += [(2 * p, base), (2 * p + 1, edited(rng, base, int(n * share + 1e-9)))]
        kinds.setdefault((share, n <= 120), []).append(p)
    got = near_classes(spark, rows)
    found = {k: sum(got[2 * p + 1] == 2 * p for p in ps) / len(ps) for k, ps in kinds.items()}
    assert all(found[share, True] == 1 for share in (0.2, 0.15, 0.1, 0.05)), found
    assert found[0.2, False] >= 0.9 and found[0.15, False] >= 0.97 and found[0.1, False] == found[0.05, False] == 1, found


def test_bags_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    one, two = [], []
    for _ in range(300):
        a = rng.integers(0, rng.choice([3, 40, 60000]), rng.integers(0, 60))
        b = np.delete(a, rng.integers(0, max(1, len(a)), min(len(a), 3)))
        b = np.insert(b, rng.integers(0, len(b) + 1, 4), rng.integers(0, 50, 4))
        one.append(a), two.append(b if rng.random() < 0.9 else b[:0])
    bound = order_minhash.bag_edits(*([np.sort(x.astype(np.uint16)).tobytes() for x in side] for side in (one, two)))
    exact = [order_minhash.banded_distance(a, b, 200) for a, b in zip(one, two, strict=True)]
    assert (bound <= np.array(exact)).all() and bound.max() > 0
    assert len(order_minhash.bag_edits([], [])) == 0 and order_minhash.bag_edits([b""], [b""]).tolist() == [0]


def test_short_documents_share_a_run():
    """The claim behind run_keys: of documents of at most SHORT words."""
    for m in range(order_minhash.K, order_minhash.SHORT + 1):
        edits = order_minhash.allowed_edits(m)
        size = 2 if m == 5 else 3 if m <= 15 else 4
        assert -(-(m - edits) // (edits + 1)) >= size
        for n in range(max(order_minhash.K, m - edits), m + 1):
            a, b = (set(order_minhash.run_keys(np.arange(x, dtype=np.uint64)).tolist()) for x in (n, m))
            assert len(a & b) >= n - size + 1


def test_prefixes_of_similar_documents_meet():
    """The claim behind prefix_size, for random edits and any order of word pairs."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(5, 90))
        x = rng.integers(0, max(3, n // 2), n).astype(np.uint64)
        y = x.tolist()
        for _ in range(order_minhash.allowed_edits(n)):
            k, at = rng.integers(0, 3), int(rng.integers(0, len(y)))
            if k == 0:
                y[at] = 10**6
            elif k == 1:
                y.insert(at, 10**6)
            else:
                del y[at]
        y = np.array(y, np.uint64)
        if order_minhash.allowed_edits(max(n, len(y))) < order_minhash.allowed_edits(n) or len(y) < order_minhash.K:
            continue
        for size in (1, 2):
            a, b = (np.sort(order_minhash.labelled(v, size))[: order_minhash.prefix_size(len(v), size)] for v in (x, y))
            assert np.isin(a, b).any()


def test_rows_of_one_id(spark):
    """Rows of one id with unlike texts are documents of their own; equal rows are one."""
    a, b = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b + " c"), (3, a + " c"), (0, "x y")], "doc_id long, text string")
    got = sorted(tuple(r) for r in order_minhash.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (1, 1), (2, 1), (3, 1)]
    assert sorted((r["doc_id"], r["text"][0]) for r in order_minhash.near_dedup(df).collect()) == [(0, "x"), (1, "a"), (1, "b")]


def test_link_of_two_members_that_are_no_heads(spark):
    """Two groups hang together by one pair alone, whose buckets are all large."""
    rng, q = random.Random(7), range(80, 115)
    x = [f"w{i}" for i in range(200)]
    y = [f"q{i}" if i in q else w for i, w in enumerate(x)]
    rows = [(k, edited(rng, x, 6, q)) for k in range(220)] + [(300 + k, edited(rng, y, 6, q)) for k in range(220)] + [(900, x), (901, y)]
    assert set(near_classes(spark, rows).values()) == {0}
    assert len(set(near_classes(spark, rows[:-1]).values())) == 2


def test_near_duplicates_on_documents(documents, document_rows):
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(documents).collect()}
    rows = [r for r in document_rows if len((r[1] or "").split()) < 800]
    want = order_minhash.brute_force(rows[:150])
    ids = set(want)
    same = lambda c: {(a, c[a]) for a in ids if c[a] != a and c[a] in ids}
    assert same(want) <= same(got)


def test_near_duplicate_edges(spark, odd_documents, no_documents):
    got = {(r["doc_id"], r["class_id"]) for r in order_minhash.near_duplicates(odd_documents).collect()}
    assert {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (None, None)} <= got
    assert order_minhash.near_duplicates(no_documents).count() == 0
    stay = order_minhash.near_dedup(odd_documents)
    assert stay.columns == odd_documents.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(["1", "2", "3", "4", "6", "None", "9", "10", "11"])


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(30)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    half = components.components(spark.createDataFrame(pairs[:45], "a long, b long"))
    both = components.with_links(half, spark.createDataFrame([p for p in pairs[45:] if p[0] != p[1]], "a long, b long"))
    assert {r["node"]: r["label"] for r in both.collect()} == got
