import hashlib
import random
import re

import numpy as np
import pytest

from veilspark.llm import decontaminate, language_id, quality_rules, secret_scan, substring_dedup


def result(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# substring dedup


def test_substring_dedup_equals_brute_force(documents, document_rows):
    got = result(substring_dedup.removal_digest(documents), "n_words", "n_removed", "kept_sha256")
    assert got == substring_dedup.brute_force(document_rows)


@pytest.mark.parametrize("size", [2, 6, 13])
def test_substring_dedup_of_few_words(spark, size):
    rng = random.Random(size)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    got = result(substring_dedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string"), size), "n_words", "n_removed", "kept_sha256")
    assert got == substring_dedup.brute_force(rows, size)


def test_substring_dedup_full_sketch_loses_nothing(spark, document_rows):
    docs = spark.createDataFrame(document_rows, "doc_id long, text string")
    want = substring_dedup.brute_force(document_rows)
    for sketch in ({"cells": 1 << 8, "per_entry": 1e-9}, {"cells": 1 << 8}):  # one full shard; many shards
        assert result(substring_dedup.removal_digest(docs, **sketch), "n_words", "n_removed", "kept_sha256") == want


def test_substring_dedup_tells_regular_words_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    x, y = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    start = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{start} {x}"), (2, f"{start} {y}"), (3, f"{start} {x} end")]
    got = result(substring_dedup.removal_digest(spark.createDataFrame(rows, "doc_id long, text string")), "n_words", "n_removed", "kept_sha256")
    assert got == substring_dedup.brute_force(rows)


def test_substring_dedup_edges(odd_documents, no_documents):
    rows = [tuple(r) for r in substring_dedup.removal_digest(odd_documents).collect()]
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == 12
    assert (1, 0, 0, empty) in rows and (2, 0, 0, empty) in rows and (3, 0, 0, empty) in rows
    assert sum(r[0] == 7 and r[2] == 40 for r in rows) == 2  # both rows lose the passage to doc 6
    assert [r[2] for r in rows if r[0] is None] == [0]
    assert [r[2] for r in rows if r[0] == 5] == [30_000]
    assert substring_dedup.removal_digest(no_documents).count() == 0


# secrets


def test_base_spans_equal_brute_force(documents, document_rows):
    got = result(secret_scan.secret_digest(documents), "base_sha256", "n_assign", "n_access", "n_hex")
    for doc, text in document_rows:
        base = secret_scan.brute_force(text)
        assert got[doc][0] == hashlib.sha256(base.encode()).hexdigest()
        assert sum(got[doc][1:]) == (base.count(",") + 1 if base else 0)


def test_base_spans_of_random_texts():
    rng = random.Random(5)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "abc123", "abcdefgh", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "\n", "é", "ſ", "İ", "K"]
    automaton = secret_scan.keyword_automaton()
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 25)))
        spans = [(s, k, e) for s, k, e in secret_scan.scan(text, automaton) if k in secret_scan.BASE]
        assert ",".join(f"{k}:{s}:{e}" for s, k, e in spans) == secret_scan.brute_force(text), text


def test_checksums_decide():
    body = "aB3" * 10
    good = f"ghp_{body}{secret_scan.crc_base62(body)}"
    automaton = secret_scan.keyword_automaton()
    assert [(k, s) for s, k, _ in secret_scan.scan(f"é {good}", automaton)] == [("github", 2)]
    assert secret_scan.scan(f"é {good[:-1]}{'0' if good[-1] != '0' else '1'}", automaton) == []
    import base64

    jwt = ".".join([base64.urlsafe_b64encode(b'{"alg":"none"}').decode().rstrip("="), "eyJhIjoxfQ", "c2ln"])
    assert [k for _, k, _ in secret_scan.scan(jwt, automaton)] == ["jwt"]
    assert secret_scan.scan(jwt.replace("eyJhbGci", "eyJhbGxx", 1), automaton) == []


def test_base58check():
    raw = bytes.fromhex("0488ade4") + bytes(range(74))
    raw += hashlib.sha256(hashlib.sha256(raw).digest()).digest()[:4]
    value, text = int.from_bytes(raw, "big"), ""
    while value:
        value, digit = divmod(value, 58)
        text = secret_scan.BASE58[digit] + text
    assert text.startswith("xprv") and secret_scan.base58check(text)
    assert not secret_scan.base58check(text[:-1] + ("2" if text[-1] != "2" else "3"))


def test_secret_edges(odd_documents, no_documents):
    got = secret_scan.secret_digest(odd_documents).collect()
    assert len(got) == 12
    eleven = next(r for r in got if r["doc_id"] == 11)
    assert eleven["n_assign"] == 1  # the long s is no ASCII letter
    assert secret_scan.secret_digest(no_documents).count() == 0
    masked = secret_scan.redact(odd_documents)
    assert masked.schema == odd_documents.schema and masked.count() == 12
    text = masked.where("doc_id = 11").first()["text"]
    assert "hunter2000" not in text and text.startswith("naïve Straße İstanbul ſecret=abcdefgh")


# language ID


def test_language_held_out_accuracy(documents):
    truth = result(documents, "lang")
    got = result(language_id.identify(documents), "held_out", "lang_pred", "score")
    held = [d for d in got if got[d][0]]
    assert len(held) > 20
    assert sum(got[d][1] == truth[d][0] for d in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for _, _, s in got.values())


def test_hex_runs_equal_a_plain_expression():
    rng = random.Random(9)
    for _ in range(3000):
        text = "".join(rng.choice("0123456789abcdefg") if rng.random() < 0.97 else rng.choice(" xé") for _ in range(rng.randint(0, 120)))
        assert secret_scan.hex_runs(text) == [m.span() for m in re.finditer("[0-9a-f]{24,}", text)], text


def test_language_model_equals_plain_counts(spark):
    rows = [("the the cat", "en"), ("der hund", "de"), ("ab", "en"), (None, "fr"), ("x", None)]
    languages, table, prior = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert languages == ["de", "en"]
    assert np.exp(prior) == pytest.approx([1 / 3, 2 / 3])  # rows with a text
    counts = np.full((language_id.BUCKETS, 2), language_id.SMOOTHING)
    for text, lang in rows[:3]:
        for n in language_id.NGRAMS:
            for k in range(len(text) + 3 - n):
                gram = f" {text} "[k : k + n]
                v = 0
                for c in gram:
                    v = (v * 0x9E3779B1 + ord(c) * 0x85EBCA77 + n) & 0xFFFFFFFF
                v = (v ^ (v >> 15)) * 0xC2B2AE3D & 0xFFFFFFFF
                counts[v >> 18, languages.index(lang)] += 1
    assert np.allclose(table, np.log(counts / counts.sum(axis=0)), atol=1e-5)


def test_language_equals_brute_force(spark):
    """Two close languages of very unlike shares: the full likelihood decides, in long texts too."""
    rng = random.Random(8)

    def text(weights, n):
        return " ".join("".join(rng.choices("abcdefgh", weights, k=rng.randint(2, 6))) for _ in range(n))

    one, two = (8, 7, 6, 5, 4, 3, 2, 1), (8, 7, 6, 5, 4, 3, 2, 5)
    rows = [(text(one, 12), "aa") for _ in range(400)] + [(text(two, 1500), "ab") for _ in range(8)] + [("zz yy", "zz"), (None, "aa"), ("x", None)]
    texts = [text(w, n) for w in (one, two) for n in (1, 20, 400)] + ["", None, "123", "É", "zz"]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    want = language_id.brute_force(rows, texts)
    assert [r["lang_pred"] for r in got] == [w[0] for w in want]
    assert [r["score"] for r in got] == pytest.approx([w[1] for w in want], abs=1e-3)
    assert want[5][0] == "ab"  # long enough to outweigh the prior


def test_language_pieces_of_a_long_text_add_up():
    long = "Straße İ ΑΣ " * 200_000  # lower-casing depends on what stands around a letter
    for n in language_id.NGRAMS:
        cut = sum(np.bincount(language_id.buckets(run, n, starts)[0], minlength=language_id.BUCKETS) for _, run, starts in language_id._parts(["ab", long, "", "c"]))
        whole = np.bincount(language_id.buckets([f" {t.lower()} " for t in ("ab", long, "", "c")], n)[0], minlength=language_id.BUCKETS)
        assert (cut == whole).all()


def test_language_of_many_labels(spark):
    rows = [(f"w{k} " * 3, f"l{k:04d}") for k in range(1100)]
    model = language_id.train(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model[0]) == 1100
    got = language_id.predict(spark.createDataFrame([(7, "w7 w7 w7"), (8, "w42 w42 w42")], "doc_id long, text string"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {7: "l0007", 8: "l0042"}


def test_language_edges(odd_documents, no_documents):
    got = language_id.identify(odd_documents).collect()
    assert len(got) == 12
    for r in got:
        if r["doc_id"] in (1, 2, 3, 9):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert language_id.identify(no_documents).count() == 0
    kept = language_id.with_language(odd_documents)
    assert kept.columns == odd_documents.columns and kept.where("doc_id in (1, 2, 3, 9)").count() == 0


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.identify(docs).first()["lang_pred"] == "und"


# decontamination


def test_contamination_equals_brute_force(spark, sf, documents, document_rows):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = result(decontaminate.contamination_digest(documents, bench), "n_words", "n_hit", "items_sha256")
    assert sum(g[1] > 0 for g in got.values()) > 0
    for doc, text in document_rows[:120]:
        assert got[doc] == decontaminate.brute_force(text, items)


def test_contamination_of_few_words(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "ç", "1"])
    items = [(i, ", ".join(word() for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(None, "a a"), (99, None)]
    rows = [(i, " - ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(50)]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    known = [x for x in items if x[0] is not None]
    for group in (1 << 20, 20):  # one automaton, then several
        monkeypatch.setattr(decontaminate, "GROUP_BYTES", group)
        got = result(decontaminate.contamination_digest(docs, bench.where("item_id is not null")), "n_words", "n_hit", "items_sha256")
        for doc, text in rows:
            assert got[doc] == decontaminate.brute_force(text, known)
    assert decontaminate.without_contamination(docs, bench.where("item_id is not null")).count() == sum(g[1] == 0 for g in got.values())


def test_contamination_spans_map_to_the_original(spark):
    item = "One two three four five six seven eight nine ten"
    text = f"Ünïcode -- {item.upper().replace(' ', ' ** ')}!! end"
    docs, bench = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")
    row = decontaminate.contamination(docs, bench).first()
    assert [text[s.start : s.end] for s in row["spans"]] == [item.upper().replace(" ", " ** ")]


def test_contamination_edges(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "p3 p4 p5"), (2, "P3 p4 p5"), (3, ""), (4, None), (None, "p9 p10")], "item_id long, text string")
    got = decontaminate.contamination_digest(odd_documents, bench).collect()
    assert len(got) == 12 and all(r["n_items"] == 2 for r in got if r["doc_id"] in (6, 7, None))
    assert decontaminate.contamination_digest(no_documents, bench).count() == 0
    assert decontaminate.contamination_digest(odd_documents, bench.limit(0)).where("contaminated").count() == 0


# quality rules


def plain_features(text):
    text = text or ""
    tokens = [w.decode() for w in text.encode().split()]
    lines = [x for x in text.split("\n") if x.encode().split()]
    seen, where = {}, set()
    for i in range(len(tokens) - 4):
        seen.setdefault(tuple(tokens[i : i + 5]), []).append(i)
    for found in seen.values():
        if len(found) > 1:
            where.update(p for i in found for p in range(i, i + 5))
    return len(tokens), sum(map(len, tokens)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(where)


def test_quality_base_equals_brute_force(documents, document_rows):
    got = result(quality_rules.quality(documents), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for doc, text in document_rows:
        want = plain_features(text)
        assert got[doc][:5] == want
        assert got[doc][5] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality_repeats_of_few_words(spark):
    rng = random.Random(7)
    rows = [(i, "\n".join(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 6)))) for i in range(200)]
    got = result(quality_rules.quality(spark.createDataFrame(rows, "doc_id long, text string")), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for doc, text in rows:
        assert got[doc] == plain_features(text)


def test_quality_edges(odd_documents, no_documents):
    got = quality_rules.quality(odd_documents).collect()
    assert len(got) == 12
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (1, 2, 3, 9))
    assert quality_rules.quality(no_documents).count() == 0


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.8, 0.75, 0.9]
    counts = {}
    for y in truth:
        votes = tuple(0 if rng.random() < 0.2 else (1 if y else -1) * (1 if rng.random() < a else -1) for a in accuracy)
        counts[votes] = counts.get(votes, 0) + 1
    good, rates = quality_rules.estimate(sorted(counts.items()), 4)
    assert abs(good - 0.7) < 0.03 and np.allclose(quality_rules.accuracies(good, rates), accuracy, atol=0.03)


def test_rules_reject_shouted_text_and_keep_the_rest(spark, documents):
    text = " ".join(w + "!!" for w in "SOME WORDS OF A TEXT THAT GOES ON FOR A WHILE AND STOPS".split())
    junk = spark.createDataFrame([(10**6 + i, text + " X" + str(i)) for i in range(12)], "doc_id long, text string")
    plain = spark.createDataFrame([(2 * 10**6, "a short but clean sentence with its dozen of quite ordinary words")], "doc_id long, text string")
    got = quality_rules.quality(documents.select("doc_id", "text").unionByName(junk).unionByName(plain))
    assert [r["doc_id"] for r in got.where("doc_id >= 1000000 and kept").collect()] == [2 * 10**6]


def test_most_documents_are_kept(documents):
    got = quality_rules.quality(documents)
    assert got.where("not base_failed and not kept").count() < 0.1 * got.count()
