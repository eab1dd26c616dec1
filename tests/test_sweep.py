"""Sweeps, and appends to one ledger by several writers."""

import threading

import pytest

from veilspark.operators import ledger, release
from veilspark.sources.claims import append_claimed, claim


def entry(run):
    return ledger.Entry("d", run, "laplace", eps_spent=1.0)


def test_two_writers_keep_one_chain(spark, tmp_path):
    where = f"file://{tmp_path}/book"
    problems = []

    def write(name):
        try:
            book = ledger.Ledger(spark, where)
            for i in range(3):
                book.append([entry(f"{name}{i}")], tries=60)
        except Exception as problem:
            problems.append(problem)

    writers = [threading.Thread(target=write, args=(n,)) for n in "ab"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert not problems
    assert tuple(ledger.broken_from(ledger.Ledger(spark, where).rows()).first()) == (6, None, 0)


def test_number_is_taken_once(spark, tmp_path):
    where, took = f"file://{tmp_path}/t", []
    callers = [threading.Thread(target=lambda: took.append(claim(spark, where, 1))) for _ in range(16)]
    for c in callers:
        c.start()
    for c in callers:
        c.join()
    assert sorted(took) == [False] * 15 + [True]
    append_claimed(spark.range(3), where, 1)
    assert spark.read.parquet(where).count() == 3
    with pytest.raises(OSError):
        append_claimed(spark.range(2), where, 1)
    assert spark.read.parquet(where).count() == 3


def test_append_to_an_expected_head(spark, tmp_path):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    first = book.append([entry("a")], expected=ledger.GENESIS)
    with pytest.raises(ledger.HeadMoved):
        book.append([entry("b")], expected=ledger.GENESIS)
    assert book.append([], expected=first) == first == book.head()[1]
    # a writer that took the next number and died
    assert claim(spark, book.path, 1)
    with pytest.raises(ledger.HeadMoved):
        book.append([entry("b")], tries=1)
    book.abandon()
    book.append([entry("b"), entry("c")], expected=first)
    assert tuple(ledger.broken_from(book.rows()).first()) == (3, None, 0)


def test_sweep_enters_each_release_once(spark, tmp_path, monkeypatch):
    made = []

    def fake(df, schema, cell, *rest):
        made.append(cell.eps)
        if cell.eps == 4.0 and made.count(4.0) == 1:
            raise RuntimeError("executor lost")
        return {"eps": cell.eps, "proved_eps": cell.eps / 2, "seeded_noise": False}

    monkeypatch.setattr(release, "run_release", fake)
    book, store = ledger.Ledger(spark, f"file://{tmp_path}/book"), release.Checkpoints(str(tmp_path / "store"))
    cells = [release.Cell(eps=e) for e in (1.0, 4.0, 2.0)]
    with pytest.raises(RuntimeError):
        release.run_sweep(None, None, cells, dataset="d", book=book, store=store)
    sheet = release.run_sweep(None, None, cells, dataset="d", book=book, store=store)
    assert made == [1.0, 4.0, 4.0, 2.0]
    assert [r["run_id"] for r in book.rows().collect()] == [c.config_hash() for c in cells]
    assert (sheet["ledger_entries"], sheet["ledger_head"]) == book.head()
    assert (sheet["last_eps"], sheet["sum_eps"]) == (1.0, 3.5)
    assert "ledger_head" not in release.run_sweep(None, None, cells, store=store)
