import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators.edit import Edit, diff, rewrite
from tallyframe.sinks import versions
from tests.sample import sample_ledger
from tests.test_edit import MOVE

MARK = Edit(("date:2026-03",), "set_status", "cleared")


@pytest.fixture()
def books(spark):
    ledger = sample_ledger(spark)
    extra = spark.createDataFrame([("expenses:groceries",)], "account string")
    accounts = ledger.postings.select("account").distinct().unionByName(extra)
    return ledger.having(accounts=accounts, commodities=ledger.postings.select("commodity").distinct())


def same(a, b):
    return diff(a, b.select(*a.columns)).isEmpty()


def test_edit_writes_only_its_months(spark, books, tmp_path):
    path = str(tmp_path)
    first = versions.create(books, path)
    second = versions.commit_edit(spark, path, MOVE, first)
    third = versions.commit_edit(spark, path, MARK, second)
    assert [v.number for v in (first, second, third)] == [1, 2, 3]
    day = books.transactions.where("tindex = 4").first().date
    changed = {k for k in second.folders if second.folders[k] != first.folders[k]}
    assert changed == {("postings", f"{day:%Y-%m}")}
    assert {k for k in third.folders if third.folders[k] != second.folders[k]} == {("transactions", "2026-03")}
    # every version reads as the edits applied to all books
    moved = rewrite(books, MOVE)
    for number, whole in ((1, books), (2, moved), (3, rewrite(moved, MARK))):
        stored = versions.read(spark, versions.version(spark, path, number))
        for name in ("transactions", "postings", "assertions", "prices", "accounts"):
            if getattr(whole, name) is not None:
                assert same(getattr(whole, name), getattr(stored, name)), (number, name)
    assert same(
        diff(books.postings, moved.postings), versions.version_diff(spark, first, third, "postings")
    )
    old, new = versions.changed_folders(first, third, "postings")
    assert len(old) == len(new) == 1


def test_second_edit_of_one_version_is_refused(spark, books, tmp_path, monkeypatch):
    path = str(tmp_path)
    first = versions.create(books, path)
    versions.commit_edit(spark, path, MOVE, first)
    with pytest.raises(versions.Conflict):
        versions.commit_edit(spark, path, MARK, first)
    # two writers that both saw version 2 as the latest: the file decides, the loser's rows go
    second = versions.version(spark, path)
    versions.commit_edit(spark, path, MARK, second)
    folders = sorted(p.name for p in (tmp_path / "data").iterdir())
    monkeypatch.setattr(versions, "_numbers", lambda *_: [2])
    with pytest.raises(versions.Conflict):
        versions.commit_edit(spark, path, Edit(("payee:o",), "change_payee", "Books", "Bookshop"), second)
    assert sorted(p.name for p in (tmp_path / "data").iterdir()) == folders
    with pytest.raises(versions.Conflict):
        versions.create(books, path)


def test_refused_or_idle_edit_leaves_nothing(spark, books, tmp_path):
    path = str(tmp_path)
    first = versions.create(books, path)
    before = sorted(p.name for p in (tmp_path / "data").iterdir())
    with pytest.raises(ValueError, match="refused"):
        versions.commit_edit(spark, path, Edit(("acct:expenses",), "change_account", "expenses:new", "expenses:food"), first)
    idle = Edit(("payee:o",), "change_payee", "Bookshop", "Bookshop")
    assert versions.commit_edit(spark, path, idle, first) == first
    assert sorted(p.name for p in (tmp_path / "data").iterdir()) == before
    assert versions.version(spark, path).number == 1


def test_unfinished_manifest_blocks_until_withdrawn(spark, books, tmp_path):
    path = str(tmp_path)
    first = versions.create(books, path)
    (tmp_path / "_versions" / "00000002.json").write_text('{"base": 1, "sch')
    with pytest.raises(versions.Conflict, match="lost"):
        versions.version(spark, path)
    with pytest.raises(versions.Conflict):
        versions.commit_edit(spark, path, MOVE, first)
    with pytest.raises(ValueError, match="complete"):
        versions.withdraw(spark, path, 1)
    versions.withdraw(spark, path, 2)
    assert versions.commit_edit(spark, path, MOVE, first).number == 2


def test_dated_read_opens_only_its_months(spark, books, tmp_path):
    first = versions.create(books, str(tmp_path))
    begin, end = dt.date(2026, 3, 1), dt.date(2026, 4, 1)
    march = versions.read(spark, first, begin, end).postings
    assert {f.split("_month=")[1].split("/")[0] for f in march.inputFiles()} <= {"2026-03"}
    assert same(books.postings.where("date >= '2026-03-01' and date < '2026-04-01'"), march)
    none = versions.read(spark, first, dt.date(1900, 1, 1), dt.date(1900, 2, 1))
    assert none.postings.isEmpty() and none.postings.columns == books.postings.columns


def test_empty_and_undated_rows(spark, books, tmp_path):
    undated = books.having(
        transactions=books.transactions.limit(0),
        postings=books.postings.withColumn("date", F.lit(None).cast("date")),
    )
    first = versions.create(undated, str(tmp_path))
    assert first.months("transactions") == [] and len(first.months("postings")) == 1
    assert first.months("postings", dt.date(1, 1, 1)) == []
    stored = versions.read(spark, first)
    assert stored.transactions.isEmpty() and same(undated.postings, stored.postings)
