from decimal import Decimal

import pytest

from tallyframe.operators import edit, validate
from tallyframe.operators.edit import Edit
from tests.sample import sample_ledger


@pytest.fixture(scope="module")
def books(spark):
    ledger = sample_ledger(spark)
    names = ledger.postings.select("account").distinct()
    extra = spark.createDataFrame([("expenses:groceries",)], "account string")
    return ledger.having(accounts=names.unionByName(extra), commodities=ledger.postings.select("commodity").distinct())


MOVE = Edit(("acct:expenses",), "change_account", "expenses:groceries", "expenses:food")


def test_only_equal_accounts_move(books):
    after = edit.rewrite(books, MOVE)
    moved = {(r.tindex, r.account) for r in after.postings.where("account like 'expenses:%'").collect()}
    assert moved == {(2, "expenses:housing:rent"), (4, "expenses:groceries"), (5, "expenses:food:coffee"), (6, "expenses:leisure:books")}
    assert [r.tindex for r in edit.edit_targets(books, MOVE).collect()] == [4]
    assert edit.edit_summary(books, after, MOVE).first() == (
        1, 1, "1 posting(s) across 1 transaction(s) -> expenses:groceries"
    )


def test_payee_guard_and_status(books):
    fuzzy = Edit(("payee:o",), "change_payee", "Books", "Bookshop")
    after = edit.rewrite(books, fuzzy)
    assert {r.payee for r in after.transactions.where("tindex in (5, 6)").collect()} == {"Cafe Aroma", "Books"}
    assert edit.edit_summary(books, after, fuzzy).first().transactions == 1
    same = Edit(("payee:o",), "change_payee", "Bookshop", "Bookshop")
    assert edit.edit_summary(books, edit.rewrite(books, same), same).first().transactions == 0
    mark = Edit(("date:2026-03",), "set_status", "cleared")
    after = edit.rewrite(books, mark)
    assert edit.edit_summary(books, after, mark).first().summary == "1 transaction(s) marked cleared"


def test_diff_of_equal_snapshots_is_empty(books):
    assert edit.diff(books.postings, books.postings).isEmpty()


def test_diff_counts_copies(spark):
    before = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    after = spark.createDataFrame([(1,), (3,)], "x int")
    assert {tuple(r) for r in edit.diff(before, after).collect()} == {("before", 1, 1), ("before", 2, 1), ("after", 3, 1)}


def test_dry_run_stores_nothing(books, tmp_path):
    path = tmp_path / "snapshot"
    result = edit.apply_edit(books, MOVE, str(path), dry_run=True)
    assert result.valid and result.path is None and not path.exists()
    assert result.changes.count() == 2


def test_invalid_edit_is_refused_whole(books, tmp_path):
    path = tmp_path / "snapshot"
    bad = Edit(("acct:expenses",), "change_account", "expenses:undeclared", "expenses:food")
    assert not edit.apply_edit(books, bad, str(path), dry_run=True).valid
    with pytest.raises(ValueError):
        edit.apply_edit(books, bad, str(path))
    assert not path.exists()


def test_valid_edit_becomes_a_snapshot(spark, books, tmp_path):
    path = str(tmp_path / "snapshot")
    edit.apply_edit(books, MOVE, path)
    stored = spark.read.parquet(f"{path}/postings")
    assert stored.where("account = 'expenses:groceries'").first().quantity == Decimal("12.5")
    assert validate.unbalanced(books.having(postings=stored)).isEmpty()
    back = edit.read_snapshot(spark, path)
    assert back.accounts.count() == books.accounts.count() and back.commodities.count() == books.commodities.count()
    assert back.transactions.count() == books.transactions.count()


def test_half_a_snapshot_is_refused(spark, books, tmp_path):
    path = str(tmp_path / "snapshot")
    broken = books.having(commodities=books.commodities.selectExpr("raise_error('lost') as commodity"))
    with pytest.raises(Exception, match="lost"):
        edit.store_snapshot(broken, path)
    assert spark.read.parquet(f"{path}/postings").count()
    with pytest.raises(ValueError):
        edit.read_snapshot(spark, path)


@pytest.mark.parametrize(
    "bad",
    [
        Edit((), "set_status", "cleared"),
        Edit(("payee:x",), "rename", "a"),
        Edit(("payee:x",), "set_status", "done"),
        Edit(("payee:x",), "change_payee", "a|b", "c"),
        Edit(("payee:x",), "change_payee", " a", "c"),
        Edit(("payee:x",), "change_payee", "a"),
        Edit(("payee:x",), "change_account", "a  b", "c"),
        Edit(("payee:x",), "change_account", "", "c"),
        Edit(("-f x",), "change_account", "a", "c"),
    ],
)
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        bad.check()
