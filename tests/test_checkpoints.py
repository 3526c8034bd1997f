import datetime as dt

import pytest

from tallyframe.operators import checkpoints, reports
from tallyframe.operators.edit import diff
from tallyframe.operators.query import Query
from tests.sample import TODAY, postings_frame, sample_ledger

MARCH = dt.date(2026, 3, 1)


@pytest.fixture(scope="module")
def books(spark):
    return sample_ledger(spark)


def same(a, b):
    return diff(a, b.select(*a.columns)).isEmpty()


def alike(books, path):
    """Reports from the checkpoints in ``path`` equal those from all postings."""
    for q in (Query(today=TODAY), Query(end=MARCH, account="^assets", depth=2), Query(end=dt.date(2026, 2, 10), invert=True)):
        assert same(reports.balance(books, q), checkpoints.balance(books, path, q))
    for begin in (dt.date(2026, 1, 5), MARCH, dt.date(2026, 3, 12)):
        q = Query(begin=begin, today=TODAY)
        assert same(
            reports.account_register(books, "assets", q), checkpoints.account_register(books, path, "assets", q)
        )
        for period in ("monthly", "weekly", "quarterly"):
            q = Query(begin=begin, today=TODAY, period=period, depth=1)
            assert same(
                reports.historical_balances(books, q, TODAY), checkpoints.historical_balances(books, path, q, TODAY)
            )


def test_reports_from_checkpoints(spark, books, tmp_path):
    path = str(tmp_path / "c")
    assert checkpoints.fold(books, path, dt.date(2026, 2, 1)) == 1
    assert checkpoints.fold(books, path, dt.date(2026, 3, 20)) == 1  # up to the last month that is over
    assert sorted(checkpoints.stored(spark, path)) == [dt.date(2026, 2, 1), MARCH]
    alike(books, path)


def test_without_checkpoints_all_postings_are_read(books, tmp_path):
    alike(books, str(tmp_path / "none"))


def test_tail_alone_is_read(spark, books, tmp_path):
    """Postings before the checkpoint may be gone: the reports after it stay."""
    path = str(tmp_path / "c")
    checkpoints.fold(books, path, MARCH)
    tail = books.having(postings=books.postings.where("date >= '2026-03-01'"))
    q = Query(begin=MARCH, today=TODAY)
    assert same(reports.account_register(books, "assets", q), checkpoints.account_register(tail, path, "assets", q))


def test_late_postings_are_folded_from_their_day(spark, books, tmp_path):
    path = str(tmp_path / "c")
    checkpoints.fold(books, path, MARCH)
    late = postings_frame(
        spark,
        [(9, 1, 0, "2026-02-07", "assets:cash", "-70", "EUR"), (9, 2, 0, "2026-02-07", "expenses:food", "70", "EUR"),
         (10, 1, 0, "2026-02-08", "assets:new", None, None)],
    )
    more = books.having(postings=books.postings.unionByName(late))
    q = Query(end=MARCH)
    assert not same(reports.balance(more, q), checkpoints.balance(more, path, q))
    assert checkpoints.fold(more, path, MARCH, since=dt.date(2026, 2, 7)) == 1
    alike(more, path)


def test_unfinished_batch_counts_for_nothing(spark, books, tmp_path):
    path = tmp_path / "c"
    checkpoints.fold(books, str(path), MARCH)
    (path / "99999999-lost" / "end=2026-03-01").mkdir(parents=True)
    assert all("lost" not in folder for folder in checkpoints.stored(spark, str(path)).values())
    alike(books, str(path))


def test_terms_on_transactions_are_refused(books, tmp_path):
    with pytest.raises(ValueError, match="whole balances"):
        checkpoints.balance(books, str(tmp_path), Query(payee="x", today=TODAY))
    empty = books.having(postings=books.postings.limit(0))
    assert checkpoints.fold(empty, str(tmp_path / "e"), MARCH) == 0
