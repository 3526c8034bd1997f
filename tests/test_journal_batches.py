"""Journals appended to in batches, pruned by month, and read whatever the splits."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import validate
from tallyframe.operators.totals import split_totals
from tallyframe.sinks import journal as out
from tallyframe.sources import journal as src, storage
from tests.sample import postings_frame, sample_ledger
from tests.test_text import JOURNAL


@pytest.fixture(scope="module")
def books(spark):
    return sample_ledger(spark)


def part(ledger, *numbers):
    keep = F.col("tindex").isin(*numbers)
    return ledger.having(transactions=ledger.transactions.where(keep), postings=ledger.postings.where(keep))


def entries(spark, path, *bounds):
    ledger = src.read_journal(src.journal_lines(spark, path, *bounds))
    heads = [(r.date.isoformat(), r.payee) for r in ledger.transactions.orderBy("tindex").collect()]
    legs = sorted((r.tindex, r.leg, r.account, r.quantity, r.commodity) for r in ledger.postings.collect())
    return heads, legs


def test_batches_follow_one_another_within_a_month(spark, books, tmp_path):
    path = str(tmp_path / "ledger")
    assert out.append_journal(part(books, 5, 6), path, "late") and out.append_journal(part(books, 1, 2, 3, 4), path, "early")
    heads, legs = entries(spark, path)
    # March holds Cafe and Bookshop of the first batch before the Grocery Store of the second
    assert [p for _, p in heads] == ["Employer", "Landlord", "Currency Exchange", "Cafe Aroma", "Bookshop", "Grocery Store"]
    assert [x[2] for x in legs if x[0] == 6] == ["assets:cash", "expenses:food"] and len(legs) == 12


def test_a_batch_counts_once(spark, books, tmp_path):
    path = str(tmp_path / "ledger")
    assert out.append_journal(part(books, 1), path, "a")
    before = entries(spark, path)
    assert not out.append_journal(part(books, 1), path, "a") and entries(spark, path) == before
    assert out.append_journal(part(books, 1), path, "b") and len(entries(spark, path)[0]) == 2
    with pytest.raises(ValueError):
        out.append_journal(books, path, "a/b")


def test_what_a_lost_writer_leaves_is_not_read(spark, books, tmp_path):
    path = str(tmp_path / "ledger")
    out.append_journal(part(books, 1), path, "a")
    lines = out.render_journal(part(books, 2), blank_lines=True).withColumn("batch", F.lit("000002-b-00000000"))
    out.write_journal(lines, path, "batch")
    (tmp_path / "ledger" / storage.MANIFESTS / "000007.json").write_text('{"number": 7, "fol')
    assert [p for _, p in entries(spark, path)[0]] == ["Employer"]
    assert out.append_journal(part(books, 2), path, "b")
    assert [p for _, p in entries(spark, path)[0]] == ["Employer", "Landlord"]


def test_two_writers_of_one_number(spark, books, tmp_path, monkeypatch):
    path = str(tmp_path / "ledger")
    out.append_journal(part(books, 1), path, "a")
    stale = storage.batches(spark, path)
    out.append_journal(part(books, 2), path, "b")
    monkeypatch.setattr(out, "batches", lambda *_: stale.where("number = 1"))
    with pytest.raises(Exception, match="exist"):
        out.append_journal(part(books, 3), path, "c")
    monkeypatch.undo()
    assert len(entries(spark, path)[0]) == 2 and out.append_journal(part(books, 3), path, "c") and len(entries(spark, path)[0]) == 3


def test_a_bad_batch_is_refused_whole(spark, books, tmp_path):
    path = str(tmp_path / "ledger")
    rows = [(1, 1, 0, "2026-01-20", "a", "1", "EUR"), (2, 1, 0, "2026-01-20", "", "1", None), (2, 2, 0, "2026-01-20", "b", None, "EUR"), (99, 1, 0, "2026-01-20", "c", "0", "EUR")]
    bad = part(books, 1, 2).having(postings=postings_frame(spark, rows))
    bad = bad.having(transactions=bad.transactions.withColumn("date", F.when(F.col("tindex") == 2, None).otherwise(F.col("date"))))
    found = {(r.rule, r.tindex) for r in validate.batch_errors(bad).collect()}
    assert found >= {("postings", 1), ("unbalanced", 1), ("date", 2), ("account", 2), ("amount", 2), ("commodity", 2), ("entry", 99)}
    with pytest.raises(ValueError, match="append refused"):
        out.append_journal(bad, path, "bad")
    assert not (tmp_path / "ledger").exists()
    assert validate.batch_errors(books).isEmpty()


def test_months_are_pruned_before_files_are_listed(spark, books, tmp_path):
    path = str(tmp_path / "ledger")
    out.append_journal(books, path, "all")
    bounds = dt.date(2026, 2, 3), dt.date(2026, 3, 1)
    lines = src.journal_lines(spark, path, *bounds)
    assert {r.file.split("/")[-3] for r in lines.select("file").collect()} == {"month=02"}
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert [p for _, p in entries(spark, path, *bounds)[0]] == ["Landlord", "Currency Exchange"]
    assert [p for _, p in entries(spark, path, dt.date(2026, 3, 31))[0]] == ["Grocery Store", "Cafe Aroma", "Bookshop"]


@pytest.mark.parametrize("size", [40, 1_000])
def test_journal_of_tiny_splits(spark, tmp_path, size):
    """An entry may begin in any split; headers, legs and line numbers stay what they are."""
    for name in ("2026/03.journal", "2026/04.journal"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(JOURNAL)

    def found():
        ledger = src.read_journal(src.journal_lines(spark, str(tmp_path)))
        return [sorted(map(str, df.collect())) for df in (ledger.transactions, ledger.postings, ledger.assertions, ledger.prices.drop("seq"))]

    whole, keys = found(), ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k, v in zip(keys, (str(size), "0")):
            spark.conf.set(k, v)
        assert found() == whole
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)


def test_split_totals(spark):
    rows = [(f, b, s, s % 3) for f in "ab" for b in (0, 10, 20) for s in range(b * 100, b * 100 + 7)]
    df = spark.createDataFrame(rows, "file string, block long, seq long, x int").repartition(5)
    for per_file in (False, True):
        got = {(r.file, r.seq): r.total for r in split_totals(df, {"total": F.col("x")}, per_file).collect()}
        total = 0
        for i, (f, b, s, x) in enumerate(rows):
            total = x if per_file and i and rows[i - 1][0] != f else total + x
            assert got[f, s] == total
