"""Virtual postings from reading to sums, checks and rendering."""

from decimal import Decimal as D

from tallyframe.operators.reports import balance
from tallyframe.operators.validate import batch_errors, unbalanced
from tallyframe.sinks.journal import render_journal
from tallyframe.sources import journal as src
from tallyframe.sources.json_reports import read_transactions
from tests.sample import sample_ledger

JOURNAL = """2026-01-01 Virtual leg
    expenses:food  5 EUR
    assets:cash  -5 EUR
    (budget:food)  -5 EUR

2026-01-02 Both kinds, amounts left out
    expenses:food  7 EUR
    assets:cash
    [budget:food]  -3 EUR
    [budget:rest]

2026-01-03 Kinds do not balance each other
    expenses:food  4 EUR
    [assets:cash]  -4 EUR

2026-01-04 A virtual leg says nothing
    expenses:food  1 EUR
    (budget:food)
    assets:cash
"""


def read(spark, folder, text):
    folder.mkdir()
    (folder / "a.journal").write_text(text)
    return src.read_journal(src.journal_lines(spark, str(folder)))


def legs(ledger):
    return sorted((r.tindex, r.leg, r.account, r.kind, r.quantity) for r in ledger.postings.collect() if r.quantity is not None)


def test_kinds_are_read_summed_and_checked(spark, tmp_path):
    ledger = read(spark, tmp_path / "in", JOURNAL)
    assert legs(ledger) == [
        (1, 1, "expenses:food", "real", D(5)), (1, 2, "assets:cash", "real", D(-5)), (1, 3, "budget:food", "virtual", D(-5)),
        (2, 1, "expenses:food", "real", D(7)), (2, 2, "assets:cash", "real", D(-7)),
        (2, 3, "budget:food", "balanced", D(-3)), (2, 4, "budget:rest", "balanced", D(3)),
        (3, 1, "expenses:food", "real", D(4)), (3, 2, "assets:cash", "balanced", D(-4)),
        (4, 1, "expenses:food", "real", D(1)), (4, 3, "assets:cash", "real", D(-1)),
    ]
    assert sorted((r.tindex, r.commodity, r.amount) for r in unbalanced(ledger).collect()) == [(3, "EUR", D(-4)), (3, "EUR", D(4))]
    # virtual postings count in balances
    assert {r.account: r.amount for r in balance(ledger).where("account like 'budget%'").collect()} == {
        "budget:food": D(-8), "budget:rest": D(3)
    }
    valid = ledger.having(
        transactions=ledger.transactions.where("tindex < 3"), postings=ledger.postings.where("tindex < 3")
    )
    assert batch_errors(valid).isEmpty()


def test_rendering_reads_back(spark, tmp_path):
    ledger = read(spark, tmp_path / "in", JOURNAL)
    lines = render_journal(ledger, blank_lines=True).orderBy("date", "tindex", "part", "side", "leg", "pos").collect()
    text = "\n".join(r.line for r in lines) + "\n"
    assert "    (budget:food)" in text and "    [budget:rest]" in text
    again = read(spark, tmp_path / "out", text)
    without_place = lambda ledger: sorted((t, a, k, q) for t, _, a, k, q in legs(ledger))
    assert without_place(again) == without_place(ledger)


def test_json_and_frames_without_kinds(spark):
    doc = """{"tindex": 1, "tdate": "2026-01-01", "tdescription": "x", "tpostings": [
        {"paccount": "a", "ptype": "RegularPosting", "pamount": []}, {"paccount": "b", "ptype": "VirtualPosting", "pamount": []},
        {"paccount": "c", "ptype": "BalancedVirtualPosting", "pamount": []}, {"paccount": "d", "pamount": []}]}"""
    ledger = read_transactions(spark.createDataFrame([(doc,)], "json string"))
    assert {r.account: r.kind for r in ledger.postings.collect()} == {"a": "real", "b": "virtual", "c": "balanced", "d": "real"}
    plain = sample_ledger(spark)
    assert plain.postings.where("kind is not null").isEmpty() and unbalanced(plain).isEmpty()
