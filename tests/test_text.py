"""Readers and renderers."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import register as reg, reports
from tallyframe.operators.assertions import assertion_check, last_asserted
from tallyframe.sinks import journal as out, tables as sink
from tallyframe.sources import journal as src, json_reports as js, storage
from tests.sample import sample_ledger

D = Decimal


def amount(quantity, commodity="EUR", style=2, places=2):
    return {
        "acommodity": commodity,
        "aquantity": {"decimalMantissa": 0, "decimalPlaces": places, "floatingPoint": quantity},
        "astyle": {"asprecision": style},
    }


def leg(account, *amounts, date=None, asserted=None):
    return {
        "paccount": account, "pdate": date, "pamount": list(amounts),
        "pbalanceassertion": None if asserted is None else {"baamount": asserted},
    }


def txn(index, date, description, *legs, status="Cleared", tags=()):
    return {"tindex": index, "tdate": date, "tdescription": description, "tstatus": status,
            "ttags": [list(t) for t in tags], "tpostings": list(legs)}


def read(spark, doc):
    text = doc if isinstance(doc, str) else json.dumps(doc)
    return js.read_transactions(spark.createDataFrame([(text,)], "json string"))


def test_transaction_json(spark):
    ledger = read(spark, [
        txn(1, "2026-01-02", " Shop | milk | bread ", leg("expenses:food", amount(2.5, style=None, places=3)),
            leg("assets:cash", amount(-2.5, style=-1, places=-1)), status="Odd", tags=[("a", "x"), ("b", None)]),
        txn("2", "2026-01-02", "no index"), txn(3, "", "no date"), txn(4, "2026-02-31", "no such day"), 42, None,
        txn(5, "2026-01-03", "Bad legs", 7, {"paccount": 3}, leg("", amount(1)), leg("ok", amount("5"), amount(5, commodity=9))),
    ])
    heads = {r.tindex: r for r in ledger.transactions.collect()}
    assert set(heads) == {1, 5}
    assert (heads[1].payee, heads[1].note, heads[1].status) == ("Shop", "milk | bread", "Unmarked")
    assert [tuple(t) for t in heads[1].tags] == [("a", "x"), ("b", "")]
    legs = {(r.tindex, r.account): (r.quantity, r.precision) for r in ledger.postings.collect()}
    assert legs == {(1, "expenses:food"): (D("2.5"), 3), (1, "assets:cash"): (D("-2.5"), 2), (5, "ok"): (None, None)}


@pytest.mark.parametrize("text", ["", "{", "[]", "null", "5"])
def test_unreadable_documents_are_empty(spark, text):
    assert read(spark, text).transactions.isEmpty()


def test_assertions_of_json(spark):
    ledger = read(spark, [
        txn(1, "2026-02-01", "a", leg("assets:x", amount(0), asserted=amount(10))),
        txn(2, "2026-01-01", "b", leg("assets:x", amount(0), date="2026-03-01", asserted=amount(20))),
        txn(3, "2026-03-01", "c", leg("assets:x", amount(0), asserted=amount(30))),
        txn(4, "2026-01-05", "d", leg("assets:y", amount(0), asserted={"acommodity": 4})),
        txn(5, "2026-01-06", "moves", leg("assets:y", amount(5), asserted=amount(5)), leg("income:z", amount(-5))),
    ])
    found = {r.account: (r.asserted_on, r.asserted_quantity) for r in last_asserted(ledger.assertions).collect()}
    assert found == {"assets:x": (dt.date(2026, 3, 1), D(20)), "assets:y": (dt.date(2026, 1, 6), D(5))}
    shown = {r.tindex for r in reg.hide_assertions(ledger).collect()}
    assert shown == {5}
    only = ledger.assertions.where("tindex = 4")
    assert last_asserted(only).first().asserted_quantity is None


def test_balance_sheet_json(spark):
    row = lambda name, *a: {"prrName": name, "prrAmounts": [list(a)]}
    doc = {
        "cbrSubreports": [
            ["Assets", {"prRows": [row("assets:cash", amount(1.5), amount(2)), row(""), 5], "prTotals": row("", amount(3.5))}, True],
            ["Liabilities", {"prRows": [], "prTotals": row("")}, False], "odd", [7, {}],
        ],
        "cbrTotals": row("", amount(3.5)),
    }
    frame = spark.createDataFrame([(json.dumps(doc),), ("{}",), ("no",)], "json string")
    rows = js.read_balance_sheet(frame)
    merged = reports.merge_amounts(rows.where("quantity is not null"), ["kind", "section", "account"])
    found = {(r.kind, r.section, r.account): r.quantity for r in merged.collect()}
    assert found == {("account", "Assets", "assets:cash"): D("3.5"), ("total", "Assets", ""): D("3.5"), ("net", "Net", ""): D("3.5")}
    assert rows.where("section = 'Liabilities'").count() == 1


@pytest.mark.parametrize(
    "line, target",
    [
        ("P 2026-07-22 UAH 0.01958 EUR", "EUR"), ("P 2026-07-22 UAH EUR0.01958", "EUR"),
        ("P 2026-07-22 UAH €0.02", "€"), ("P 2026-07-15 BTC 55,849.08 USD", "USD"),
        ('P 2026-07-17 "SXR8" 701.93 EUR', "EUR"), ('P 2026-07-17 EUR 51.07 "UAH"', "UAH"),
        ("P 2026-07-22 UAH", None), ("P 2026-07-22 UAH 0.01958", None), ("P not-a-date UAH 1 EUR", None),
    ],
)
def test_price_lines(spark, line, target):
    rows = src.price_directives(spark.createDataFrame([(line,)], "line string")).collect()
    assert [r.target for r in rows] == ([] if target is None else [target])


JOURNAL = """; opening comment
account Assets:Cash  ; physical cash
account Expenses:Gifts & Donations      ; gifts
commodity 1,000.00 EUR
commodity BTC

2026-03-15 * EDEKA | groceries  ; trip: rome
    ; category: food
    * expenses:uncategorized             45.00 EUR
    ; a remark on the posting
    assets:checking                     -45.00 EUR
2026/03/16=2026/03/17 ! (123) Bank
\texpenses:fees\t1,250.5 EUR
\t(budget:fees)  5 EUR
\t[assets:box]

P 2026-03-16 BTC 55,849.08 USD

2026-03-18
    assets:w  2 "WRLD2" @ 210 EUR
    assets:x  1 BTC @@ 300 EUR
    assets:checking

2026-03-20 * Balance Assertion
    assets:checking   0.00 EUR = -765.00 EUR
not a header
    assets:nowhere  1 EUR
"""


@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_journal(spark, tmp_path, eol):
    (tmp_path / "2026").mkdir()
    (tmp_path / "2026" / "03.journal").write_bytes(JOURNAL.replace("\n", eol).encode())
    ledger = src.read_journal(src.journal_lines(spark, str(tmp_path)))
    heads = {r.tindex: r for r in ledger.transactions.collect()}
    assert [heads[i].payee for i in (1, 2, 3, 4)] == ["EDEKA", "Bank", "", "Balance Assertion"]
    assert (heads[1].note, heads[1].status, heads[1].source_line) == ("groceries", "Cleared", 7)
    assert [tuple(t) for t in heads[1].tags] == [("trip", "rome"), ("category", "food")]
    assert heads[2].status == "Pending" and heads[3].status == "Unmarked"
    legs = {(r.tindex, r.leg, r.account): (r.quantity, r.commodity, r.status) for r in ledger.postings.collect()}
    assert legs == {
        (1, 1, "expenses:uncategorized"): (D(45), "EUR", "Cleared"),
        (1, 2, "assets:checking"): (D(-45), "EUR", None),
        (2, 1, "expenses:fees"): (D("1250.5"), "EUR", None),
        (2, 2, "budget:fees"): (D(5), "EUR", None),
        (2, 3, "assets:box"): (D("-1250.5"), "EUR", None),
        (3, 1, "assets:w"): (D(2), "WRLD2", None),
        (3, 2, "assets:x"): (D(1), "BTC", None),
        (3, 3, "assets:checking"): (D(-720), "EUR", None),
        (4, 1, "assets:checking"): (D(0), "EUR", None),
    }
    checked = assertion_check(ledger).collect()
    assert [(r.account, r.balance, r.asserted, r.holds) for r in checked] == [
        ("assets:checking", D(-765), D(-765), True)
    ]
    assert {r.account for r in ledger.accounts.collect()} == {"Assets:Cash", "Expenses:Gifts & Donations"}
    assert {r.commodity for r in ledger.commodities.collect()} == {"EUR", "BTC"}
    assert [(r.commodity, r.price, r.target) for r in ledger.prices.collect()] == [("BTC", D("55849.08"), "USD")]


def test_render_and_read_back(spark, tmp_path):
    ledger = sample_ledger(spark)
    lines = out.render_journal(ledger, blank_lines=True)
    text = [r.line for r in lines.where("tindex = 4 and part < 3").orderBy(*out.LINE_ORDER).collect()]
    assert text == [
        "2026-03-10 * Grocery Store | weekly shop",
        "    ; category: groceries",
        "    assets:cash" + " " * 53 + "-12.50 EUR",
        "    expenses:food" + " " * 52 + "12.50 EUR",
    ]
    assert text[2].index("1") == 69 and text[3].index("1") == 69
    path = str(tmp_path / "books")
    out.write_journal(lines, path)
    back = src.read_journal(src.journal_lines(spark, path))
    assert {(r.account, r.amount) for r in reports.balance(back).collect()} == {
        (r.account, r.amount) for r in reports.balance(ledger).collect()
    }
    assert [r.payee for r in back.transactions.orderBy("tindex").collect()][:2] == ["Employer", "Landlord"]


def test_long_account_keeps_a_gap(spark):
    from tallyframe.functions.journal import posting_text

    name = "assets:" + "x" * 70
    line = spark.range(1).select(posting_text(F.lit(name), F.lit(D("1.005")).cast("decimal(28,8)"), F.lit("SOL2"))).first()[0]
    assert line == f'    {name}  1.01 "SOL2"'


def test_assertions_and_prices_as_text(spark):
    rows = spark.createDataFrame(
        [(1, 1, dt.date(2026, 1, 31), "assets:cash", D("12.5"), "EUR", 2)],
        "tindex bigint, leg int, date date, account string, quantity decimal(28,8), commodity string, precision int",
    )
    entry = out.render_assertions(rows).first().entry
    assert entry == "2026-01-31 * Balance Assertion\n    assets:cash" + " " * 54 + "0.00 EUR = 12.50 EUR"
    prices = spark.createDataFrame(
        [(dt.date(2026, 1, 1), "SXR8", D("0.00000012"), "EUR", "declared", 1), (dt.date(2026, 1, 1), "€", D(5), "$", "declared", 2)],
        "date date, commodity string, price decimal(18,8), target string, source string, seq bigint",
    )
    assert [r.line for r in out.render_prices(prices).orderBy("seq").collect()] == [
        'P 2026-01-01 "SXR8" 0.00000012 EUR', "P 2026-01-01 € 5 $"
    ]


def test_csv_export(spark, tmp_path):
    df = spark.createDataFrame([(' a,b ', 'say "x"', "two\nlines", None)], "p string, q string, r string, s string")
    sink.export_csv(df.coalesce(1), str(tmp_path / "csv"))
    parts = sorted((tmp_path / "csv").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == b'p,q,r,s\r\n"a,b","say ""x""","two\nlines",\r\n'


def test_preview(spark):
    df = spark.range(2000).selectExpr("id", "repeat('x', 20) as t").orderBy("id")
    small = sink.preview(df.limit(3))
    assert small.text.splitlines()[1].startswith("0,") and small.path is None
    big = sink.preview(df, inline_chars=1000, preview_chars=100)
    lines = big.text.splitlines()
    assert lines[1] == "0," + "x" * 20 and len("\n".join(lines[1:-1])) <= 100
    assert spark.read.parquet(big.path).count() == 2000
    assert sink.preview(df.where("id < 0")).text == "(no results)"


def test_preview_survives_lost_storage(spark, monkeypatch):
    monkeypatch.setattr(sink, "scratch_path", lambda *_: "nowhere://x")
    shown = sink.preview(spark.range(500), inline_chars=50, preview_chars=20)
    assert shown.path is None and "not stored" in shown.text and shown.text.splitlines()[1] == "0"


def test_month_layout_prunes(spark, tmp_path):
    ledger = sample_ledger(spark)
    path = str(tmp_path / "months")
    sink.append_months(ledger.postings, path)
    rows = storage.read_months(spark, path, dt.date(2026, 2, 1), dt.date(2026, 3, 11))
    assert {r.tindex for r in rows.collect()} == {2, 3, 4}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters")[1][:120]
    with pytest.raises(ValueError):
        sink.append_months(ledger.postings, path, violations=spark.range(1))


def test_file_catalog_of_a_folder(spark, tmp_path):
    folder = tmp_path / "files" / "2026" / "03"
    folder.mkdir(parents=True)
    (folder / "bill.pdf").write_bytes(b"x" * 1500)
    row = storage.file_catalog(storage.stored_files(spark, str(tmp_path / "files"))).first()
    assert (row.name, row.year, row.month, row.label, row.kind, row.size) == ("bill.pdf", "2026", "03", "PDF", "document", "1.5 KB")


@pytest.mark.parametrize("number", ["0.0000000121", "0.123456789012", "12345678901234567890.5", "0.000000000000000001", "7"])
def test_prices_keep_every_place(spark, number):
    line = f'P 2026-07-22 "SXR8" {number} EUR'
    prices = src.price_directives(spark.createDataFrame([(line, 1)], "line string, seq long"))
    assert prices.first().price == D(number) and out.render_prices(prices).first().line == line


def test_a_price_too_fine_is_an_error(spark):
    prices = src.price_directives(spark.createDataFrame([("P 2026-07-22 X 0.0000000000000000001 EUR",)], "line string"))
    with pytest.raises(Exception, match="more than 18 places"):
        prices.collect()
