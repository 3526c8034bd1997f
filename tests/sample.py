"""Six transactions whose reports were worked out by hand."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from tallyframe.model import Ledger

TODAY = dt.date(2026, 3, 20)

# index, date, payee, note, status, tags, legs
ENTRIES = [
    (1, "2026-01-20", "Employer", "January salary", "Cleared", [],
     [("assets:bank:checking", "3000", "EUR"), ("income:salary", "-3000", "EUR")]),
    (2, "2026-02-05", "Landlord", "February rent", "Cleared", [("category", "housing")],
     [("expenses:housing:rent", "900", "EUR"), ("assets:bank:checking", "-900", "EUR")]),
    (3, "2026-02-14", "Currency Exchange", "", "Cleared", [],
     [("assets:cash:uah", "2050", "UAH"), ("assets:cash:usd", "-50", "USD")]),
    (4, "2026-03-10", "Grocery Store", "weekly shop", "Cleared", [("category", "groceries")],
     [("expenses:food", "12.5", "EUR"), ("assets:cash", "-12.5", "EUR")]),
    (5, "2026-03-14", "Cafe Aroma", "", "Cleared", [],
     [("expenses:food:coffee", "4", "EUR"), ("assets:cash", "-4", "EUR")]),
    (6, "2026-03-14", "Bookshop", "", "Pending", [],
     [("expenses:leisure:books", "18", "EUR"), ("liabilities:card", "-18", "EUR")]),
]


def postings_frame(spark, rows):
    """``rows``: (tindex, leg, pos, date, account, quantity, commodity)."""
    from tallyframe.model import POSTINGS, conform

    made = [
        (t, leg, pos, dt.date.fromisoformat(d), a, None if q is None else Decimal(q), c, 2, False)
        for t, leg, pos, d, a, q, c in rows
    ]
    schema = "tindex bigint, leg int, pos int, date date, account string, quantity decimal(28,8), commodity string, precision int, is_assertion boolean"
    return conform(spark.createDataFrame(made, schema), POSTINGS)


def sample_ledger(spark) -> Ledger:
    from tallyframe.model import TAGS, TRANSACTIONS, conform

    heads = [(i, dt.date.fromisoformat(d), p, n, s, t) for i, d, p, n, s, t, _ in ENTRIES]
    legs = [
        (i, k, 0, d, a, q, c) for i, d, _, _, _, _, posts in ENTRIES for k, (a, q, c) in enumerate(posts, 1)
    ]
    txns = spark.createDataFrame(
        heads, f"tindex bigint, date date, payee string, note string, status string, tags {TAGS}"
    )
    prices = spark.createDataFrame(
        [(dt.date(2026, 3, 1), "UAH", Decimal("0.02"), "EUR", "declared", 1),
         (dt.date(2026, 3, 1), "USD", Decimal("0.90"), "EUR", "declared", 2)],
        "date date, commodity string, price decimal(18,8), target string, source string, seq bigint",
    )
    return Ledger(conform(txns, TRANSACTIONS), postings_frame(spark, legs), prices)
