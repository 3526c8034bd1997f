"""Filters and facets of one pass, against the rules applied transaction by transaction."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest

from tallyframe.model import POSTINGS, TRANSACTIONS, Ledger, conform
from tallyframe.operators import register as reg

ACCOUNTS = ("assets:cash", "Liabilities:card", "expenses:food", "income:pay", "Assets:bank")
COMMODITIES, STATES, TAGS = ("EUR", "USD", "UAH"), ("Cleared", "Pending", "Unmarked"), ("trip", "tax")


def made(seed):
    rng = random.Random(seed)
    heads, legs = [], []
    for t in range(120):
        day = dt.date(2026, 1, 1) + dt.timedelta(rng.randrange(40))
        tags = [(rng.choice(TAGS), "x") for _ in range(rng.randrange(3))]
        heads.append((t, day, rng.choice(("Cafe", "Shop", "", None)), rng.choice(("note", None)), rng.choice(STATES), rng.choice((tags, None))))
        for leg in range(rng.randrange(0, 5)):
            account = rng.choice(ACCOUNTS)
            for pos in range(rng.choice((1, 1, 2))):
                amount = rng.choice((None, Decimal(rng.randrange(-50, 50))))
                legs.append((t, leg, rng.choice((0, None)) if pos == 0 else pos, day, account, rng.choice(COMMODITIES), amount))
    return heads, legs


def shown_legs(legs):
    """The rule of the collapsed row for the legs of one transaction."""
    first = {leg: amount for _, leg, pos, _, _, _, amount in legs if not pos}
    sheet = {leg for _, leg, pos, _, account, _, _ in legs if account.lower().startswith(("assets", "liab"))}
    out = {leg for leg in sheet if first[leg] is not None and first[leg] < 0}
    return {x[1] for x in legs} if not sheet else out if len(sheet) > 1 and out else sheet


def failed(head, legs, f):
    t, day, payee, note, status, tags = head
    names = [n for n, _ in tags or ()]
    out = set()
    if f.first and day < f.first or f.last and day > f.last:
        out.add("dates")
    if f.payees and payee not in f.payees:
        out.add("payees")
    if f.statuses and status not in f.statuses:
        out.add("statuses")
    if f.tags and not set(names) & set(f.tags):
        out.add("tags")
    if f.accounts and not {x[4] for x in legs} & set(f.accounts):
        out.add("accounts")
    if f.commodities and not {x[5] for x in legs} & set(f.commodities):
        out.add("commodities")
    if f.search:
        text = [payee or "", note or "", *[f"{n}: {v}" for n, v in tags or ()], *[x[4] for x in legs]]
        if not any(f.search.lower() in s.lower() for s in text):
            out.add("search")
    if f.least is not None or f.most is not None:
        shown = shown_legs(legs)
        sizes = [abs(x[6]) for x in legs if x[1] in shown and x[6] is not None]
        if not any((f.least is None or a >= f.least) and (f.most is None or a <= f.most) for a in sizes):
            out.add("amount")
    return out


FILTERS = [
    reg.Filters(),
    reg.Filters(accounts=("assets:cash", "income:pay"), commodities=("EUR",), search="CASH"),
    reg.Filters(least=Decimal(10), most=Decimal(30)),
    reg.Filters(most=Decimal(5), accounts=("Liabilities:card",), payees=("Cafe", "")),
    reg.Filters(statuses=("Pending",), commodities=("EUR", "UAH"), tags=("trip",), first=dt.date(2026, 1, 10)),
    reg.Filters(search="trip", least=Decimal(20), commodities=("USD",), last=dt.date(2026, 1, 30), statuses=("Cleared", "Pending")),
]


@pytest.fixture(scope="module", params=(1, 2))
def books(spark, request):
    heads, legs = made(request.param)
    t = spark.createDataFrame(
        heads, "tindex long, date date, payee string, note string, status string, tags array<struct<name:string,value:string>>"
    )
    p = spark.createDataFrame(
        legs, "tindex long, leg int, pos int, date date, account string, commodity string, quantity decimal(28,8)"
    )
    return heads, legs, Ledger(conform(t, TRANSACTIONS), conform(p, POSTINGS))


@pytest.mark.parametrize("f", FILTERS, ids=range(len(FILTERS)))
def test_filters_and_facets(books, f):
    heads, legs, ledger = books
    of = {h[0]: [x for x in legs if x[0] == h[0]] for h in heads}
    fails = {h[0]: failed(h, of[h[0]], f) for h in heads}
    got = reg.apply_filters(ledger, f)
    assert got.columns == ledger.transactions.columns
    assert sorted(r.tindex for r in got.collect()) == [t for t in fails if not fails[t]]
    want = Counter()
    for h in heads:
        t, _, payee, _, status, tags = h
        here = {facet: fails[t] <= {field} for facet, field in reg.FACETS.items()}
        values = {
            "payee": [payee], "status": [status], "tag": {n for n, _ in tags or ()},
            "account": [x[4] for x in of[t] if not x[2]], "commodity": {x[5] for x in of[t]},
        }
        for facet, found in values.items():
            want.update((facet, v) for v in found if v and here[facet])
    rows = reg.facet_counts(ledger, f).collect()
    assert {(r.facet, r.value): r.n for r in rows} == dict(want) and len(rows) == len(want)


def test_no_rows(books):
    empty = books[2].having(transactions=books[2].transactions.limit(0), postings=books[2].postings.limit(0))
    assert reg.facet_counts(empty, FILTERS[5]).isEmpty() and reg.apply_filters(empty, FILTERS[5]).isEmpty()
