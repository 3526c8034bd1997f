import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import analyses, lists, pricing, register as reg, reports, validate
from tallyframe.operators.query import Query, check_terms, matching_transactions, print_report, select_postings
from tallyframe.plans.net_worth import net_worth_sheet
from tests.sample import TODAY, postings_frame, sample_ledger


@pytest.fixture(scope="module")
def books(spark):
    return sample_ledger(spark)


def amounts(df, *keys, value="amount"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


D = Decimal


def test_balances(books):
    found = amounts(reports.balance(books), "account", "commodity")
    assert found == {
        ("assets:bank:checking", "EUR"): D(2100),
        ("assets:cash", "EUR"): D("-16.5"),
        ("assets:cash:uah", "UAH"): D(2050),
        ("assets:cash:usd", "USD"): D(-50),
        ("expenses:food", "EUR"): D("12.5"),
        ("expenses:food:coffee", "EUR"): D(4),
        ("expenses:housing:rent", "EUR"): D(900),
        ("expenses:leisure:books", "EUR"): D(18),
        ("income:salary", "EUR"): D(-3000),
        ("liabilities:card", "EUR"): D(-18),
    }


def test_depth_folds_accounts(books):
    found = amounts(reports.balance(books, Query(depth=1)), "account", "commodity")
    assert found[("assets", "EUR")] == D("2083.5")
    assert found[("expenses", "EUR")] == D("934.5")
    assert len(found) == 6


def test_monthly_expenses_with_quiet_months(books):
    q = Query(account="^expenses", period="monthly", depth=1)
    filled = reports.fill_periods(
        reports.periodic_balance(books, q), "monthly", dt.date(2026, 1, 1), dt.date(2026, 3, 1)
    )
    assert [r.amount for r in filled.orderBy("period").collect()] == [D(0), D(900), D("34.5")]


def test_income_statement_and_sheet(books):
    net = amounts(reports.income_statement(books).where("kind <> 'account'"), "section", "kind")
    assert net == {("Revenues", "total"): D(3000), ("Expenses", "total"): D("934.5"), ("Net", "net"): D("2065.5")}
    sheet = amounts(reports.balance_sheet(books).where("kind <> 'account'"), "section", "commodity")
    assert sheet == {
        ("Assets", "EUR"): D("2083.5"), ("Assets", "UAH"): D(2050), ("Assets", "USD"): D(-50),
        ("Liabilities", "EUR"): D(18),
        ("Net", "EUR"): D("2065.5"), ("Net", "UAH"): D(2050), ("Net", "USD"): D(-50),
    }


def test_valued_sheet(books):
    found = amounts(
        pricing.valued_sheet(books, "EUR").where("measure = 'value' and kind <> 'account'"), "section", "commodity"
    )
    assert found == {("Assets", "EUR"): D("2079.5"), ("Liabilities", "EUR"): D(18), ("Net", "EUR"): D("2061.5")}


def test_net_worth_sheet_texts(books):
    rows = {r.account: r for r in net_worth_sheet(books, "EUR").collect()}
    assert rows["assets:cash:uah"].holding_text == "2,050.00 UAH"
    assert rows["assets:cash:uah"].value_text == "~41.00 EUR"
    assert rows["liabilities:card"].value_text == "18.00 EUR"


def test_account_register_is_historical(books):
    rows = reports.account_register(books, "assets:cash", Query(begin=dt.date(2026, 3, 12))).where("commodity = 'EUR'")
    assert [(r.tindex, r.change, r.balance, r.other_accounts) for r in rows.collect()] == [
        (5, D(-4), D("-16.5"), "expenses:food:coffee")
    ]


def test_register_running_total(books):
    rows = reports.posting_register(books, Query(account="^expenses")).orderBy("date", "tindex").collect()
    assert [r.total for r in rows] == [D(900), D("912.5"), D("916.5"), D("934.5")]


def test_historical_balances_carry_over(books):
    q = Query(account="checking", period="monthly")
    rows = reports.historical_balances(books, q, TODAY).orderBy("period").collect()
    assert [(r.period.month, r.amount) for r in rows] == [(1, D(3000)), (2, D(2100)), (3, D(2100))]


@pytest.mark.parametrize(
    "query, expected",
    [
        (Query(account="FOOD"), {4, 5}),
        (Query(payee="aroma"), {5}),
        (Query(description="shop \\| weekly|store \\| weekly"), {4}),
        (Query(tag="cat"), {2, 4}),
        (Query(tag="category=hous"), {2}),
        (Query(status="pending"), {6}),
        (Query(amount=">1000"), {1, 3}),
        (Query(amount="<-1000"), {1}),
        (Query(amount="=4"), {5}),
        (Query(begin=dt.date(2026, 2, 5), end=dt.date(2026, 2, 14)), {2}),
        (Query(today=dt.date(2026, 3, 10)), {1, 2, 3, 4}),
    ],
)
def test_report_predicates(books, query, expected):
    assert {r.tindex for r in select_postings(books, query).select("tindex").distinct().collect()} == expected


def test_terms_hold_for_the_transaction(books):
    found = matching_transactions(books, ["acct:expenses", "acct:assets:cash", "date:2026-03"])
    assert {r.tindex for r in found.collect()} == {4, 5}
    assert [r.tindex for r in print_report(books, ["payee:landlord"]).collect()] == [2, 2]


@pytest.mark.parametrize("terms", [[], [" "], ["-f"]])
def test_bad_terms_are_refused(terms):
    with pytest.raises(ValueError):
        check_terms(terms)


F_ = reg.Filters


@pytest.mark.parametrize(
    "filters, expected",
    [
        (F_(search="AROMA"), {5}),
        (F_(search="income:salary"), {1}),
        (F_(search="category: groceries"), {4}),
        (F_(search="zzz"), set()),
        (F_(accounts=("assets:cash",)), {4, 5}),
        (F_(accounts=("assets:cash", "income:salary")), {1, 4, 5}),
        # The exchange leads with its source leg, 50 USD.
        (F_(least=D(100)), {1, 2}),
        (F_(least=D(100), most=D(1000)), {2}),
        (F_(most=D(1000)), {2, 3, 4, 5, 6}),
        (F_(commodities=("USD",)), {3}),
        (F_(statuses=("Pending",)), {6}),
        (F_(tags=("category",)), {2, 4}),
        (F_(first=dt.date(2026, 3, 10), last=dt.date(2026, 3, 10)), {4}),
        (F_(first=dt.date(2026, 3, 1)), {4, 5, 6}),
    ],
)
def test_register_filters(books, filters, expected):
    found = {r.tindex for r in reg.apply_filters(books, filters).collect()}
    assert found == expected


def test_register_order_and_counts(books):
    names = [r.payee for r in reg.register_order(books.transactions).collect()]
    assert names == ["Bookshop", "Cafe Aroma", "Grocery Store", "Currency Exchange", "Landlord", "Employer"]
    up = [r.payee for r in reg.register_order(books.transactions, descending=False).collect()]
    assert up[-2:] == ["Cafe Aroma", "Bookshop"]
    assert reg.register_count(books, F_(statuses=("Pending",))).first() == (1, 6)


def test_facets(books):
    counts = amounts(reg.facet_counts(books), "facet", "value", value="n")
    assert counts[("commodity", "EUR")] == 5 and counts[("commodity", "UAH")] == 1
    assert counts[("account", "assets:cash")] == 2
    pending = amounts(reg.facet_counts(books, F_(statuses=("Pending",))), "facet", "value", value="n")
    assert pending[("status", "Cleared")] == 5  # its own filter is left out
    assert pending[("commodity", "EUR")] == 1
    states = [r.value for r in reg.facet_options(books).where("facet = 'status'").collect()]
    assert states == ["Cleared", "Pending"]


@pytest.mark.parametrize(
    "legs, shown",
    [
        ([("expenses:food", "12.5"), ("assets:cash", "-12.5")], ["assets:cash"]),
        ([("assets:savings", "500"), ("assets:checking", "-500")], ["assets:checking"]),
        ([("expenses:food", "30"), ("assets:cash", "-10"), ("liabilities:card", "-20")], ["assets:cash", "liabilities:card"]),
        ([("assets:bank", "2000"), ("assets:savings", "1000"), ("income:salary", "-3000")], ["assets:bank", "assets:savings"]),
        ([("Assets:Bank", "-1"), ("Liability:Card", "-1"), ("Expenses:Food", "2")], ["Assets:Bank", "Liability:Card"]),
        ([("assets-fund:x", "1"), ("assets:real", "1")], ["assets:real"]),
        ([("expenses:food", "1"), ("equity:opening-balances", "-1")], ["expenses:food", "equity:opening-balances"]),
        ([("assets:bank", None), ("assets:cash", "-5")], ["assets:cash"]),
    ],
)
def test_leg_split(spark, legs, shown):
    rows = postings_frame(spark, [(1, i, 0, "2026-01-01", a, q, "EUR") for i, (a, q) in enumerate(legs, 1)])
    found = reg.split_legs(rows).where("shown").orderBy("leg").collect()
    assert [r.account for r in found] == shown


def test_leg_split_follows_first_amount(spark):
    rows = postings_frame(
        spark,
        [(1, 1, 0, "2026-01-01", "assets:a", "-5", "EUR"), (1, 1, 1, "2026-01-01", "assets:a", "9", "USD"),
         (1, 2, 0, "2026-01-01", "assets:b", "5", "EUR")],
    )
    found = reg.split_legs(rows).where("shown").orderBy("pos").collect()
    assert [(r.account, r.commodity) for r in found] == [("assets:a", "EUR"), ("assets:a", "USD")]


@pytest.mark.parametrize(
    "lots, expected",
    [
        ([("EUR", "4758.22"), ("EUR", "-147.12")], [("EUR", D("4611.10"))]),
        ([("EUR", "300"), ("EUR", "-300")], [("EUR", D(0))]),
        ([("EUR", "0.1"), ("EUR", "0.2"), ("EUR", "-0.3")], [("EUR", D(0))]),
        ([("EUR", "0"), ("UAH", "521.72")], [("UAH", D("521.72"))]),
        ([("EUR", "0"), ("UAH", "0")], [("EUR", D(0))]),
    ],
)
def test_merge_amounts(spark, lots, expected):
    df = spark.createDataFrame(
        [(1, i, c, D(q), 2) for i, (c, q) in enumerate(lots)],
        "k int, pos int, commodity string, quantity decimal(28,8), precision int",
    )
    merged = reports.merge_amounts(df, ["k"]).orderBy("first_seen").collect()
    assert [(r.commodity, r.quantity) for r in merged] == expected


def test_lists_and_stats(books):
    assert [r.name for r in lists.list_tags(books).collect()] == ["category"]
    assert lists.list_payees(books).first().name == "Bookshop"
    found = {r.item: r.value for r in reports.statistics(books, TODAY).collect()}
    assert found["transactions"] == "6" and found["payees"] == "6" and found["commodities"] == "3"
    assert found["last_30_days"] == "3" and found["last_7_days"] == "2"


def test_sums_vanish_over_all_accounts(spark, books):
    sums = books.postings.where("tindex <> 3").groupBy("commodity").agg(F.sum("quantity").alias("s")).collect()
    assert all(r.s == 0 for r in sums)
    # The exchange is an implied conversion, not an error.
    assert validate.unbalanced(books).isEmpty()


def test_unbalanced_and_costed(spark, books):
    rows = postings_frame(
        spark,
        [(1, 1, 0, "2026-01-01", "assets:a", "-5", "EUR"), (1, 2, 0, "2026-01-01", "expenses:b", "4", "EUR"),
         (2, 1, 0, "2026-01-01", "assets:w", "2", "WRLD"), (2, 2, 0, "2026-01-01", "assets:a", "-420", "EUR"),
         (3, 1, 0, "2026-01-01", "assets:a", "-5", "EUR"), (3, 2, 0, "2026-01-01", "expenses:b", "-5", "USD")],
    )
    costed = rows.withColumns(
        {"cost_quantity": F.when(F.col("commodity") == "WRLD", F.lit(210)).cast("decimal(28,8)"),
         "cost_commodity": F.when(F.col("commodity") == "WRLD", F.lit("EUR"))}
    )
    bad = validate.unbalanced(books.having(postings=costed))
    assert {(r.tindex, r.commodity, r.amount) for r in bad.collect()} == {
        (1, "EUR", D(-1)), (3, "EUR", D(-5)), (3, "USD", D(-5))
    }


def test_analyses(books):
    top = analyses.top_payees(books, Query(), k=2).collect()
    assert [r.payee for r in top] == ["Landlord", "Bookshop"]
    compared = analyses.compare_months(books, Query(), dt.date(2026, 1, 1), dt.date(2026, 3, 1))
    rent = compared.where("account = 'expenses:housing'").orderBy("period").collect()
    assert [(r.amount, r.previous, r.change) for r in rent] == [(0, 0, 0), (900, 0, 900), (0, 900, -900)]
    saved = {r.period.month: r.saved for r in analyses.savings(books, Query()).collect()}
    assert saved == {1: D(3000), 2: D(-900), 3: D("-34.5")}
    trend = pricing.net_worth_trend(books, "EUR", Query(period="monthly"), TODAY).where("period = '2026-03-01'")
    assert {(r.commodity, r.net_worth) for r in trend.collect()} == {("EUR", D("2061.50"))}


def test_date_terms_bound_both_sides(spark, books, tmp_path):
    from tallyframe.operators.query import date_bounds

    assert date_bounds(["payee:x"]) == (None, None)
    assert date_bounds(["date:2026", "date:2026-03"]) == (dt.date(2026, 3, 1), dt.date(2026, 4, 1))
    path = str(tmp_path / "postings")
    books.postings.write.parquet(path)
    stored = books.having(postings=spark.read.parquet(path))
    rows = matching_transactions(stored, ["acct:^expenses", "date:2026-03"])
    assert {r.tindex for r in rows.collect()} == {4, 5, 6}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2026-03-01)" in plan and "LessThan(date,2026-04" in plan
    scan = plan[plan.index("ReadSchema: struct<tindex") :].split("\n")[0]
    assert "quantity" not in scan  # only what the term needs is read


def test_unknown_terms_are_refused(books):
    with pytest.raises(ValueError):
        matching_transactions(books, ["real:1"])


def test_bare_terms_are_account_patterns(books):
    found = lambda *terms: {r.tindex for r in matching_transactions(books, list(terms)).collect()}
    assert found("expenses:food") == {4, 5} and found("expenses:food", "payee:aroma") == {5}
    assert found("^assets:cash:uah$") == {3} and found("colour:red") == set()
