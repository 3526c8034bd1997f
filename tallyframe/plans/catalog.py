"""Named queries: every operator applied to a folder of tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.functions import amounts as A, text as X
from tallyframe.functions.accounts import depth_clip, depth_of
from tallyframe.functions.dates import period_start, prefix_range, preset_range
from tallyframe.functions.journal import evaluated
from tallyframe.model import AMOUNT, Ledger
from tallyframe.operators import analyses, checkpoints, edit, events as ev, lists, pricing, register as reg, reports, sessions, validate
from tallyframe.operators.assertions import assertion_check, failed_assertions, last_asserted
from tallyframe.operators.positions import page, with_position
from tallyframe.operators.query import Query, matching_transactions, posting_lines, print_report
from tallyframe.operators.totals import spread
from tallyframe.plans.net_worth import net_worth_sheet
from tallyframe.scratch import scratch_path, shuffles_dropped
from tallyframe.sinks import journal as out, tables as sink, versions
from tallyframe.sources import journal as src, json_reports as js, storage
from tallyframe.sources.tables import OrderBooks, table

TODAY = dt.date(2001, 8, 1)
BASE = "USD"
YEAR = 1997
#: First and last month of the books.
MONTHS = (dt.date(1995, 1, 1), dt.date(2024, 12, 1))

Named = dict[str, Callable[[SparkSession, str], DataFrame]]
QUERIES: Named = {}


def named(fn):
    QUERIES[fn.__name__] = fn
    return fn


def books(spark: SparkSession, path: str, **window) -> Ledger:
    return OrderBooks(spark, path, **window).ledger()


def stored_books(spark: SparkSession, path: str) -> Ledger:
    """For queries that pass over the books again and again."""
    return books(spark, path).stored("transactions", "postings")


def cents(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("decimal(28,2)") for c in columns})


def q(**given) -> Query:
    return Query(**given)


# -- balances ----------------------------------------------------------------


@named
def bal(spark, path):
    return cents(reports.balance(books(spark, path), q()), "amount")


@named
def bal_depth(spark, path):
    return cents(reports.balance(books(spark, path), q(depth=1)), "amount")


def _periodic(period, **given):
    def run(spark, path):
        return cents(reports.periodic_balance(books(spark, path), q(period=period, **given)), "amount")

    return run


QUERIES["bal_daily"] = _periodic("daily")
QUERIES["bal_weekly"] = _periodic("weekly", depth=2)
QUERIES["bal_monthly"] = _periodic("monthly")
QUERIES["bal_quarterly"] = _periodic("quarterly", depth=1)
QUERIES["bal_yearly"] = _periodic("yearly", depth=2, invert=True)


@named
def bal_monthly_filled(spark, path):
    sums = reports.periodic_balance(books(spark, path), q(period="monthly"))
    return cents(reports.fill_periods(sums, "monthly", *MONTHS), "amount")


@named
def bal_pivot(spark, path):
    years = [dt.date(y, 1, 1) for y in range(MONTHS[0].year, MONTHS[1].year + 1)]
    wide = reports.pivot_periods(reports.periodic_balance(books(spark, path), q(period="yearly", depth=2)), years)
    return wide.select(
        "account", "commodity", *[F.col(f"`{y}`").cast("decimal(28,2)").alias(f"y{y.year}") for y in years]
    )


@named
def invert(spark, path):
    return cents(reports.balance(books(spark, path), q(account="^income|^liab", invert=True)), "amount")


@named
def income_statement(spark, path):
    return cents(reports.income_statement(books(spark, path), Query()), "amount")


@named
def balance_sheet(spark, path):
    return cents(reports.balance_sheet(books(spark, path), Query()), "amount")


@named
def bs_monthly(spark, path):
    held = reports.historical_balances(
        books(spark, path), q(account="^(assets|liabilities)", period="monthly", today=TODAY), TODAY
    )
    return cents(held, "amount")


@named
def stats(spark, path):
    return reports.statistics(books(spark, path), TODAY)


@named
def txn_count(spark, path):
    return reports.transaction_count(books(spark, path))


@named
def merge_amounts(spark, path):
    """All legs of an entry per kind of account; what moves between accounts of one kind is zero."""
    lots = books(spark, path).postings.select(
        "tindex", F.substring_index("account", ":", 1).alias("kind"), "commodity", "quantity",
        F.col("leg").alias("precision"), F.col("leg").alias("pos"),
    )
    return cents(reports.merge_amounts(lots, ["tindex", "kind"]), "quantity")


# -- report predicates -------------------------------------------------------


def _bal(**given):
    def run(spark, path):
        return cents(reports.balance(books(spark, path), q(**given)), "amount")

    return run


QUERIES["q_account"] = _bal(account="brand#1[0-4]$|bank")
QUERIES["q_desc"] = _bal(description="00[0-9] . [12]-")
QUERIES["q_payee"] = _bal(payee="^customer#0+[0-9]{2}$")
QUERIES["q_amount"] = _bal(amount=">=90000", account="^expenses")
QUERIES["q_amount_signed"] = _bal(amount="<-90000")
QUERIES["q_tag"] = _bal(tag="segment=mach|build")
QUERIES["q_status"] = _bal(status="pending")
QUERIES["q_window"] = _bal(begin=dt.date(1996, 2, 1), end=dt.date(1996, 5, 1))
QUERIES["q_no_future"] = _bal(account="^(income|assets:cash)", today=dt.date(2024, 1, 15))


@named
def q_date_prefix(spark, path):
    begin, end = prefix_range("1997-06")
    ledger = books(spark, path, begin=begin, end=end)
    return matching_transactions(ledger, ["date:1997-06"]).select("tindex", "date", "payee", "note", "status")


@named
def q_txn_and(spark, path):
    found = matching_transactions(
        books(spark, path), ["acct:assets:savings", "desc:transfer . [1-3]-", "status:*", "amt:>200000"]
    )
    return found.select("tindex", "date", "payee", "note")


@named
def header_postings(spark, path):
    ledger = books(spark, path)
    rows = posting_lines(ledger)
    return cents(
        rows.select("tindex", "date", "payee", "note", "txn_status", "account", "commodity", "quantity"), "quantity"
    )


@named
def print_(spark, path):
    rows = print_report(books(spark, path), ["acct:brand#7$", "date:1998"])
    return cents(
        rows.select("tindex", "date", "payee", "note", "txn_status", "leg", "account", "commodity", "quantity"),
        "quantity",
    )


QUERIES["print"] = QUERIES.pop("print_")


# -- registers and running totals --------------------------------------------


@named
def reg_postings(spark, path):
    rows = reports.posting_register(books(spark, path), q())
    return cents(rows.drop("pos"), "amount", "total")


QUERIES["reg"] = QUERIES.pop("reg_postings")


@named
def reg_monthly(spark, path):
    rows = reports.periodic_register(books(spark, path), q(period="monthly", depth=2))
    return cents(rows, "amount", "total")


@named
def aregister(spark, path):
    rows = reports.account_register(books(spark, path), "Assets:Bank", q(begin=dt.date(1998, 1, 1)))
    return cents(rows, "change", "balance")


def _checkpoints(spark, ledger, begin: dt.date) -> str:
    """Monthly checkpoints up to ``begin``, the last half year of them folded in a second time."""
    folder = scratch_path(spark, "checkpoints")
    checkpoints.fold(ledger, folder, begin)
    checkpoints.fold(ledger, folder, begin, since=begin - dt.timedelta(days=180))
    return folder


@named
def aregister_checkpoint(spark, path):
    """The register of ``aregister``, from a stored balance instead of all history."""
    ledger, begin = books(spark, path).stored("postings"), dt.date(1998, 1, 1)
    folder = _checkpoints(spark, ledger, begin)
    return cents(checkpoints.account_register(ledger, folder, "Assets:Bank", q(begin=begin)), "change", "balance")


@named
def bs_monthly_checkpoint(spark, path):
    """Month-end balances since 1998, from a stored balance instead of all history."""
    ledger, begin = books(spark, path), dt.date(1998, 1, 1)
    query = q(account="^(assets|liabilities)", period="monthly", begin=begin, today=TODAY)
    return cents(checkpoints.historical_balances(ledger, _checkpoints(spark, ledger, begin), query, TODAY), "amount")


@named
def check_assertions(spark, path):
    return cents(assertion_check(books(spark, path)), "balance", "asserted")


QUERIES["assertion_check"] = QUERIES.pop("check_assertions")


@named
def failed(spark, path):
    return cents(failed_assertions(books(spark, path)), "balance", "asserted")


QUERIES["failed_assertions"] = QUERIES.pop("failed")


@named
def latest_assertions(spark, path):
    rows = last_asserted(books(spark, path).assertions)
    return cents(rows, "asserted_quantity")


QUERIES["last_asserted"] = QUERIES.pop("latest_assertions")


# -- prices ------------------------------------------------------------------


def _all_prices(spark, path):
    made = OrderBooks(spark, path)
    return pricing.all_prices(made.prices(), made.inferred_prices())


@named
def prices_all(spark, path):
    """Every price, declared or inferred."""
    rows = _all_prices(spark, path)
    return rows.select("date", "commodity", F.col("price").cast("decimal(18,4)").alias("price"), "target", "source")


@named
def prices_latest(spark, path):
    latest = pricing.latest_prices(_all_prices(spark, path))
    return latest.select("commodity", "target", F.col("price").cast("decimal(18,4)").alias("price"), "date", "source")


@named
def base_commodity(spark, path):
    """The base by declared prices, and by inferred ones alone."""
    declared = pricing.base_commodity(_all_prices(spark, path)).withColumn("of", F.lit("all"))
    inferred = pricing.base_commodity(OrderBooks(spark, path).inferred_prices()).withColumn("of", F.lit("inferred"))
    return declared.unionByName(inferred)


@named
def price_asof(spark, path):
    """Every shipped line at the latest unit price of its part on or before its order date."""
    made = OrderBooks(spark, path)
    lines = (
        table(spark, path, "lineitem")
        .join(table(spark, path, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "l_orderkey",
            F.concat(F.lit("PART"), F.col("l_partkey").cast("string")).alias("commodity"),
            F.col("o_orderdate").cast("date").alias("date"),
            F.col("l_quantity").cast("int").alias("units"),
        )
    )
    # One price per part and day, so that the latest one is unique.
    daily = made.inferred_prices().groupBy("commodity", "target", "date", "source").agg(
        F.max("price").alias("price"), F.max("seq").alias("seq")
    )
    found = pricing.price_asof(lines, daily)
    return found.select(
        "l_orderkey", "commodity", "date", "units", "target", F.col("price").cast("decimal(18,2)").alias("price"), "price_date"
    )


@named
def price_graph(spark, path):
    """Rates toward the base for the commodities the books hold, per year end."""
    made = OrderBooks(spark, path)
    yearly = pricing.period_prices(made.prices(), "yearly", TODAY)
    rates = pricing.price_paths(yearly, BASE, by=["period"])
    used = made.postings().select("commodity", period_start(F.col("date"), "yearly").alias("period")).distinct()
    return used.join(rates, ["commodity", "period"], "left").select(
        "commodity", "period", F.round("rate", 8).alias("rate"), F.col("hops"), F.col("turns")
    )


@named
def valued_sheet(spark, path):
    return pricing.valued_sheet(books(spark, path), BASE, Query(), TODAY)


@named
def sheet_with_assertions(spark, path):
    return net_worth_sheet(books(spark, path), BASE, as_of=TODAY)


@named
def net_worth_trend(spark, path):
    return pricing.net_worth_trend(books(spark, path), BASE, q(period="monthly", today=TODAY), TODAY)


# -- the register ------------------------------------------------------------


@named
def split_legs(spark, path):
    rows = reg.split_legs(books(spark, path).postings)
    return cents(rows.select("tindex", "leg", "account", "commodity", "quantity", "shown"), "quantity")


def _filtered(**given):
    def run(spark, path):
        found = reg.apply_filters(books(spark, path), reg.Filters(**given))
        return found.select("tindex", "date", "payee", "note", "status")

    return run


QUERIES["reg_search"] = _filtered(search="BRAND#11")
QUERIES["reg_search_tag"] = _filtered(search="segment: mach")
QUERIES["reg_date"] = _filtered(first=dt.date(1999, 3, 10), last=dt.date(1999, 3, 20))
QUERIES["reg_payee"] = _filtered(payees=("Internal Transfer", "User 7", "Customer#000000011"))
QUERIES["reg_account"] = _filtered(accounts=("Assets:Savings", "Expenses:ECONOMY:Brand#3"))
QUERIES["reg_amount"] = _filtered(least=Decimal(100), most=Decimal(20000))
QUERIES["reg_commodity"] = _filtered(commodities=("GBP", "CHF"))
QUERIES["reg_status"] = _filtered(statuses=("Pending", "Unmarked"))
QUERIES["reg_tag"] = _filtered(tags=("priority",))
QUERIES["reg_all_filters"] = _filtered(
    search="economy",
    first=dt.date(1996, 1, 1),
    last=dt.date(1999, 12, 31),
    least=Decimal(50000),
    commodities=("USD", "EUR"),
    statuses=("Cleared",),
    tags=("segment",),
)


@named
def reg_preset(spark, path):
    ledger = books(spark, path)
    out = None
    for preset in ("last-7-days", "last-30-days", "this-month", "last-month", "this-year", "last-year"):
        first, last = preset_range(preset, TODAY)
        rows = reg.apply_filters(ledger, reg.Filters(first=first, last=last)).agg(F.count("*").alias("n"))
        rows = rows.select(F.lit(preset).alias("preset"), F.lit(first).alias("first"), F.lit(last).alias("last"), "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@named
def reg_hide_assertions(spark, path):
    """Order books with their assertion entries: the register without the latter."""
    ledger = _with_assertion_entries(books(spark, path))
    return reg.hide_assertions(ledger).select("tindex", "date", "payee")


def _with_assertion_entries(ledger: Ledger) -> Ledger:
    """Assertions as journal entries of their own, plus one that moves money: every
    hundredth assertion entry pays its balance."""
    entries = ledger.assertions
    heads = entries.select(
        "tindex", "date", F.lit("Balance Assertion").alias("payee"), F.lit("").alias("note"),
        F.lit("Cleared").alias("status"),
    )
    paid = F.when(F.col("tindex") % 100 == 0, F.col("quantity")).otherwise(0).cast("decimal(28,8)")
    legs = entries.withColumns({"quantity": paid, "pos": F.lit(0), "is_assertion": F.lit(True)})
    return ledger.having(
        transactions=ledger.transactions.unionByName(heads, allowMissingColumns=True),
        postings=ledger.postings.unionByName(legs, allowMissingColumns=True),
    )


@named
def reg_count(spark, path):
    return reg.register_count(books(spark, path), reg.Filters(search="brand#2", statuses=("Cleared",)))


@named
def facet_counts(spark, path):
    return reg.facet_counts(stored_books(spark, path), reg.Filters(statuses=("Pending",), commodities=("EUR", "UAH")))


@named
def facet_options(spark, path):
    return with_position(reg.facet_options(books(spark, path)))


@named
def reg_order(spark, path):
    return with_position(reg.register_order(books(spark, path).transactions).select("tindex", "date", "payee"))


@named
def reg_order_rising(spark, path):
    """Oldest first: a day then lists payees Z-A."""
    rows = reg.register_order(books(spark, path).transactions, descending=False)
    return with_position(rows.select("tindex", "date", "payee"))


@named
def reg_page(spark, path):
    """The third page of the register by payee, 500 transactions a page."""
    rows = reg.register_sorted(reg.register_rows(books(spark, path)), "payee")
    return page(with_position(rows.select("tindex", "payee", "lead_account")), 3, 500)


@named
def reg_sorted(spark, path):
    rows = reg.register_sorted(reg.register_rows(books(spark, path)), "amount", descending=True)
    rows = rows.select("tindex", "payee", "lead_account", "lead_quantity", "tags_text")
    return cents(with_position(rows), "lead_quantity")


@named
def nw_search(spark, path):
    rows = reports.sheet_rows(books(spark, path))
    return cents(reg.sheet_search(rows, "BANK:m"), "amount")


@named
def nw_order(spark, path):
    rows = net_worth_sheet(books(spark, path), BASE, as_of=TODAY)
    return with_position(reg.sheet_order(rows, "asserted", descending=True).select("section", "account", "asserted_on"))


@named
def list_accounts(spark, path):
    return with_position(lists.list_accounts(books(spark, path)))


@named
def list_payees(spark, path):
    return with_position(lists.list_payees(books(spark, path)))


@named
def list_tags(spark, path):
    return with_position(lists.list_tags(books(spark, path)))


# -- scalar functions --------------------------------------------------------


@named
def split_description(spark, path):
    """Descriptions as journals hold them, split again."""
    heads = books(spark, path).transactions
    text = F.concat(F.lit(" "), X.join_description(F.col("payee"), F.col("note")), F.lit(" "))
    parts = X.split_description(text)
    return heads.select("tindex", parts["payee"].alias("payee"), parts["note"].alias("note"))


@named
def tag_text(spark, path):
    return books(spark, path).transactions.select("tindex", X.tags_text(F.col("tags"), ", ").alias("tags_text"))


@named
def depth(spark, path):
    names = books(spark, path).postings.select("account").distinct()
    return names.select(
        "account",
        depth_of(F.col("account")).alias("depth"),
        depth_clip(F.col("account"), 1).alias("one"),
        depth_clip(F.col("account"), 2).alias("two"),
    )


QUERIES["depth_clip"] = QUERIES.pop("depth")


@named
def period(spark, path):
    days = books(spark, path).transactions.select("date").distinct()
    return days.select(
        "date",
        *[period_start(F.col("date"), p).alias(p) for p in ("daily", "weekly", "monthly", "quarterly", "yearly")],
    )


@named
def iso_date(spark, path):
    """Order dates as text, made wrong in three ways."""
    orders = table(spark, path, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(F.col("o_orderkey") % 4 == 1, F.concat(F.substring(day, 1, 8), F.lit("31")))
        .when(F.col("o_orderkey") % 4 == 2, F.regexp_replace(day, "-0", "-"))
        .when(F.col("o_orderkey") % 4 == 3, F.concat(F.substring(day, 1, 5), F.lit("13-01")))
        .otherwise(day)
    )
    rows = orders.select("o_orderkey", text.alias("text"))
    return validate.check_dates(rows, "text")


def _price_amounts(spark, path):
    """Amounts of many sizes and precisions: unit prices and totals of lines."""
    lines = table(spark, path, "lineitem")
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    digits = (F.col("l_partkey") % 9).cast("int")
    quantity = (
        F.when(F.col("l_suppkey") % 4 == 0, F.round(price / 1_000_000, 6))
        .when(F.col("l_suppkey") % 4 == 1, -price)
        .when(F.col("l_suppkey") % 4 == 2, price * 1000)
        .otherwise(price)
        .cast("decimal(28,8)")
    )
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.struct(quantity.alias("quantity"), F.lit("EUR").alias("commodity"), digits.alias("precision"))
        .cast(AMOUNT)
        .alias("a"),
    )


@named
def fmt_amount(spark, path):
    rows = _price_amounts(spark, path)
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        A.fmt_amount(F.col("a"), "native").alias("native"),
        A.fmt_amount(F.col("a"), "value").alias("value"),
    )


@named
def fmt_compact(spark, path):
    rows = _price_amounts(spark, path)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", A.compact_number(F.col("a.quantity")).alias("compact")
    )


def _figures(spark, path):
    """Each order as a figure: its total natively, and half of it left in CHF."""
    orders = table(spark, path, "orders")
    total = F.col("o_totalprice").cast("decimal(18,2)")

    def amount(quantity, commodity):
        return F.struct(
            quantity.cast("decimal(28,8)").alias("quantity"), F.lit(commodity).alias("commodity"), F.lit(2).alias("precision")
        ).cast(AMOUNT)

    native = F.array(amount(total, "EUR"), amount(F.lit(10), "CHF"))
    priced = F.array(amount(F.lit(10), "CHF"), amount(total * 2, "USD"))
    return orders.select(
        "o_orderkey",
        native.alias("amounts"),
        F.when(F.col("o_orderstatus") == "F", priced)
        .when(F.col("o_orderstatus") == "P", F.array(amount(total * 2, "USD")))
        .otherwise(native)
        .alias("figure"),
    )


@named
def fmt_value(spark, path):
    rows = _figures(spark, path)
    lead = A.value_lead(F.col("amounts"), F.col("figure"), F.lit(BASE))
    return rows.select(
        "o_orderkey",
        A.is_converted(F.col("amounts"), F.col("figure")).alias("is_converted"),
        A.fmt_amounts(F.col("amounts")).alias("native"),
        A.fmt_value(F.col("amounts"), F.col("figure")).alias("value"),
        lead["lead"].alias("lead"),
        lead["tail"].alias("tail"),
        A.fmt_compact(F.col("amounts"), F.col("figure"), F.lit(BASE)).alias("compact"),
    )


@named
def fmt_amounts(spark, path):
    rows = _figures(spark, path)
    return rows.select(
        "o_orderkey",
        A.fmt_amounts(F.col("amounts"), "native").alias("native"),
        A.fmt_amounts(F.col("figure"), "value").alias("value"),
    )


@named
def is_converted(spark, path):
    rows = _figures(spark, path)
    changed = A.is_converted(F.col("amounts"), F.col("figure"))
    return rows.groupBy(changed.alias("is_converted")).agg(F.count("*").alias("n"))


@named
def value_lead(spark, path):
    """The base leg of a figure when the base is USD, EUR or not among its legs."""
    rows = _figures(spark, path).withColumn(
        "base", F.element_at(F.array(F.lit("USD"), F.lit("EUR"), F.lit("XXX")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    )
    lead = A.value_lead(F.col("amounts"), F.col("figure"), F.col("base"))
    return rows.select("o_orderkey", lead["lead"].alias("lead"), lead["tail"].alias("tail"))


# -- validation --------------------------------------------------------------


@named
def unbalanced(spark, path):
    """The books balance; with every refund taken out they do not."""
    ledger = books(spark, path)
    torn = ledger.having(postings=ledger.postings.where("not (account like 'Expenses%' and quantity < 0)"))
    return cents(validate.unbalanced(torn), "amount")


@named
def undeclared(spark, path):
    return validate.undeclared(books(spark, path))


@named
def validate_ledger(spark, path):
    return validate.validate(books(spark, path))


QUERIES["validate"] = QUERIES.pop("validate_ledger")


@named
def check_inputs(spark, path):
    """Orders submitted as entries; those short of lines or with odd values are named."""
    orders = table(spark, path, "orders").select(
        F.col("o_orderkey").alias("item"),
        F.when(F.col("o_orderkey") % 50 == 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("date"),
    )
    legs = table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("item"),
        F.concat(F.lit("Expenses:"), F.col("l_partkey").cast("string")).alias("account"),
        F.when(F.col("l_discount") < 0.1, F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount"),
        F.when(F.col("l_tax") < 0.08, F.lit("USD")).otherwise(F.lit("")).alias("currency"),
    )
    return validate.check_inputs(orders, legs)


@named
def check_assertion_inputs(spark, path):
    rows = table(spark, path, "events").select(
        F.col("event_id").alias("item"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("Assets:"), "event_type")).alias("account"),
        F.when(F.col("event_type") != "view", F.col("value").cast("decimal(18,2)")).alias("amount"),
        F.when(F.col("user_id") % 7 != 0, F.lit("USD")).alias("currency"),
    )
    return validate.check_assertion_inputs(rows)


@named
def check_price_inputs(spark, path):
    rows = table(spark, path, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("item"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linestatus") == "O", F.concat(F.lit("PART"), F.col("l_partkey").cast("string"))).alias("commodity"),
        (F.col("l_extendedprice").cast("decimal(18,2)") - 50000).cast("decimal(18,2)").alias("amount"),
        F.when(F.col("l_returnflag") != "R", F.lit("USD")).alias("target"),
    )
    return validate.check_price_inputs(rows)


# -- corrections -------------------------------------------------------------

MOVE = edit.Edit(("payee:^customer#", "date:1997", "acct:brand#5$"), "change_account", "Expenses:Moved", "Expenses:ECONOMY:Brand#5")
RENAME = edit.Edit(("desc:transfer", "status:pending"), "change_payee", "Own Transfer", "Internal Transfer")
MARK = edit.Edit(("acct:^liabilities", "date:1998"), "set_status", "cleared")


@named
def edit_targets(spark, path):
    return edit.edit_targets(books(spark, path), MOVE)


@named
def edit_account(spark, path):
    ledger = books(spark, path)
    rows = edit.rewrite(ledger, MOVE).postings
    return cents(rows.select("tindex", "leg", "account", "commodity", "quantity"), "quantity")


@named
def edit_payee(spark, path):
    return edit.rewrite(books(spark, path), RENAME).transactions.select("tindex", "payee", "status")


@named
def edit_status(spark, path):
    return edit.rewrite(books(spark, path), MARK).transactions.select("tindex", "payee", "status")


@named
def ledger_diff(spark, path):
    ledger = books(spark, path)
    keep = ["tindex", "leg", "account", "commodity", "quantity"]
    changed = edit.diff(ledger.postings.select(*keep), edit.rewrite(ledger, MOVE).postings.select(*keep))
    return cents(changed, "quantity")


@named
def edit_summary(spark, path):
    ledger = stored_books(spark, path)
    rows = None
    for change in (MOVE, RENAME, MARK):
        one = edit.edit_summary(ledger, edit.rewrite(ledger, change), change)
        rows = one if rows is None else rows.unionByName(one)
    return rows


@named
def edit_dry_run(spark, path):
    """Changes of a dry run next to what keeps the books from being valid afterwards."""
    ledger = stored_books(spark, path)
    result = edit.apply_edit(ledger, MOVE, "", dry_run=True)
    return (
        result.changes.groupBy(F.concat(F.lit("change "), "side").alias("what"))
        .agg(F.sum("copies").alias("n"))
        .unionByName(result.violations.groupBy(F.col("rule").alias("what")).agg(F.count("*").alias("n")))
    )


@named
def version_edits(spark, path):
    """Order books in versions: accounts moved, then payees renamed; an edit of the version before is
    refused.  Rows that the first and the last version do not share, told from folders they do not share."""
    folder = scratch_path(spark, "versions")
    ledger = books(spark, path)
    first = versions.create(Ledger(ledger.transactions, ledger.postings), folder)
    second = versions.commit_edit(spark, folder, MOVE, first)
    versions.commit_edit(spark, folder, RENAME, second)
    try:
        versions.commit_edit(spark, folder, MARK, second)
    except versions.Conflict:
        last = versions.version(spark, folder)
    else:
        raise AssertionError("an edit of an old version was stored")
    legs = versions.version_diff(spark, first, last, "postings").select(
        F.lit("postings").alias("frame"), "side", "tindex", "leg", F.col("account").alias("value"), "copies"
    )
    heads = versions.version_diff(spark, first, last, "transactions").select(
        F.lit("transactions").alias("frame"), "side", "tindex", F.lit(None).cast("int").alias("leg"),
        F.col("payee").alias("value"), "copies",
    )
    rows = legs.unionByName(heads)
    return rows.groupBy(*[c for c in rows.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))


# -- composed analyses -------------------------------------------------------


@named
def top_payees(spark, path):
    return cents(analyses.top_payees(books(spark, path), q(), k=25), "amount")


@named
def biggest_purchase(spark, path):
    begin, end = dt.date(YEAR, 1, 1), dt.date(YEAR + 1, 1, 1)
    return cents(analyses.biggest_purchase(books(spark, path, begin=begin, end=end), YEAR), "amount")


@named
def compare_months(spark, path):
    first, last = dt.date(1995, 1, 1), dt.date(2001, 8, 1)
    rows = analyses.compare_months(books(spark, path), q(today=TODAY), first, last)
    return cents(rows, "amount", "previous", "change")


@named
def spending_by_month(spark, path):
    return cents(analyses.spending_by_month(books(spark, path), q()), "amount")


@named
def savings(spark, path):
    return cents(analyses.savings(books(spark, path), Query()), "earned", "spent", "saved")


@named
def by_currency(spark, path):
    return cents(analyses.by_currency(books(spark, path)), "amount")


@named
def tag_cost(spark, path):
    return cents(analyses.tag_cost(books(spark, path), "priority=urgent", q()), "amount")


@named
def duplicates(spark, path):
    """Postings look alike when one payee moves the same sum on an account twice in a day;
    to have hits at any size, sums are compared in whole tens."""
    ledger = books(spark, path)
    coarse = ledger.postings.withColumn(
        "quantity", F.round(F.col("quantity") / 10).cast("decimal(28,8)")
    )
    return cents(analyses.duplicates(ledger.having(postings=coarse)), "quantity")


@named
def recurring(spark, path):
    rows = analyses.recurring(books(spark, path), q(depth=None), least=2)
    return cents(rows, "last_amount", "change")


@named
def budget(spark, path):
    """A budget per part type: a hundredth of its parts' list price."""
    plan = (
        table(spark, path, "part")
        .groupBy(F.concat(F.lit("Expenses:"), "p_type").alias("account"))
        .agg((F.sum(F.col("p_retailprice").cast("decimal(18,2)")) / 100).cast("decimal(18,2)").alias("monthly"))
        .withColumn("commodity", F.lit("USD"))
    )
    return cents(analyses.budget_status(books(spark, path), plan, q()), "budget", "spent", "left")


@named
def uncategorized(spark, path):
    return cents(analyses.uncategorized(books(spark, path), q(), "expenses:standard"), "amount")


# -- sessions, events, documents ---------------------------------------------


@named
def session_summary(spark, path):
    return sessions.session_summary(table(spark, path, "conversations"))


@named
def session_title(spark, path):
    return sessions.session_titles(table(spark, path, "conversations"))


@named
def session_groups(spark, path):
    """Users as sessions, last seen at their last event."""
    seen = table(spark, path, "events").groupBy("user_id").agg(F.max("ts").alias("modified"))
    rows = sessions.session_groups(seen, dt.date(2024, 1, 30), "user_id")
    return with_position(
        rows.select("user_id", F.date_format("modified", "yyyy-MM-dd HH:mm:ss").alias("modified"), "label")
    )


def _marked_messages(spark, path):
    """Messages with the directives and markers a composer would put into them."""
    n = F.col("conv_id") * 100 + F.col("turn")
    label = F.concat(F.lit("acc"), n.cast("string"))
    marker = F.concat(
        F.lit('[[attachment]]{"name": "f'), n.cast("string"), F.lit('.pdf", "path": "files/f'), n.cast("string"),
        F.lit('.pdf", "size": '), (n * 7).cast("string"), F.lit("}"),
    )
    more = (
        F.when(n % 3 == 0, F.concat(F.lit("see :account["), label, F.lit("]{name=x} and :tag[trip]\n"), marker))
        .when(n % 3 == 1, F.concat(marker, F.lit("\n[[attachment]]{broken")))
        .otherwise(F.concat(F.lit("pay :payee[Shop "), n.cast("string"), F.lit("] at 10:30 :foo[x]")))
    )
    text = F.concat(F.col("text"), F.lit("\n"), more)
    return table(spark, path, "conversations").select("conv_id", "turn", text.alias("text"))


@named
def mentions(spark, path):
    rows = _marked_messages(spark, path).select("conv_id", "turn", F.posexplode(X.mentions(F.col("text"))).alias("n", "m"))
    return rows.select("conv_id", "turn", "n", "m.type", "m.label")


@named
def mentions_plain(spark, path):
    rows = _marked_messages(spark, path)
    return rows.select(
        "conv_id",
        "turn",
        F.md5(X.mentions_plain(F.col("text"))).alias("plain"),
        F.md5(X.without_attachments(F.col("text"))).alias("visible"),
        X.session_title(F.col("text")).alias("title"),
    )


@named
def attachment_refs(spark, path):
    rows = _marked_messages(spark, path).select(
        "conv_id", "turn", F.posexplode(X.attachment_refs(F.col("text"))).alias("n", "r")
    )
    return rows.select("conv_id", "turn", "n", "r.name", "r.path", "r.size")


@named
def first_events(spark, path):
    rows = ev.first_events(table(spark, path, "events"))
    return rows.select("user_id", "event_type", "event_id")


@named
def gated_events(spark, path):
    """Users whose first event is an error have opted out."""
    events = table(spark, path, "events")
    first = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("t"))
    out = first.where("t = 'error'").select("user_id")
    return ev.gated_events(events, out).select("event_id", "user_id", "event_type")


@named
def milestones(spark, path):
    events = table(spark, path, "events")
    first = events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("t"))
    return ev.milestones(events, first.where("t = 'error'").select("user_id")).select("user_id", "event_type", "event_id")


@named
def page_profile(spark, path):
    """Documents with a form feed after every paragraph: each is then a page."""
    paged = table(spark, path, "documents").select("doc_id", F.regexp_replace("text", "\n", "\f").alias("text"))
    rows = ev.page_profile(paged)
    return rows.select(
        "doc_id", "pages", F.round("chars_per_page", 6).alias("chars_per_page"), "needs_ocr", F.md5("page_text").alias("page_text")
    )


# -- readers and writers -----------------------------------------------------


def _order_document():
    """An order as transaction JSON, with odd ones among them."""
    key = F.col("o_orderkey")
    total = F.col("o_totalprice")

    def amount(number, style, places):
        return F.concat(
            F.lit('{"acommodity":"USD","aquantity":{"decimalMantissa":0,"decimalPlaces":'), places,
            F.lit(',"floatingPoint":'), number, F.lit('},"astyle":{"asprecision":'), style, F.lit("}}"),
        )

    number = total.cast("decimal(18,2)").cast("string")
    minus = F.concat(F.lit("-"), number)
    style = F.when(key % 3 == 0, F.lit("null")).otherwise(F.lit("2"))
    places = F.when(key % 2 == 0, F.lit("3")).otherwise(F.lit("null"))
    first = F.concat(F.lit('{"paccount":"Expenses:Orders","pdate":null,"pamount":['), amount(number, style, places), F.lit("]}"))
    second = F.concat(
        F.lit('{"paccount":"Assets:Bank","pdate":"2001-01-01","pamount":['), amount(minus, style, places),
        F.lit('],"pbalanceassertion":{"baamount":'), amount(number, style, places), F.lit("}}"),
    )
    odd = F.concat(
        F.lit('{"paccount":"","pamount":[]},42,{"paccount":"Bad:Amount","pamount":[{"acommodity":5}]},{"paccount":"Lots}]","pamount":['),
        amount(F.lit("10"), style, places), F.lit(','), amount(minus, F.lit("1"), places), F.lit(','), amount(F.lit("0"), style, places),
        F.lit("]}"),
    )
    index = F.when(key % 11 == 0, F.concat(F.lit('"'), key.cast("string"), F.lit('"'))).otherwise(key.cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", F.lit("Cleared")).otherwise(F.col("o_orderstatus"))
    doc = F.concat(
        F.lit('[{"tindex":'), index, F.lit(',"tdate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.lit('","tdescription":"Customer '), F.col("o_custkey").cast("string"), F.lit(" | "), F.col("o_orderpriority"),
        F.lit('","tstatus":"'), status, F.lit('","ttags":[["priority","'), F.col("o_orderpriority"),
        F.lit('"],["bare",""],[7,"x"]],"tpostings":['), first, F.lit(","), second, F.lit(","), odd, F.lit("]}]"),
    )
    return F.when(key % 13 == 0, F.substring(doc, 3, 40)).otherwise(doc)


def _order_json(spark, path):
    """One document per order."""
    return table(spark, path, "orders").select(_order_document().alias("json"))


def _element(document):
    """The one element of a document, which is a list."""
    opened = F.when(document.startswith("["), F.substring(document, F.lit(2), F.length(document))).otherwise(document)
    return F.when(opened.endswith("]"), F.substring(opened, F.lit(1), F.length(opened) - 1)).otherwise(opened)


@named
def read_transactions_json(spark, path):
    return _json_rows(js.read_transactions(_order_json(spark, path)))


def _json_rows(ledger):
    heads = ledger.transactions.select(
        "tindex", "date", "payee", "note", "status", X.tags_text(F.col("tags"), ", ").alias("tags_text")
    )
    legs = ledger.postings.select("tindex", "leg", "pdate", "account", "commodity", "quantity", "precision", "is_assertion")
    return cents(heads.join(legs, "tindex"), "quantity")


@named
def read_transactions_array(spark, path):
    """The same documents as elements of large JSON arrays, a file per hundred thousand order keys."""
    orders = table(spark, path, "orders").withColumn("bucket", F.floor(F.col("o_orderkey") / 100_000))
    orders = evaluated(orders, json=_order_document()).where(_element(F.col("json")).like("{%"))
    by = Window.partitionBy("bucket").orderBy("o_orderkey")
    first, last = F.lag("o_orderkey").over(by).isNull(), F.lead("o_orderkey").over(by).isNull()
    # Orders are shuffled, their documents made after that.
    placed = orders.drop("json").repartition("bucket").withColumns({"first": first, "last": last})
    lines = evaluated(placed, json=_order_document()).select(
        F.concat(
            F.when(F.col("first"), F.lit("[")).otherwise(F.lit(",")), _element(F.col("json")),
            F.when(F.col("last"), F.lit("]")).otherwise(F.lit("")),
        ).alias("value"),
        "bucket", "o_orderkey",
    )
    place = scratch_path(spark, "arrays")
    with shuffles_dropped(spark):
        lines.sortWithinPartitions("bucket", "o_orderkey").drop("o_orderkey").write.partitionBy("bucket").text(place, compression="gzip")
    return _json_rows(js.read_transactions(js.json_array_documents(spark, place)))


@named
def read_assertions_json(spark, path):
    rows = js.read_transactions(_order_json(spark, path)).assertions
    return cents(rows.select("tindex", "leg", "date", "account", "quantity", "commodity", "precision"), "quantity")


def _sheet_json(spark, path):
    """One compound balance sheet per customer."""
    number = F.col("c_acctbal").cast("decimal(18,2)").cast("string")

    def amount(value, commodity):
        return F.concat(
            F.lit('{"acommodity":"' + commodity + '","aquantity":{"floatingPoint":'), value,
            F.lit(',"decimalPlaces":2},"astyle":{"asprecision":2}}'),
        )

    lots = F.concat(F.lit("[["), amount(number, "EUR"), F.lit(","), amount(F.lit("-0.5"), "EUR"), F.lit(","), amount(F.lit("0"), "USD"), F.lit("]]"))
    rows = F.concat(
        F.lit('[{"prrName":"Assets:'), F.col("c_mktsegment"), F.lit('","prrAmounts":'), lots,
        F.lit('},{"prrName":7},{"prrName":"Assets:Empty","prrAmounts":[[]]}]'),
    )
    doc = F.concat(
        F.lit('{"cbrSubreports":[["Assets",{"prRows":'), rows, F.lit(',"prTotals":{"prrAmounts":'), lots,
        F.lit('}},true],["Liabilities",{"prRows":[],"prTotals":{"prrAmounts":[[]]}},false],"odd"],"cbrTotals":{"prrAmounts":'),
        lots, F.lit("}}"),
    )
    return table(spark, path, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 17 == 0, F.lit('{"cbrSubreports":5}')).otherwise(doc).alias("json")
    )


@named
def read_balance_sheet_json(spark, path):
    """Parsed rows with the lots of each figure merged."""
    rows = js.read_balance_sheet(_sheet_json(spark, path), key="c_custkey")
    keys = ["c_custkey", "kind", "section", "account"]
    merged = reports.merge_amounts(rows.where("quantity is not null"), keys)
    figures = rows.select(*keys).distinct().join(merged, keys, "left")
    return cents(figures.select(*keys, "commodity", "quantity"), "quantity")


def _price_lines(spark, path):
    """Unit prices of lines as price directives in four spellings."""
    lines = OrderBooks(spark, path).inferred_prices()
    price = F.col("price").cast("decimal(18,2)").cast("string")
    day = F.col("date").cast("string")
    spelled = (
        F.when(F.col("seq") % 4 == 0, F.concat(F.lit("USD"), price))
        .when(F.col("seq") % 4 == 1, F.concat(F.format_number(F.col("price"), 2), F.lit(" USD")))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit("$"), price))
        .otherwise(F.concat(price, F.lit(' "UAH"')))
    )
    text = F.concat(F.lit("P "), day, F.lit(' "'), F.col("commodity"), F.lit('" '), spelled)
    return lines.select("seq", F.when(F.col("seq") % 10 == 0, F.concat(F.lit("P "), day, F.lit(" X"))).otherwise(text).alias("line"))


@named
def read_prices(spark, path):
    rows = src.price_directives(_price_lines(spark, path))
    return rows.select("seq", "date", "commodity", F.col("price").cast("decimal(18,2)").alias("price"), "target")


@named
def render_journal(spark, path):
    return out.render_journal(books(spark, path), two_decimals=True).select("tindex", "part", "side", "line")


@named
def read_journal(spark, path):
    """Books written as month folders of journal text, then read back."""
    place = scratch_path(spark, "journal")
    out.write_journal(out.render_journal(books(spark, path), blank_lines=True), place, codec="gzip")
    ledger = src.read_journal(src.journal_lines(spark, place))
    heads = ledger.transactions.select(
        "tindex", "date", "payee", "note", "status", X.tags_text(F.col("tags"), ", ").alias("tags_text")
    )
    legs = spread(ledger.postings, "tindex").groupBy("tindex", "account", "commodity").agg(
        F.count("*").alias("legs"), F.sum("quantity").alias("quantity")
    )
    # The journal numbers transactions anew, so the number is not compared.
    return cents(heads.join(legs, "tindex").drop("tindex"), "quantity")


def _appended(spark, path) -> str:
    """Books appended as two batches, entries with even numbers first; one batch comes twice."""
    place, ledger = scratch_path(spark, "batches"), stored_books(spark, path)
    half = lambda n: ledger.having(
        transactions=ledger.transactions.where(F.col("tindex") % 2 == n), postings=ledger.postings.where(F.col("tindex") % 2 == n)
    )
    for name, n in (("even", 0), ("odd", 1), ("even", 0)):
        out.append_journal(half(n), place, name, codec="gzip")
    return place


def _appended_rows(ledger):
    heads = ledger.transactions.select(
        F.col("tindex").alias("position"), "date", "payee", "note", "status", X.tags_text(F.col("tags"), ", ").alias("tags_text"),
        F.regexp_extract("source_file", r"/batch=0*(\d+)-", 1).cast("int").alias("batch"),
    )
    legs = spread(ledger.postings, "tindex").groupBy(F.col("tindex").alias("position"), "account", "commodity").agg(
        F.count("*").alias("legs"), F.sum("quantity").alias("quantity")
    )
    return cents(heads.join(legs, "position"), "quantity")


@named
def journal_append(spark, path):
    """Two batches of the books, one of them sent twice, read back with the order of their entries."""
    return _appended_rows(src.read_journal(src.journal_lines(spark, _appended(spark, path))))


@named
def journal_months(spark, path):
    """Three months of an appended journal; no other folder is read."""
    lines = src.journal_lines(spark, _appended(spark, path), dt.date(1996, 2, 10), dt.date(1996, 5, 1))
    return _appended_rows(src.read_journal(lines))


@named
def render_assertions(spark, path):
    return out.render_assertions(books(spark, path).assertions, two_decimals=True)


@named
def render_prices(spark, path):
    prices = OrderBooks(spark, path).inferred_prices()
    return out.render_prices(prices).select("date", "seq", "line")


@named
def missing_declarations(spark, path):
    return out.missing_declarations(books(spark, path))


@named
def read_declarations(spark, path):
    """The chart of accounts as declaration lines, read back."""
    made = OrderBooks(spark, path)
    accounts = made.postings().select("account").distinct()
    lines = accounts.select(
        F.concat(F.lit("account "), "account", F.lit("  ; kept since "), F.length("account").cast("string")).alias("line")
    ).unionByName(
        made.postings().select("commodity").distinct().select(F.concat(F.lit("commodity 1,000.00 "), "commodity").alias("line"))
    )
    return src.account_declarations(lines).unionByName(
        src.commodity_declarations(lines).select(F.col("commodity").alias("account"), F.lit("commodity").alias("comment"))
    )


@named
def month_layout(spark, path):
    """Postings appended by month, then two months read back."""
    place = scratch_path(spark, "months")
    sink.append_months(books(spark, path).postings, place)
    rows = storage.read_months(spark, place, dt.date(1996, 2, 10), dt.date(1996, 4, 5))
    return cents(rows.select("tindex", "date", "account", "commodity", "quantity"), "quantity")


@named
def file_catalog(spark, path):
    """Web pages as stored documents of a few types."""
    kinds = F.array(*[F.lit(k) for k in (".pdf", ".csv", ".PNG", ".xlsx", ".jpeg", "", ".", ".tar.gz")])
    pages = table(spark, path, "pages")
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.element_at(kinds, (F.col("page_id") % 8 + 1).cast("int")))
    month = F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0")
    files = pages.select(
        F.concat(F.lit("/files/2024/"), month, F.lit("/"), name).alias("path"),
        (F.length("html") * (F.col("page_id") % 5 + 1) * F.when(F.col("page_id") % 3 == 0, 977).otherwise(1))
        .cast("bigint").alias("length"),
    )
    return storage.file_catalog(files)


@named
def export_csv(spark, path):
    """Customer rows with awkward cells, exported and read back as raw lines."""
    rows = table(spark, path, "customer").select(
        "c_custkey",
        F.concat(F.lit("  "), "c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(', "Ltd"')).otherwise(F.lit("")), F.lit(" ")).alias("name"),
        F.when(F.col("c_custkey") % 5 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )
    place = scratch_path(spark, "csv")
    sink.export_csv(rows, place)
    lines = spark.read.text(place, lineSep="\r\n").where("value <> 'c_custkey,name,segment'")
    return lines.select(F.col("value").alias("line"))


@named
def output_formats(spark, path):
    """One report in every format, read back as raw lines."""
    report = reports.balance(books(spark, path), q(depth=2)).select(
        "account", "commodity", F.col("amount").cast("decimal(28,2)").alias("amount")
    )
    rows = None
    for fmt in sink.FORMATS:
        place = scratch_path(spark, fmt)
        sink.write_report(report, place, fmt)
        lines = spark.read.text(place).select(F.lit(fmt).alias("format"), F.col("value").alias("line"))
        lines = lines.where("line not like 'account%'")
        rows = lines if rows is None else rows.unionByName(lines)
    return rows


@named
def preview(spark, path):
    """The whole report, from where its preview says it is stored."""
    report = reports.balance(books(spark, path), q()).select(
        "account", "commodity", F.col("amount").cast("decimal(28,2)").alias("amount")
    )
    shown = sink.preview(report.orderBy("account", "commodity"), inline_chars=0)
    return spark.read.parquet(shown.path).select("line")
