"""Questions people ask of their books, composed from the reports."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.accounts import is_type
from tallyframe.functions.dates import period_start
from tallyframe.model import TOTAL, Ledger
from tallyframe.operators.query import Query, matches, posting_lines, select_postings
from tallyframe.operators.reports import balance, fill_periods, periodic_balance
from tallyframe.operators.totals import spread


def _only(ledger: Ledger, *types: str) -> Ledger:
    return ledger.having(postings=ledger.postings.where(is_type(F.col("account"), *types)))


def top_payees(ledger: Ledger, q: Query, k: int = 10) -> DataFrame:
    """Payees with the most spending, per commodity rank over all commodities."""
    # Summed per transaction first: the payee join then sees one row per transaction.
    spent = (
        select_postings(_only(ledger, "Expenses"), q)
        .groupBy("tindex", "commodity")
        .agg(F.sum("quantity").cast(TOTAL).alias("amount"))
    )
    by_payee = (
        spent.join(ledger.transactions.select("tindex", "payee"), "tindex")
        .groupBy("payee", "commodity")
        .agg(F.sum("amount").cast(TOTAL).alias("amount"), F.count("*").alias("transactions"))
    )
    return by_payee.orderBy(F.desc("amount"), "payee", "commodity").limit(k)


def biggest_purchase(ledger: Ledger, year: int) -> DataFrame:
    """Per commodity, the transaction of the year with the largest expense sum."""
    q = Query(begin=dt.date(year, 1, 1), end=dt.date(year + 1, 1, 1))
    sums = (
        select_postings(_only(ledger, "Expenses"), q)
        .groupBy("tindex", "date", "commodity")
        .agg(F.sum("quantity").cast(TOTAL).alias("amount"))
    )
    top = sums.groupBy("commodity").agg(F.max("amount").alias("amount"))
    rows = (
        sums.join(top, ["commodity", "amount"])
        .groupBy("commodity", "amount")
        .agg(F.min_by("date", "tindex").alias("date"), F.min("tindex").alias("tindex"))
    )
    return rows.join(ledger.transactions.select("tindex", "payee"), "tindex")


def spending_by_month(ledger: Ledger, q: Query) -> DataFrame:
    """Expenses per month and commodity."""
    rows = select_postings(_only(ledger, "Expenses"), q)
    return rows.groupBy(period_start(F.col("date"), "monthly").alias("period"), "commodity").agg(
        F.sum("quantity").cast(TOTAL).alias("amount")
    )


def compare_months(ledger: Ledger, q: Query, first: dt.date, last: dt.date) -> DataFrame:
    """Expenses of each month next to the month before, quiet months included."""
    expenses = _only(ledger, "Expenses")
    by_category = periodic_balance(
        expenses, replace(q, period="monthly", depth=2)
    )
    dense = fill_periods(by_category, "monthly", first, last)
    # One row per month and category: the window is as long as the calendar.
    by = Window.partitionBy("account", "commodity").orderBy("period")
    before = F.coalesce(F.lag("amount").over(by), F.lit(0)).cast(TOTAL)
    return dense.select("account", "commodity", "period", "amount", before.alias("previous")).withColumn(
        "change", (F.col("amount") - F.col("previous")).cast(TOTAL)
    )


def savings(ledger: Ledger, q: Query) -> DataFrame:
    """Earned, spent and the difference per month and commodity."""
    rows = select_postings(_only(ledger, "Revenues", "Expenses"), q)
    income = is_type(F.col("account"), "Revenues")
    amount = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast(TOTAL)
    return (
        rows.groupBy(period_start(F.col("date"), "monthly").alias("period"), "commodity")
        .agg(
            amount(F.when(income, -F.col("quantity"))).alias("earned"),
            amount(F.when(~income, F.col("quantity"))).alias("spent"),
        )
        .withColumn("saved", (F.col("earned") - F.col("spent")).cast(TOTAL))
    )


def by_currency(ledger: Ledger, q: Query = Query()) -> DataFrame:
    """Asset balances per commodity."""
    rows = select_postings(_only(ledger, "Assets"), q)
    return rows.groupBy("commodity").agg(F.sum("quantity").cast(TOTAL).alias("amount")).where("amount <> 0")


def tag_cost(ledger: Ledger, tag: str, q: Query = Query()) -> DataFrame:
    """What a tag cost, by expense account."""
    return balance(_only(ledger, "Expenses"), replace(q, tag=tag))


def duplicates(ledger: Ledger) -> DataFrame:
    """Postings that look alike (date, payee, account, amount) in several transactions.

    One posting per transaction is kept before the groups are counted, which spreads a
    group over its transactions and leaves the final count to map-side partials."""
    alike = ["date", "payee", "account", "commodity", "quantity"]
    once = posting_lines(ledger, spread(ledger.postings, "tindex")).select("tindex", *alike).distinct()
    return (
        once.groupBy(*alike)
        .agg(
            F.count("*").alias("transactions"),
            F.min("tindex").alias("first_tindex"),
            F.max("tindex").alias("last_tindex"),
        )
        .where("transactions > 1")
    )


def recurring(ledger: Ledger, q: Query, least: int = 3) -> DataFrame:
    """Payee and account pairs paid at least ``least`` times: typical gap in days, last
    and previous amount.

    Days are summed first, so windows and medians run over a calendar, not over
    postings."""
    paid = select_postings(_only(ledger, "Expenses"), q)
    daily = (
        posting_lines(ledger, paid)
        .groupBy("payee", "account", "commodity", "date")
        .agg(F.sum("quantity").cast(TOTAL).alias("amount"))
    )
    by = Window.partitionBy("payee", "account", "commodity").orderBy("date")
    steps = daily.withColumns(
        {"gap": F.datediff("date", F.lag("date").over(by)), "previous": F.lag("amount").over(by)}
    )
    out = steps.groupBy("payee", "account", "commodity").agg(
        F.count("*").alias("payments"),
        F.expr("percentile(gap, 0.5)").alias("median_gap"),
        F.max_by("amount", "date").alias("last_amount"),
        F.max_by("previous", "date").alias("previous"),
    )
    return out.where(F.col("payments") >= least).select(
        "payee",
        "account",
        "commodity",
        "payments",
        "median_gap",
        "last_amount",
        (F.col("last_amount") - F.col("previous")).cast(TOTAL).alias("change"),
    )


def budget_status(ledger: Ledger, budget: DataFrame, q: Query) -> DataFrame:
    """``budget(account, commodity, monthly)`` against each month's spending.

    Every month from the first with spending to the last has a row per budget, quiet ones too;
    without any spending there is one row without a month.

    A budgeted account takes in its subaccounts: every posting is counted once for each
    of its own path prefixes, at most as many as the path is deep."""
    rows = select_postings(_only(ledger, "Expenses"), q)
    spent = rows.groupBy("account", "commodity", period_start(F.col("date"), "monthly").alias("period")).agg(
        F.sum("quantity").cast(TOTAL).alias("amount")
    )
    parts = F.split("account", ":")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), ":"))
    rolled = (
        spent.withColumn("account", F.explode(paths))
        .groupBy("account", "commodity", "period")
        .agg(F.sum("amount").cast(TOTAL).alias("spent"))
    )
    first, last = spent.agg(F.min("period"), F.max("period")).first()
    month = F.lit(None).cast("date") if first is None else F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 month")))
    joined = budget.select("*", month.alias("period")).join(rolled, ["account", "commodity", "period"], "left")
    return joined.select(
        "account",
        "commodity",
        "period",
        F.col("monthly").cast(TOTAL).alias("budget"),
        F.coalesce("spent", F.lit(0)).cast(TOTAL).alias("spent"),
    ).withColumn("left", (F.col("budget") - F.col("spent")).cast(TOTAL))


def uncategorized(ledger: Ledger, q: Query, pattern: str = "uncategori[sz]ed") -> DataFrame:
    """Spending still to be put into a category."""
    chosen = ledger.having(postings=ledger.postings.where(matches(F.col("account"), pattern)))
    return balance(chosen, q)
