"""Checks of submitted entries and of a whole ledger.

A check returns its violations as rows; no rows means valid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.dates import is_iso_date
from tallyframe.model import COSTED, PRICE, TOTAL, Ledger
from tallyframe.operators.assertions import failed_assertions

_DATE_SHAPE = r"^\d{4}-\d{2}-\d{2}$"


def _violations(items: DataFrame, noun: str, rules: dict[str, tuple[Column, Column]], single: bool) -> DataFrame:
    """One row per broken rule; the item number is named unless the batch has one item."""
    found = F.filter(
        F.array(
            *[
                F.when(broken, F.struct(F.lit(rule).alias("rule"), text.alias("text")))
                for rule, (broken, text) in rules.items()
            ]
        ),
        lambda v: v.isNotNull(),
    )
    rows = items.select("item", F.inline(found))
    prefix = F.lit("") if single else F.concat(F.lit(f"{noun} "), F.col("item").cast("string"), F.lit(": "))
    return rows.select("item", "rule", F.concat(prefix, "text").alias("message"))


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def _bad_date() -> tuple[Column, Column]:
    return (
        ~F.coalesce(F.col("date").rlike(_DATE_SHAPE), F.lit(False)),
        F.concat(F.lit("date "), F.coalesce("date", F.lit("(none)")), F.lit(" is not YYYY-MM-DD")),
    )


def check_inputs(entries: DataFrame, legs: DataFrame, single: bool = False) -> DataFrame:
    """``entries(item, date)`` and ``legs(item, account, amount, currency)``."""
    counted = legs.groupBy("item").agg(F.count("*").alias("n"))
    heads = entries.join(counted, "item", "left")
    of_entries = _violations(
        heads,
        "Transaction",
        {
            "date": _bad_date(),
            "postings": (F.coalesce("n", F.lit(0)) < 2, F.lit("fewer than 2 postings")),
        },
        single,
    )
    of_legs = _violations(
        legs,
        "Transaction",
        {
            "amount": (F.col("amount").isNull(), F.concat(F.lit("no amount for "), F.col("account"))),
            "currency": (_blank("currency"), F.concat(F.lit("no currency for "), F.col("account"))),
        },
        single,
    )
    return of_entries.unionByName(of_legs)


def check_assertion_inputs(items: DataFrame, single: bool = False) -> DataFrame:
    """``items(item, date, account, amount, currency)``."""
    name = F.coalesce("account", F.lit(""))
    return _violations(
        items,
        "Assertion",
        {
            "date": _bad_date(),
            "account": (_blank("account"), F.lit("no account")),
            "amount": (F.col("amount").isNull(), F.concat(F.lit("no balance amount for "), name)),
            "currency": (_blank("currency"), F.concat(F.lit("no balance currency for "), name)),
        },
        single,
    )


def check_price_inputs(items: DataFrame, single: bool = False) -> DataFrame:
    """``items(item, date, commodity, amount, target)``."""
    name = F.coalesce("commodity", F.lit(""))
    return _violations(
        items,
        "Price",
        {
            "date": _bad_date(),
            "commodity": (_blank("commodity"), F.lit("no commodity")),
            "amount": (F.col("amount").isNull(), F.concat(F.lit("no price for "), name)),
            "positive": (F.col("amount") <= 0, F.concat(F.lit("price not positive for "), name)),
            "target": (_blank("target"), F.concat(F.lit("no target for "), name)),
        },
        single,
    )


def check_dates(texts: DataFrame, column: str) -> DataFrame:
    """Rows with ``is_iso_date``: right shape and a day that exists."""
    return texts.withColumn("is_iso_date", is_iso_date(F.col(column)))


def unbalanced(ledger: Ledger) -> DataFrame:
    """(transaction, commodity) sums that are not zero.

    Virtual postings balance nothing; balanced virtual ones do so among themselves, real ones
    likewise.  A costed amount counts in the commodity it cost.  Two uncosted commodities of
    opposite sign are an implied conversion and balance each other."""
    costed = F.col("cost_quantity").isNotNull()
    group = ["tindex", "side"]
    sums = (
        ledger.postings.where("coalesce(kind, 'real') <> 'virtual'")
        .select(
            "tindex",
            (F.coalesce("kind", F.lit("real")) == "balanced").alias("side"),
            F.when(costed, F.col("cost_commodity")).otherwise(F.col("commodity")).alias("commodity"),
            F.when(costed, (F.col("quantity").cast(COSTED) * F.col("cost_quantity").cast(PRICE)).cast(TOTAL))
            .otherwise(F.col("quantity").cast(TOTAL))
            .alias("amount"),
            costed.alias("costed"),
        )
        .groupBy(*group, "commodity")
        .agg(F.sum("amount").cast(TOTAL).alias("amount"), F.max("costed").alias("costed"))
    )
    left = sums.where("amount <> 0")
    costs = sums.groupBy(*group).agg(F.max("costed").alias("any_cost"))
    shape = left.groupBy(*group).agg(
        F.count("*").alias("n"), F.min("amount").alias("low"), F.max("amount").alias("high")
    )
    implied = (
        shape.where("n = 2 and low < 0 and high > 0")
        .join(costs.where(~F.col("any_cost")), group, "left_semi")
        .select(*group)
    )
    return left.join(implied, group, "left_anti").select("tindex", "commodity", "amount")


def batch_errors(ledger: Ledger) -> DataFrame:
    """What keeps a batch of entries from being appended: (rule, tindex, detail).

    Every entry needs a date and two legs, every leg an account, an amount and a
    commodity, every posting its entry, and the sums of an entry must be zero."""
    heads, legs = ledger.transactions, ledger.postings
    found = [
        heads.where("date is null").select(F.lit("date").alias("rule"), "tindex", F.lit("").alias("detail")),
        legs.where("coalesce(account, '') = ''").select(F.lit("account"), "tindex", F.lit("")),
        legs.where("quantity is null").select(F.lit("amount"), "tindex", "account"),
        legs.where("coalesce(commodity, '') = ''").select(F.lit("commodity"), "tindex", "account"),
        legs.join(heads.select("tindex"), "tindex", "left_anti").select(F.lit("entry"), "tindex", "account"),
        heads.join(legs.groupBy("tindex").agg(F.count("*").alias("n")), "tindex", "left")
        .where("coalesce(n, 0) < 2").select(F.lit("postings"), "tindex", F.coalesce("n", F.lit(0)).cast("string")),
        unbalanced(ledger).select(F.lit("unbalanced"), "tindex", F.concat_ws(" ", F.col("amount").cast("string"), "commodity")),
    ]
    out = found[0]
    for rows in found[1:]:
        out = out.union(rows)
    return out


def undeclared(ledger: Ledger) -> DataFrame:
    """Account and commodity names in use without a declaration, with their use count."""
    accounts = ledger.postings.groupBy("account").agg(F.count("*").alias("uses"))
    accounts = accounts.join(ledger.accounts, "account", "left_anti").select(
        F.lit("account").alias("kind"), F.col("account").alias("name"), "uses"
    )
    commodities = ledger.postings.groupBy("commodity").agg(F.count("*").alias("uses"))
    commodities = commodities.join(ledger.commodities, "commodity", "left_anti").select(
        F.lit("commodity").alias("kind"), F.col("commodity").alias("name"), "uses"
    )
    return accounts.unionByName(commodities)


def validate(ledger: Ledger) -> DataFrame:
    """All violations of a ledger as (rule, tindex, detail); valid when empty."""
    broken = unbalanced(ledger).select(
        F.lit("unbalanced").alias("rule"),
        "tindex",
        F.concat_ws(" ", F.col("amount").cast("decimal(28,2)").cast("string"), "commodity").alias("detail"),
    )
    out = broken
    if ledger.accounts is not None and ledger.commodities is not None:
        names = undeclared(ledger).select(
            F.concat(F.lit("undeclared "), "kind").alias("rule"),
            F.lit(None).cast("bigint").alias("tindex"),
            F.col("name").alias("detail"),
        )
        out = out.unionByName(names)
    if ledger.assertions is not None:
        failed = failed_assertions(ledger).select(
            F.lit("assertion").alias("rule"),
            "tindex",
            F.concat_ws(" ", "account", F.col("balance").cast("decimal(28,2)").cast("string"), "commodity").alias(
                "detail"
            ),
        )
        out = out.unionByName(failed)
    return out
