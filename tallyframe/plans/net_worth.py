"""The net-worth sheet: holdings, market value and last reconciliation in one plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.amounts import fmt_amounts, fmt_value
from tallyframe.model import AMOUNT, Ledger
from tallyframe.operators.assertions import last_asserted
from tallyframe.operators.pricing import latest_prices, price_paths, valued
from tallyframe.operators.query import Query
from tallyframe.operators.reports import sheet_rows


def net_worth_sheet(
    ledger: Ledger, base: str, q: Query = Query(), as_of: dt.date | None = None
) -> DataFrame:
    """One row per account: amounts and value as text and as sort figures, and the latest
    assertion.

    An account's amounts are gathered after they were summed per commodity, so a row
    holds as many as there are commodities."""
    rows = sheet_rows(ledger, q)
    worth = valued(rows, price_paths(latest_prices(ledger.prices, as_of), base), base)

    def amount(quantity, commodity):
        return F.struct(
            quantity.cast("decimal(28,8)").alias("quantity"), commodity.alias("commodity"), F.lit(2).alias("precision")
        ).cast(AMOUNT)

    by_symbol = lambda a: F.transform(F.array_sort(a), lambda s: s["a"])
    native = worth.groupBy("section", "account").agg(
        by_symbol(
            F.collect_list(F.struct("commodity", amount(F.col("amount"), F.col("commodity")).alias("a")))
        ).alias("amounts")
    )
    priced = (
        worth.groupBy("section", "account", "value_commodity")
        .agg(F.sum("value").cast("decimal(28,2)").alias("v"))
        .groupBy("section", "account")
        .agg(
            by_symbol(
                F.collect_list(
                    F.struct("value_commodity", amount(F.col("v"), F.col("value_commodity")).alias("a"))
                )
            ).alias("figure")
        )
    )
    sheet = native.join(priced, ["section", "account"])
    if ledger.assertions is not None:
        sheet = sheet.join(last_asserted(ledger.assertions), "account", "left")
    else:
        sheet = sheet.withColumns(
            {"asserted_on": F.lit(None).cast("date"), "asserted_quantity": F.lit(None).cast("decimal(28,8)"),
             "asserted_commodity": F.lit(None).cast("string")}
        )
    first = lambda a: F.try_element_at(a, F.lit(1))["quantity"].cast("decimal(28,2)")
    return sheet.select(
        "section",
        "account",
        fmt_amounts(F.col("amounts")).alias("holding_text"),
        fmt_value(F.col("amounts"), F.col("figure")).alias("value_text"),
        first(F.col("amounts")).alias("holding"),
        first(F.col("figure")).alias("value"),
        "asserted_on",
        F.col("asserted_quantity").cast("decimal(28,2)").alias("asserted_quantity"),
        "asserted_commodity",
    )
