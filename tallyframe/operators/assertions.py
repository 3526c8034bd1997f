"""Balance assertions: the latest per account, and whether each one holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.model import TOTAL, Ledger
from tallyframe.operators.totals import running_totals


def last_asserted(assertions: DataFrame) -> DataFrame:
    """Each account's most recent assertion; the first in journal order wins a tie.

    Date and amount come from one winning row, so an amount that did not parse stays
    NULL next to its date."""
    win = F.struct("date", (-F.col("tindex")).alias("t"), (-F.col("leg")).alias("l"))
    row = F.struct("date", "quantity", "commodity", "precision")
    best = assertions.groupBy("account").agg(F.max_by(row, win).alias("a"))
    return best.select(
        "account",
        F.col("a.date").alias("asserted_on"),
        F.col("a.quantity").alias("asserted_quantity"),
        F.col("a.commodity").alias("asserted_commodity"),
        F.col("a.precision").alias("asserted_precision"),
    )


def assertion_check(ledger: Ledger) -> DataFrame:
    """The balance of the asserted account and commodity, subaccounts excluded, up to
    and including the asserting posting, next to what was asserted."""
    keys = ["account", "commodity"]
    asserted = ledger.assertions.select(
        F.col("date"),
        "tindex",
        "leg",
        F.lit(1).alias("_after"),
        *keys,
        F.lit(0).cast(TOTAL).alias("quantity"),
        F.col("quantity").cast(TOTAL).alias("asserted"),
    )
    # Only accounts somebody asserted take part.
    moves = ledger.postings.join(asserted.select(*keys).distinct(), keys, "left_semi").select(
        F.coalesce("pdate", "date").alias("date"),
        "tindex",
        "leg",
        F.lit(0).alias("_after"),
        *keys,
        F.col("quantity").cast(TOTAL).alias("quantity"),
        F.lit(None).cast(TOTAL).alias("asserted"),
    )
    rows = running_totals(
        moves.unionByName(asserted),
        keys,
        ["date", "tindex", "leg", "_after", "quantity"],
        {"balance": F.col("quantity")},
    )
    return rows.where("_after = 1 and asserted is not null").select(
        "tindex",
        "date",
        *keys,
        F.col("balance").cast(TOTAL).alias("balance"),
        "asserted",
        (F.col("balance") == F.col("asserted")).alias("holds"),
    )


def failed_assertions(ledger: Ledger) -> DataFrame:
    return assertion_check(ledger).where(~F.col("holds")).drop("holds")
