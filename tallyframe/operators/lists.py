"""Lists of names in use."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.text import name_key
from tallyframe.model import Ledger


def _names(column: DataFrame) -> DataFrame:
    names = column.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return names.orderBy(name_key(F.col("name")), "name")


def list_accounts(ledger: Ledger) -> DataFrame:
    return _names(ledger.postings.select(F.col("account").alias("name")))


def list_payees(ledger: Ledger) -> DataFrame:
    return _names(ledger.transactions.select(F.col("payee").alias("name")))


def list_tags(ledger: Ledger) -> DataFrame:
    return _names(ledger.transactions.select(F.explode(F.transform("tags", lambda t: t["name"])).alias("name")))
