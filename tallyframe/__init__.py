"""Double-entry ledger analytics on Spark DataFrames."""

from tallyframe.model import Ledger
from tallyframe.operators.query import Query

__all__ = ["Ledger", "Query"]
