"""Canonical tables.

Everything in the library reads or writes these shapes.  A posting row is one
(transaction, leg, commodity) amount; ``leg`` is the stored position of the leg in
its transaction and ``pos`` the position of the amount in its leg.  Neither has to
be unique: rows that tie on every ordering column are interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyframe.scratch import materialize

# Quantities are exact decimals.  Spark trades scale for range once a result would need
# more than 38 digits, so each type leaves room for the operation that follows it: a sum
# of QUANTITY is cast to TOTAL, two TOTALs add without losing a place, and a cost product
# is taken between COSTED and PRICE.
QUANTITY = "decimal(28,8)"
TOTAL = "decimal(34,8)"
COSTED = "decimal(24,8)"
PRICE = "decimal(18,8)"
# A market price keeps what its line says, tiny ones too: it is compared, shown and turned
# into a rate, but never summed.
RATE = "decimal(38,18)"

TAGS = "array<struct<name:string,value:string>>"
AMOUNT = f"struct<quantity:{QUANTITY},commodity:string,precision:int>"

TRANSACTIONS = {
    "tindex": "bigint",
    "date": "date",
    "payee": "string",
    "note": "string",
    "status": "string",
    "tags": TAGS,
    "source_file": "string",
    "source_line": "bigint",
}
POSTINGS = {
    "tindex": "bigint",
    "leg": "int",
    "pos": "int",
    "date": "date",
    "pdate": "date",
    "account": "string",
    "commodity": "string",
    "quantity": QUANTITY,
    "precision": "int",
    "status": "string",
    "cost_quantity": QUANTITY,
    "cost_commodity": "string",
    "is_assertion": "boolean",
    "kind": "string",
}
PRICES = {
    "date": "date",
    "commodity": "string",
    "price": RATE,
    "target": "string",
    "source": "string",
    "seq": "bigint",
}
ASSERTIONS = {
    "tindex": "bigint",
    "leg": "int",
    "date": "date",
    "account": "string",
    "quantity": QUANTITY,
    "commodity": "string",
    "precision": "int",
}

# Transaction states, in display order.
STATUSES = ("Cleared", "Pending", "Unmarked")

# Kinds of postings besides real ones, and the brackets their accounts are written in.
# A virtual posting balances nothing, balanced virtual ones balance among themselves; NULL is real.
KINDS = {"virtual": "()", "balanced": "[]"}

# Leg number of a balancing leg whose siblings carry their own line numbers.
LAST_LEG = 1_000_000


def conform(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Select and cast the columns of ``schema``; absent columns become NULL."""
    have = set(df.columns)
    return df.selectExpr(
        *[f"cast({name if name in have else 'null'} as {kind}) as {name}" for name, kind in schema.items()]
    )


def keys_of(df: DataFrame) -> DataFrame:
    """Transactions that occur in ``df``, each once.

    For the right side of a semi or anti join: duplicates of a crowded transaction are
    dropped where they are read, before the shuffle, and the join reuses its partitioning."""
    return df.select("tindex").distinct()


class Ledger:
    """A set of books.

    Transactions, postings, assertions and prices grow with the data, the declared
    accounts and commodities are dimensions.  Each frame may be given as a function; it
    is then built when a report first asks for it."""

    FRAMES = ("transactions", "postings", "prices", "assertions", "accounts", "commodities")

    def __init__(self, transactions=None, postings=None, prices=None, assertions=None, accounts=None, commodities=None):
        self._frames: dict[str, DataFrame | Callable[[], DataFrame] | None] = dict(
            zip(self.FRAMES, (transactions, postings, prices, assertions, accounts, commodities))
        )

    def __getattr__(self, name: str) -> DataFrame | None:
        if name not in Ledger.FRAMES:
            raise AttributeError(name)
        frame = self._frames[name]
        if callable(frame):
            frame = self._frames[name] = frame()
        return frame

    def stored(self, *names: str) -> "Ledger":
        """The same books with the named frames written once and read back.

        For work that reads a derived frame many times: its joins then run once, and every
        reader prunes columns and row groups of its own."""
        return self.having(**{name: materialize(getattr(self, name), name) for name in names})

    def having(self, **frames) -> "Ledger":
        """The same books with some frames replaced."""
        return Ledger(**{**self._frames, **frames})
