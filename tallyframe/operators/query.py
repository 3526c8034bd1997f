"""Report queries: typed parameters in, a filtered frame out.

All conditions are ANDed.  Column predicates stay plain expressions, so Catalyst
pushes them below joins and into the scan; conditions on the transaction filter the
(smaller) transaction table first and meet the postings in one equi join.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.dates import in_window, prefix_range
from tallyframe.functions.text import join_description
from tallyframe.model import Ledger, keys_of

# States by the names queries use.
STATUS_NAMES = {"cleared": "Cleared", "pending": "Pending", "unmarked": "Unmarked"}

_AMOUNT = re.compile(r"^\s*(<=|>=|<|>|=)?\s*([+-]?)\s*([\d,]*\.?\d+)\s*$")


@dataclass(frozen=True)
class Query:
    """Parameters of a report.  ``end`` is exclusive; without it the report stops
    after ``today``, and without both it is open."""

    account: str | None = None
    description: str | None = None
    payee: str | None = None
    amount: str | None = None
    tag: str | None = None
    status: str | None = None
    begin: dt.date | None = None
    end: dt.date | None = None
    today: dt.date | None = None
    period: str | None = None
    depth: int | None = None
    invert: bool = False

    @property
    def stop(self) -> dt.date | None:
        if self.end is not None:
            return self.end
        return self.today + dt.timedelta(days=1) if self.today is not None else None


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive regular expression, anywhere in the text."""
    return text.rlike(f"(?iu){pattern}")


def amount_matches(quantity: Column, expression: str) -> Column:
    """``>100`` compares magnitudes; a signed number, or zero, compares values."""
    found = _AMOUNT.match(expression)
    if not found:
        raise ValueError(f"not an amount filter: {expression!r}")
    op, sign, digits = found.groups()
    number = Decimal(sign + digits.replace(",", ""))
    side = quantity if sign or number == 0 else F.abs(quantity)
    bound = F.lit(number)
    return {
        "<": side < bound,
        "<=": side <= bound,
        ">": side > bound,
        ">=": side >= bound,
        "=": side == bound,
        None: side == bound,
    }[op]


def tag_matches(tags: Column, expression: str) -> Column:
    """``name`` or ``name=value``, both patterns."""
    name, eq, value = expression.partition("=")

    def hit(tag):
        found = matches(tag["name"], name)
        return found & matches(tag["value"], value) if eq else found

    return F.exists(tags, hit)


def status_name(status: str) -> str:
    if status.lower() not in STATUS_NAMES:
        raise ValueError(f"status must be one of {', '.join(STATUS_NAMES)}")
    return STATUS_NAMES[status.lower()]


def transaction_predicate(q: Query) -> Column | None:
    """Conditions that only the transaction can answer (status is not one of them)."""
    terms = []
    if q.description is not None:
        terms.append(matches(join_description(F.col("payee"), F.col("note")), q.description))
    if q.payee is not None:
        terms.append(matches(F.col("payee"), q.payee))
    if q.tag is not None:
        terms.append(tag_matches(F.col("tags"), q.tag))
    out = None
    for term in terms:
        out = term if out is None else out & term
    return out


def select_postings(ledger: Ledger, q: Query) -> DataFrame:
    """Postings that satisfy every condition of ``q``."""
    postings = ledger.postings.where(in_window(F.col("date"), q.begin, q.stop))
    if q.account is not None:
        postings = postings.where(matches(F.col("account"), q.account))
    if q.amount is not None:
        postings = postings.where(amount_matches(F.col("quantity"), q.amount))
    wanted = transaction_predicate(q)
    if wanted is None and q.status is None:
        return postings
    # The date bound holds for both sides of the join, so both scans prune.
    heads = ledger.transactions.where(in_window(F.col("date"), q.begin, q.stop))
    if wanted is not None:
        heads = heads.where(wanted)
    if q.status is None:
        return postings.join(heads.select("tindex"), "tindex", "left_semi")
    marks = heads.select("tindex", F.col("status").alias("_head_status"))
    return (
        postings.join(marks, "tindex")
        .where(F.coalesce("status", "_head_status") == status_name(q.status))
        .drop("_head_status")
    )


def posting_lines(ledger: Ledger, postings: DataFrame | None = None) -> DataFrame:
    """Postings with the fields of their transaction."""
    heads = ledger.transactions.select("tindex", "payee", "note", F.col("status").alias("txn_status"), "tags")
    return (ledger.postings if postings is None else postings).join(heads, "tindex")


def check_terms(terms: list[str]) -> None:
    """Refuse a term list before any job starts."""
    if not terms:
        raise ValueError("query must hold at least one term")
    for term in terms:
        if not term or not term.strip():
            raise ValueError("query terms must not be empty")
        if term.startswith("-"):
            raise ValueError(f"query term {term!r} must not start with '-'")


# What the query language reserves before a colon.
PREFIXES = (
    "acct", "all", "amt", "any", "code", "cur", "date", "date2", "depth", "desc", "expr", "inacct", "not", "note",
    "payee", "real", "status", "tag", "type",
)


def _split_term(term: str) -> tuple[str, str]:
    """Field and value; what begins with no reserved prefix is an account pattern, colons and all."""
    field, colon, value = term.partition(":")
    return (field, value) if colon and field in PREFIXES else ("acct", term)


def date_bounds(terms: list[str]) -> tuple[dt.date | None, dt.date | None]:
    """The half-open window all ``date:`` terms agree on, open without any."""
    begin = end = None
    for field, value in map(_split_term, terms):
        if field == "date":
            first, stop = prefix_range(value)
            begin = first if begin is None else max(begin, first)
            end = stop if end is None else min(end, stop)
    return begin, end


def matching_transactions(ledger: Ledger, terms: list[str]) -> DataFrame:
    """Transactions for which every term holds; an account or amount term holds when
    any posting satisfies it.  Each such term is one semi join, so no transaction is
    ever gathered in one place.  Date terms bound both sides of every join."""
    check_terms(terms)
    dated = in_window(F.col("date"), *date_bounds(terms))
    heads, legs = ledger.transactions.where(dated), ledger.postings.where(dated)
    for field, value in map(_split_term, terms):
        if field == "acct":
            heads = heads.join(keys_of(legs.where(matches(F.col("account"), value))), "tindex", "left_semi")
        elif field == "amt":
            heads = heads.join(keys_of(legs.where(amount_matches(F.col("quantity"), value))), "tindex", "left_semi")
        elif field == "payee":
            heads = heads.where(matches(F.col("payee"), value))
        elif field == "desc":
            heads = heads.where(matches(join_description(F.col("payee"), F.col("note")), value))
        elif field == "tag":
            heads = heads.where(tag_matches(F.col("tags"), value))
        elif field == "status":
            names = {"*": "cleared", "!": "pending", "": "unmarked"}
            heads = heads.where(F.col("status") == status_name(names.get(value, value)))
        elif field != "date":
            raise ValueError(f"unknown query term {field}:{value}")
    return heads


def print_report(ledger: Ledger, terms: list[str]) -> DataFrame:
    """Every leg of every matching transaction, in date and journal order."""
    heads = matching_transactions(ledger, terms).select(
        "tindex", "payee", "note", F.col("status").alias("txn_status")
    )
    legs = ledger.postings.where(in_window(F.col("date"), *date_bounds(terms)))
    return legs.join(heads, "tindex").orderBy("date", "tindex", "leg", "pos")
