"""The transaction register: leg split, filters, facets, orders.

The register stays in long form.  A condition on legs becomes a semi join on the
transaction key, a count per transaction a combining aggregate; legs are never
gathered into an array, so a transaction may have any number of them.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.accounts import is_balance_sheet
from tallyframe.functions.dates import in_range
from tallyframe.functions.text import name_key, search_text, tag_text, tags_text
from tallyframe.model import STATUSES, Ledger, keys_of
from tallyframe.operators.totals import spread
from tallyframe.scratch import materialize


@dataclass(frozen=True)
class Filters:
    """Register filters; an empty or absent one is off.  Dates are inclusive."""

    search: str = ""
    first: dt.date | None = None
    last: dt.date | None = None
    payees: tuple[str, ...] = ()
    accounts: tuple[str, ...] = ()
    least: Decimal | None = None
    most: Decimal | None = None
    commodities: tuple[str, ...] = ()
    statuses: tuple[str, ...] = ()
    tags: tuple[str, ...] = ()


# Facets, and the filter each one leaves out of its own counts.
FACETS = {
    "payee": "payees",
    "account": "accounts",
    "commodity": "commodities",
    "status": "statuses",
    "tag": "tags",
}


def split_legs(postings: DataFrame) -> DataFrame:
    """Add ``shown``: whether the collapsed row leads with this leg.

    Balance-sheet legs lead; of several, only those money left from, if any.  A
    transaction without any shows all its legs.  A missing ``pos`` is that of a first amount."""
    sheet = is_balance_sheet(F.col("account"))
    out = F.coalesce(F.col("quantity") < 0, F.lit(False))
    first = postings.where("coalesce(pos, 0) = 0").withColumn("_out", out)
    # Further amounts of a leg follow its first one; of several rows under one number, any that money left by.
    marks = first.groupBy("tindex", "leg", "account").agg(F.bool_or("_out").alias("_out"))
    further = postings.where("pos > 0").join(marks, ["tindex", "leg", "account"])
    legs = first.unionByName(further)
    state = first.groupBy("tindex").agg(
        F.count(F.when(sheet, 1)).alias("_sheet"), F.count(F.when(sheet & F.col("_out"), 1)).alias("_sources")
    )
    shown = F.when(F.col("_sheet") == 0, F.lit(True)).otherwise(
        sheet & ((F.col("_sheet") == 1) | (F.col("_sources") == 0) | F.col("_out"))
    )
    return legs.join(state, "tindex").withColumn("shown", shown).drop("_out", "_sheet", "_sources")


def hide_assertions(ledger: Ledger) -> DataFrame:
    """Transactions without the entries that only assert a balance.

    An entry that asserts and moves money stays."""
    asserting = keys_of(ledger.assertions)
    moving = (
        spread(ledger.postings.where(F.col("quantity") != 0), "tindex")
        .join(asserting, "tindex", "left_semi")
    )
    only = asserting.join(keys_of(moving), "tindex", "left_anti")
    return spread(ledger.transactions, "tindex").join(only, "tindex", "left_anti")


def _any(condition) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def _amount_hits(legs: DataFrame, f: Filters, keep: dict) -> DataFrame:
    """Per transaction: ``amount``, whether a leg that ``split_legs`` shows has an amount within
    bounds, and ``keep`` (conditions on legs by name), from one aggregation by leg and one by transaction."""
    fits = F.lit(True)
    if f.least is not None:
        fits = fits & (F.abs("quantity") >= F.lit(f.least))
    if f.most is not None:
        fits = fits & (F.abs("quantity") <= F.lit(f.most))
    begins = F.coalesce("pos", F.lit(0)) == 0
    out = begins & (F.col("quantity") < 0)
    further = _any(~begins & fits)
    by_leg = legs.groupBy("tindex", "leg", "account").agg(
        F.count(F.when(begins, 1)).alias("_first"),
        F.count(F.when(out, 1)).alias("_outs"),
        _any(begins & fits).alias("_fits"),
        _any(out & fits).alias("_fits_out"),
        further.alias("_further"),
        *[_any(c).alias(name) for name, c in keep.items()],
    )
    sheet = is_balance_sheet(F.col("account"))
    hit = F.col("_fits") | (F.col("_further") & (F.col("_first") > 0))
    hit_out = F.col("_fits_out") | (F.col("_further") & (F.col("_outs") > 0))
    by_txn = by_leg.groupBy("tindex").agg(
        F.sum(F.when(sheet, F.col("_first")).otherwise(0)).alias("_sheet"),
        F.sum(F.when(sheet, F.col("_outs")).otherwise(0)).alias("_sources"),
        _any(hit).alias("_all"),
        _any(sheet & hit).alias("_of_sheet"),
        _any(sheet & hit_out).alias("_of_sources"),
        *[_any(F.col(name)).alias(name) for name in keep],
    )
    amount = (
        F.when(F.col("_sheet") == 0, F.col("_all"))
        .when((F.col("_sheet") == 1) | (F.col("_sources") == 0), F.col("_of_sheet"))
        .otherwise(F.col("_of_sources"))
    )
    return by_txn.select("tindex", amount.alias("amount"), *keep)


def leg_hits(ledger: Ledger, f: Filters) -> DataFrame | None:
    """Per transaction a flag for each filter on legs that is on (``account``, ``commodity``,
    ``amount``, ``search``), from one pass over the postings; None where all are off.

    A transaction without a row has no hit.  Unless amounts are bounded, which takes all legs
    of a transaction, only legs that meet some filter are read into the aggregation."""
    # Legs share their transaction's date, so the leg side prunes as well.
    legs = ledger.postings.where(in_range(F.col("date"), f.first, f.last))
    hits = {}
    if f.accounts:
        hits["account"] = F.col("account").isin(*f.accounts)
    if f.commodities:
        hits["commodity"] = F.col("commodity").isin(*f.commodities)
    if f.search:
        hits["search"] = F.lower("account").contains(f.search.lower())
    if f.least is not None or f.most is not None:
        # a name of its own for flags that meet a column of the legs
        inner = {f"_{name}_hit": c for name, c in hits.items()}
        found = _amount_hits(legs, f, inner)
        return found.select("tindex", "amount", *[F.col(f"_{name}_hit").alias(name) for name in hits])
    if not hits:
        return None
    some = F.lit(False)
    for c in hits.values():
        some = some | F.coalesce(c, F.lit(False))
    return legs.where(some).groupBy("tindex").agg(*[_any(c).alias(name) for name, c in hits.items()])


def _passes(f: Filters, flags: list[str]) -> dict[str, Column]:
    """Conditions by filter, on transactions joined to their flags, which are named ``_hit_*``."""
    hit = lambda name: F.coalesce(F.col(f"_hit_{name}"), F.lit(False))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = {}
    if f.payees:
        out["payees"] = yes(F.col("payee").isin(*f.payees))
    if f.statuses:
        out["statuses"] = yes(F.col("status").isin(*f.statuses))
    if f.tags:
        out["tags"] = yes(F.exists("tags", lambda t: t["name"].isin(*f.tags)))
    if f.accounts:
        out["accounts"] = hit("account")
    if f.commodities:
        out["commodities"] = hit("commodity")
    if f.search:
        own = search_text(F.col("payee"), F.col("note"), tags_text(F.col("tags"), "\n")).contains(f.search.lower())
        out["search"] = yes(own) | hit("search")
    if "amount" in flags:
        out["amount"] = hit("amount")
    return out


def _with_hits(ledger: Ledger, f: Filters, heads: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """Transactions within the dates next to their flags, and the conditions of all other filters."""
    heads = heads.where(in_range(F.col("date"), f.first, f.last))
    flags = leg_hits(ledger, f)
    names = [] if flags is None else flags.columns[1:]
    if flags is not None:
        heads = heads.join(flags.withColumnsRenamed({n: f"_hit_{n}" for n in names}), "tindex", "left")
    return heads, _passes(f, names)


def apply_filters(ledger: Ledger, f: Filters, heads: DataFrame | None = None) -> DataFrame:
    """Transactions that pass every filter."""
    heads = ledger.transactions if heads is None else heads
    out, passes = _with_hits(ledger, f, heads)
    for condition in passes.values():
        out = out.where(condition)
    return out.select(*heads.columns)


def register_count(ledger: Ledger, f: Filters) -> DataFrame:
    """``X of Y``: transactions that pass, and all of them."""
    passed = apply_filters(ledger, f).agg(F.count("*").alias("n")).withColumn("side", F.lit("shown"))
    every = ledger.transactions.agg(F.count("*").alias("n")).withColumn("side", F.lit("total"))
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("n")))
    return passed.unionByName(every).agg(pick("shown").alias("shown"), pick("total").alias("total"))


def _facet(ledger: Ledger, heads: DataFrame, facet: str) -> DataFrame:
    """One row per counted occurrence of a facet value."""
    if facet in ("payee", "status"):
        return heads.select(F.col(facet).alias("value"))
    if facet == "tag":
        names = F.array_distinct(F.transform("tags", lambda t: t["name"]))
        return heads.select(F.explode(names).alias("value"))
    legs = ledger.postings.join(heads.select("tindex"), "tindex", "left_semi")
    if facet == "account":
        # Every leg counts: two legs on one account count the transaction twice.
        return legs.where("coalesce(pos, 0) = 0").select(F.col("account").alias("value"))
    return legs.select("tindex", F.col("commodity").alias("value")).distinct().select("value")


def facet_counts(ledger: Ledger, f: Filters = Filters()) -> DataFrame:
    """Occurrences per facet value; a facet ignores its own filter and keeps the rest.

    A transaction carries one bit per filter that it fails.  It counts for a facet when no
    other bit is set, so one pass settles all facets: postings are read once for the flags and
    once, against transactions that count for some leg facet, for the values."""
    rows, passes = _with_hits(ledger, f, ledger.transactions)
    names = list(passes)
    bit = lambda field: 1 << names.index(field) if field in names else 0
    failed = F.lit(0)
    for name, condition in passes.items():
        failed = failed.bitwiseOR(F.when(condition, 0).otherwise(bit(name)))
    # at most one failed filter, and one that a facet leaves out
    own = {0, *[bit(field) for field in FACETS.values()]}
    heads = rows.withColumn("_failed", failed).where(F.col("_failed").isin(*own))
    heads = materialize(heads.select("tindex", "payee", "status", "tags", "_failed"), "facets")
    counts = lambda facet: F.col("_failed").isin(0, bit(FACETS[facet]))
    entry = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    one = lambda facet, value: F.when(counts(facet), F.array(entry(facet, value))).otherwise(F.array())

    tags = F.array_distinct(F.transform("tags", lambda t: t["name"]))
    of_tags = F.when(counts("tag") & tags.isNotNull(), F.transform(tags, lambda t: entry("tag", t))).otherwise(F.array())
    of_heads = heads.select(
        F.inline(F.concat(one("payee", F.col("payee")), one("status", F.col("status")), of_tags))
    ).groupBy("facet", "value").agg(F.count("*").alias("n"))

    wanted = heads.where(counts("account") | counts("commodity")).select("tindex", "_failed")
    # Every leg counts for its account, a commodity once in a transaction: occurrences are
    # added up within it first.
    begins = F.coalesce("pos", F.lit(0)) == 0
    of_legs = (
        ledger.postings.select("tindex", "account", "commodity", begins.alias("_begins"))
        .join(wanted, "tindex")
        .select(
            "tindex",
            F.inline(
                F.concat(
                    F.when(F.col("_begins") & counts("account"), F.array(entry("account", F.col("account")))).otherwise(F.array()),
                    one("commodity", F.col("commodity")),
                )
            ),
        )
        .groupBy("tindex", "facet", "value")
        .agg(F.count("*").alias("_n"))
        .groupBy("facet", "value")
        .agg(F.sum(F.when(F.col("facet") == "account", F.col("_n")).otherwise(1)).alias("n"))
    )
    return of_heads.unionByName(of_legs).where("value <> ''")


def facet_options(ledger: Ledger) -> DataFrame:
    """Distinct values per facet, ordered by name; states in their own order."""
    out = None
    for facet in FACETS:
        if facet in ("account", "commodity"):
            values = ledger.postings.select(F.col(facet).alias("value"))
        else:
            values = _facet(ledger, ledger.transactions, facet)
        values = values.where("value <> ''").distinct().select(F.lit(facet).alias("facet"), "value")
        out = values if out is None else out.unionByName(values)
    state = F.array_position(F.array(*[F.lit(s) for s in STATUSES]), F.col("value"))
    rank = F.when(F.col("facet") == "status", state).otherwise(0)
    return out.orderBy("facet", rank, name_key(F.col("value")), "value")


def register_rows(ledger: Ledger, heads: DataFrame | None = None) -> DataFrame:
    """Transactions with what the collapsed row needs to be sorted by."""
    heads = ledger.transactions if heads is None else heads
    lead = (
        split_legs(ledger.postings)
        .where("shown")
        .groupBy("tindex")
        .agg(
            F.min_by(
                F.struct("account", "quantity"), F.struct("leg", "pos", "account", "quantity")
            ).alias("lead")
        )
    )
    return heads.join(lead, "tindex", "left").select(
        heads["*"],
        F.coalesce("lead.account", F.lit("")).alias("lead_account"),
        F.coalesce("lead.quantity", F.lit(0)).cast("decimal(28,8)").alias("lead_quantity"),
        F.array_join(F.transform("tags", tag_text), " ").alias("tags_text"),
    )


# Sortable columns of the register and the field each sorts by.
SORT_FIELDS = {
    "date": "date",
    "payee": "payee",
    "account": "lead_account",
    "amount": "lead_quantity",
    "status": "status",
    "note": "note",
    "tags": "tags_text",
}


def register_order(heads: DataFrame, descending: bool = True) -> DataFrame:
    """By date; the tiebreak turns with the direction, so that a day read backwards
    lists payees A-Z."""
    date, payee = F.col("date"), F.lower("payee")
    if descending:
        return heads.orderBy(date.desc(), payee.asc(), "tindex")
    return heads.orderBy(date.asc(), payee.desc(), "tindex")


def register_sorted(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """By one column, text without case; journal order breaks ties."""
    if column not in SORT_FIELDS:
        raise ValueError(f"cannot sort by {column!r}")
    if column == "date":
        return register_order(rows, descending)
    field = F.col(SORT_FIELDS[column])
    key = field if column == "amount" else F.lower(field)
    return rows.orderBy(key.desc() if descending else key.asc(), "tindex")


def sheet_search(rows: DataFrame, needle: str) -> DataFrame:
    """Balance-sheet rows whose account path holds ``needle``; empty sections vanish
    with their rows."""
    return rows.where(F.lower("account").contains(needle.lower()))


# Net-worth columns that can be sorted by.
SHEET_FIELDS = {
    "account": "account",
    "holding": "holding",
    "asserted": "asserted_on",
    "asserted_amount": "asserted_quantity",
    "value": "value",
}


def sheet_order(rows: DataFrame, column: str = "account", descending: bool = False) -> DataFrame:
    """Rows of a sheet by one column; amounts that are missing count as zero and
    accounts never asserted sort as the smallest date."""
    if column not in SHEET_FIELDS:
        raise ValueError(f"cannot sort by {column!r}")
    field = F.col(SHEET_FIELDS[column])
    if column == "account":
        key = F.lower(field)
    elif column == "asserted":
        return rows.orderBy(field.desc_nulls_last() if descending else field.asc_nulls_first(), "account")
    else:
        key = F.coalesce(field, F.lit(0))
    return rows.orderBy(key.desc() if descending else key.asc(), "account")
