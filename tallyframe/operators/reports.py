"""Balance reports.

Every report first sums by (account, commodity), or adds the period, which combines on
the map side; totals, grouping sets and running balances work on that small result.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.accounts import account_type, depth_clip, depth_of, in_subtree, is_type
from tallyframe.functions.dates import PERIOD_STEPS, in_window, period_start
from tallyframe.model import TOTAL, Ledger, keys_of
from tallyframe.operators.query import Query, select_postings
from tallyframe.operators.totals import running_totals


def _signed(q: Query, column: str = "amount"):
    return -F.col(column) if q.invert else F.col(column)


def named(postings: DataFrame, q: Query) -> DataFrame:
    """Account names cut to the depth asked for."""
    if q.depth is None:
        return postings
    return postings.withColumn("account", depth_clip(F.col("account"), q.depth))


def balance(ledger: Ledger, q: Query = Query()) -> DataFrame:
    """Balance per account and commodity; zero balances are not listed."""
    rows = named(select_postings(ledger, q), q)
    sums = rows.groupBy("account", "commodity").agg(F.sum("quantity").cast(TOTAL).alias("amount"))
    return sums.where("amount <> 0").withColumn("amount", _signed(q))


def _per_period(ledger: Ledger, q: Query) -> DataFrame:
    rows = named(select_postings(ledger, q), q).withColumn("period", period_start(F.col("date"), q.period))
    return rows.groupBy("account", "commodity", "period").agg(F.sum("quantity").cast(TOTAL).alias("amount"))


def periodic_balance(ledger: Ledger, q: Query) -> DataFrame:
    """Change per account, commodity and period, in long form.

    Periods without postings of an account are absent; ``fill_periods`` adds them."""
    return _per_period(ledger, q).withColumn("amount", _signed(q))


def fill_periods(sums: DataFrame, period: str, first: dt.date, last: dt.date) -> DataFrame:
    """Add a zero row for every period from ``first`` to ``last`` an account lacks.

    The calendar is generated per (account, commodity) row and joined on equality."""
    keys = ["account", "commodity"]
    spine = sums.select(*keys).distinct().select(
        *keys,
        F.explode(
            F.expr(f"sequence(date'{first.isoformat()}', date'{last.isoformat()}', interval {PERIOD_STEPS[period]})")
        ).alias("period"),
    )
    return spine.join(sums, [*keys, "period"], "left").withColumn(
        "amount", F.coalesce("amount", F.lit(0)).cast(TOTAL)
    )


def pivot_periods(sums: DataFrame, periods: list[dt.date]) -> DataFrame:
    """One column per listed period; empty cells are zero."""
    wide = sums.groupBy("account", "commodity").pivot("period", periods).agg(F.sum("amount"))
    return wide.fillna(0)


def _with_totals(rows: DataFrame, total: str = "total") -> DataFrame:
    """Account rows plus one total per section and commodity.  ``rows`` is already
    aggregated, so the second pass costs little."""
    sums = rows.groupBy("section", "commodity").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    return rows.withColumn("kind", F.lit("account")).unionByName(
        sums.withColumns({"kind": F.lit(total), "account": F.lit("")})
    )


def _net(rows: DataFrame, minus: str) -> DataFrame:
    sign = F.when(F.col("section") == minus, -F.col("amount")).otherwise(F.col("amount"))
    net = rows.groupBy("commodity").agg(F.sum(sign).cast(TOTAL).alias("amount"))
    return net.withColumns({"section": F.lit("Net"), "account": F.lit(""), "kind": F.lit("net")})


def income_statement(ledger: Ledger, q: Query = Query()) -> DataFrame:
    """Revenues (shown positive), Expenses, section totals and Net = revenues - expenses."""
    chosen = ledger.having(
        postings=ledger.postings.where(is_type(F.col("account"), "Revenues", "Expenses"))
    )
    rows = balance(chosen, q).withColumn("section", account_type(F.col("account")))
    rows = rows.withColumn(
        "amount", F.when(F.col("section") == "Revenues", -F.col("amount")).otherwise(F.col("amount")).cast(TOTAL)
    )
    return _with_totals(rows).unionByName(_net(rows, "Expenses"))


def sheet_rows(ledger: Ledger, q: Query = Query()) -> DataFrame:
    """Asset and liability balances; liabilities are shown positive."""
    chosen = ledger.having(
        postings=ledger.postings.where(is_type(F.col("account"), "Assets", "Liabilities"))
    )
    rows = balance(chosen, q).withColumn("section", account_type(F.col("account")))
    return rows.withColumn(
        "amount",
        F.when(F.col("section") == "Liabilities", -F.col("amount")).otherwise(F.col("amount")).cast(TOTAL),
    )


def balance_sheet(ledger: Ledger, q: Query = Query()) -> DataFrame:
    rows = sheet_rows(ledger, q)
    return _with_totals(rows).unionByName(_net(rows, "Liabilities"))


def historical_balances(
    ledger: Ledger, q: Query, last: dt.date, since: dt.date | None = None, held: DataFrame | None = None
) -> DataFrame:
    """Balance at the end of every period up to the one holding ``last``.

    History before ``q.begin`` counts.  The window of an account spans its periods,
    never its postings, and quiet periods repeat the balance before them.  Where ``held``
    (account, commodity, period, amount) says what there was before ``since``, postings
    older than that are not read."""
    everything = Query(
        account=q.account, description=q.description, payee=q.payee, amount=q.amount, tag=q.tag,
        status=q.status, begin=since, end=q.end, today=q.today, period=q.period, depth=q.depth, invert=q.invert,
    )
    steps = _per_period(ledger, everything)
    if held is not None:
        steps = steps.unionByName(held.select(*steps.columns))
        steps = steps.groupBy("account", "commodity", "period").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    by = Window.partitionBy("account", "commodity").orderBy("period")
    step = F.expr(f"interval {PERIOD_STEPS[q.period]}")
    final = period_start(F.lit(last), q.period)
    held = steps.select(
        "account",
        "commodity",
        "period",
        F.sum("amount").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(TOTAL).alias("amount"),
        F.coalesce((F.lead("period").over(by) - step).cast("date"), final).alias("until"),
    ).where(F.col("period") <= F.col("until"))
    # A period never holds part of the next one, so each balance repeats over
    # [its own period, the period before the next change].
    filled = held.select(
        "account", "commodity", F.explode(F.sequence("period", "until", step)).alias("period"), "amount"
    )
    out = filled.where("amount <> 0").withColumn("amount", _signed(q))
    return out.where(F.col("period") >= period_start(F.lit(q.begin), q.period)) if q.begin else out


def posting_register(ledger: Ledger, q: Query = Query()) -> DataFrame:
    """Postings in journal order with a running total per commodity."""
    rows = named(select_postings(ledger, q), q).select(
        "date", "tindex", "leg", "pos", "account", "commodity", _signed(q, "quantity").cast(TOTAL).alias("amount")
    )
    return running_totals(
        rows,
        ["commodity"],
        ["date", "tindex", "leg", "pos", "account", "amount"],
        {"total": F.col("amount")},
    ).withColumn("total", F.col("total").cast(TOTAL))


def periodic_register(ledger: Ledger, q: Query) -> DataFrame:
    """Sums per period, account and commodity with a running total per commodity."""
    rows = _per_period(ledger, q).withColumn("amount", _signed(q).cast(TOTAL))
    return running_totals(
        rows, ["commodity"], ["period", "account"], {"total": F.col("amount")}
    ).withColumn("total", F.col("total").cast(TOTAL))


def account_register(
    ledger: Ledger, root: str, q: Query = Query(), since: dt.date | None = None, held: DataFrame | None = None
) -> DataFrame:
    """One row per transaction and commodity touching ``root`` or a subaccount.

    The running balance is historical: it starts before ``q.begin``, from ``held`` (account,
    commodity, amount) where that says what there was before ``since``."""
    inside = in_subtree(F.col("account"), root)
    upto = ledger.postings.where(in_window(F.col("date"), since, q.stop))
    changes = (
        upto.where(inside)
        .groupBy("tindex", "date", "commodity")
        .agg(F.sum("quantity").cast(TOTAL).alias("change"))
    )
    run = running_totals(changes, ["commodity"], ["date", "tindex"], {"balance": F.col("change")})
    run = run.where(in_window(F.col("date"), q.begin, None))
    if held is not None:
        carried = held.where(inside).groupBy(F.col("commodity").alias("_held")).agg(F.sum("amount").alias("_amount"))
        brought = F.coalesce("_amount", F.lit(0)).cast(TOTAL)
        run = run.join(carried, F.col("commodity").eqNullSafe(F.col("_held")), "left")
        run = run.withColumn("balance", F.col("balance").cast(TOTAL) + brought).drop("_held", "_amount")
    # Distinct names only: bounded by the chart of accounts, however many legs there are.
    others = (
        upto.where(~inside)
        .join(keys_of(changes), "tindex", "left_semi")
        .select("tindex", "account")
        .distinct()
        .groupBy("tindex")
        .agg(F.array_join(F.array_sort(F.collect_set("account")), ", ").alias("other_accounts"))
    )
    heads = ledger.transactions.select("tindex", "payee")
    return (
        run.join(heads, "tindex", "left")
        .join(others, "tindex", "left")
        .select(
            "tindex",
            "date",
            "payee",
            F.coalesce("other_accounts", F.lit("")).alias("other_accounts"),
            "commodity",
            "change",
            F.col("balance").cast(TOTAL).alias("balance"),
        )
    )


def statistics(ledger: Ledger, today: dt.date) -> DataFrame:
    """Journal statistics as (item, value) rows, all values as text.

    Names are made distinct before they are counted, so the counts need no row
    multiplied per distinct column."""
    last = F.max("date")
    span = F.datediff(last, F.min("date")) + 1
    per_day = F.format_string("%.1f", F.count("*") / span.cast("double"))

    def since(days):
        inside = (F.col("date") > F.lit(today - dt.timedelta(days=days))) & (F.col("date") <= F.lit(today))
        return F.count(F.when(inside, 1)).cast("string")

    heads = ledger.transactions.agg(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(k).alias("item"), v.alias("value"))
                    for k, v in {
                        "transactions": F.count("*").cast("string"),
                        "first_date": F.min("date").cast("string"),
                        "last_date": last.cast("string"),
                        "span_days": span.cast("string"),
                        "per_day": per_day,
                        "last_30_days": since(30),
                        "last_7_days": since(7),
                    }.items()
                ]
            )
        )
    )
    names = ledger.postings.select("account", "commodity").distinct()

    def one(frame, item, value):
        return frame.agg(F.lit(item).alias("item"), value.cast("string").alias("value"))

    parts = [
        heads,
        one(ledger.transactions.select("payee").distinct(), "payees", F.count("*")),
        one(names.select("account").distinct(), "accounts", F.count("*")),
        one(names, "account_depth", F.max(depth_of(F.col("account")))),
        one(names.select("commodity").distinct(), "commodities", F.count("*")),
    ]
    if ledger.prices is not None:
        parts.append(one(ledger.prices, "prices", F.count("*")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def transaction_count(ledger: Ledger) -> DataFrame:
    return ledger.transactions.agg(F.count("*").alias("transactions"))


def merge_amounts(amounts: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Merge cost lots: one amount per key and commodity, in first-seen order.

    Dust below 1e-9 reads as zero.  Zero amounts go unless every amount of the key is
    zero; then the first stays.  The zero rule joins two aggregates instead of opening
    a window over the key."""
    dust = F.lit("0.000000001").cast("decimal(20,9)")
    merged = amounts.groupBy(*keys, "commodity").agg(
        F.sum("quantity").cast(TOTAL).alias("quantity"),
        F.max("precision").alias("precision"),
        F.min(position).alias("first_seen"),
    )
    merged = merged.withColumn(
        "quantity", F.when(F.abs("quantity") < dust, F.lit(0)).otherwise(F.col("quantity")).cast(TOTAL)
    )
    state = merged.groupBy(*keys).agg(
        F.count(F.when(F.col("quantity") != 0, 1)).alias("_nonzero"), F.min("first_seen").alias("_first")
    )
    keep = (F.col("quantity") != 0) | ((F.col("_nonzero") == 0) & (F.col("first_seen") == F.col("_first")))
    return merged.join(state, keys).where(keep).drop("_nonzero", "_first")
