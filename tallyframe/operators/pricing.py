"""Market prices: history, base commodity, price paths, valuation.

Price tables may be large (a price per commodity and day, or one per trade).  They are
cut to the latest price per pair, or per pair and period, by a map-side combining
aggregate before anything joins them; no join here is forced to broadcast, Spark
decides from the measured size.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.dates import PERIOD_STEPS, period_start
from tallyframe.model import PRICES, RATE, TOTAL, Ledger, conform
from tallyframe.operators.query import Query
from tallyframe.operators.reports import historical_balances, sheet_rows
from tallyframe.scratch import materialize


def inferred_prices(postings: DataFrame) -> DataFrame:
    """A posting bought at a cost prices its commodity on its date."""
    costed = postings.where(F.col("cost_quantity").isNotNull())
    return conform(
        costed.select(
            F.coalesce("pdate", "date").alias("date"),
            "commodity",
            F.abs("cost_quantity").alias("price"),
            F.col("cost_commodity").alias("target"),
            F.lit("inferred").alias("source"),
            F.col("tindex").alias("seq"),
        ),
        PRICES,
    )


def all_prices(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _declared_first() -> Column:
    return (F.col("source") == "declared").cast("int")


def base_commodity(prices: DataFrame) -> DataFrame:
    """Target of the latest declared price, of the latest inferred one when nothing is
    declared; one row, NULL without prices."""
    rank = F.struct(_declared_first().alias("d"), F.col("date"), F.col("seq"))
    return prices.agg(F.max_by("target", rank).alias("base_commodity"))


def latest_prices(prices: DataFrame, as_of: dt.date | None = None, by: list[str] | None = None) -> DataFrame:
    """Latest price per (commodity, target); on one date declared beats inferred and a
    later line beats an earlier one."""
    known = prices if as_of is None else prices.where(F.col("date") <= F.lit(as_of))
    # Date, source and line as one number.  A struct would be a clearer rank, but then
    # the aggregate sorts all price rows; over plain values it hashes them.
    place = F.unix_date("date") * 2 + _declared_first()
    rank = place.cast("decimal(18,0)") * F.lit(Decimal(10**19)) + F.col("seq").cast("decimal(19,0)")
    best = known.groupBy(*(by or []), "commodity", "target").agg(
        F.max_by("price", rank).alias("price"), F.max(place).alias("_place")
    )
    return best.select(
        *(by or []),
        "commodity",
        "target",
        "price",
        F.date_from_unix_date(F.floor(F.col("_place") / 2).cast("int")).alias("date"),
        F.when(F.pmod("_place", F.lit(2)) == 1, F.lit("declared")).otherwise(F.lit("inferred")).alias("source"),
    )


def period_prices(prices: DataFrame, period: str, last: dt.date) -> DataFrame:
    """The price in force at the end of each period, carried over periods without one.

    A pair keeps one row per period before any window sees it."""
    dated = prices.withColumn("period", period_start(F.col("date"), period)).where(F.col("date") <= F.lit(last))
    ends = latest_prices(dated, by=["period"])
    step = F.expr(f"interval {PERIOD_STEPS[period]}")
    later = F.lead("period").over(Window.partitionBy("commodity", "target").orderBy("period"))
    final = period_start(F.lit(last), period)
    held = ends.withColumn("until", F.coalesce((later - step).cast("date"), final))
    return held.select(
        F.explode(F.sequence("period", "until", step)).alias("period"), "commodity", "target", "price", "date", "source"
    )


def price_paths(latest: DataFrame, base: str, by: list[str] | None = None) -> DataFrame:
    """Rate of every commodity that reaches ``base`` over prices, however many.

    Fewest hops win, then fewest reversed prices.  A level holds the commodities that no
    shorter path reached, one row each; levels are stored until one adds no commodity."""
    by = by or []
    price = F.col("price").cast("double")
    hop = lambda src, dst, rate, turned: F.struct(
        src.alias("src"), dst.alias("dst"), rate.alias("step"), F.lit(turned).alias("turn")
    )
    edges = latest.where("price > 0 and commodity <> target").select(
        *by,
        F.inline(
            F.array(
                hop(F.col("commodity"), F.col("target"), price, 0),
                hop(F.col("target"), F.col("commodity"), F.lit(1.0) / price, 1),
            )
        ),
    )
    edges = edges.groupBy(*by, "src", "dst").agg(
        F.min_by("step", "turn").alias("step"), F.min("turn").alias("turn")
    )
    edges = materialize(edges.where(F.col("src") != base), "price-edges")
    columns = [*by, "commodity", "rate", "hops", "turns"]
    level = edges.where(F.col("dst") == base).select(
        *by, F.col("src").alias("commodity"), F.col("step").alias("rate"), F.lit(1).alias("hops"), F.col("turn").alias("turns")
    )
    known = level = materialize(level, "price-paths")
    while not level.isEmpty():
        reached = level.select(*by, F.col("commodity").alias("dst"), "rate", "turns", "hops")
        step = edges.join(reached, [*by, "dst"]).select(
            *by,
            F.col("src").alias("commodity"),
            F.col("dst").alias("via"),
            (F.col("step") * F.col("rate")).alias("rate"),
            (F.col("hops") + 1).alias("hops"),
            (F.col("turns") + F.col("turn")).alias("turns"),
        )
        best = step.groupBy(*by, "commodity").agg(
            F.min_by(F.struct("rate", "hops", "turns"), F.struct("turns", "via")).alias("p")
        )
        new = best.select(*by, "commodity", "p.*").join(known.select(*by, "commodity"), [*by, "commodity"], "left_anti")
        level = materialize(new.select(*columns), "price-paths")
        known = known.unionByName(level)
    return known.select(*columns)


def price_asof(needs: DataFrame, prices: DataFrame) -> DataFrame:
    """The price in force on each row's own date: adds ``target``, ``price`` and
    ``price_date`` (one row per quoted-in commodity).

    Dates are resolved once per distinct (commodity, date); a pair's timeline is then
    no longer than its calendar, and the rows meet it in an equi join."""
    daily = latest_prices(
        prices.withColumn("day", F.col("date")), by=["day"]
    ).select("commodity", "target", F.col("day").alias("date"), "price")
    pairs = daily.select("commodity", "target").distinct()
    asked = needs.select("commodity", "date").distinct().join(pairs, "commodity")
    line = daily.withColumn("asked", F.lit(0)).unionByName(
        asked.withColumns({"asked": F.lit(1), "price": F.lit(None).cast(RATE)})
    )
    # A price set on the asked date counts: it sorts before the question.
    upto = (
        Window.partitionBy("commodity", "target")
        .orderBy("date", "asked")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    known = line.select(
        "commodity",
        "target",
        "date",
        "asked",
        F.last("price", ignorenulls=True).over(upto).alias("price"),
        F.last(F.when(F.col("price").isNotNull(), F.col("date")), ignorenulls=True).over(upto).alias("price_date"),
    )
    resolved = known.where("asked = 1 and price is not null").drop("asked")
    return needs.join(resolved, ["commodity", "date"], "left")


def valued(rows: DataFrame, rates: DataFrame, base: str, by: list[str] | None = None) -> DataFrame:
    """Add ``value`` and ``value_commodity``; without a price path the native amount
    stands in."""
    rate = rates.select(*(by or []), "commodity", "rate")
    joined = rows.join(rate, [*(by or []), "commodity"], "left")
    amount = F.col("amount").cast("double")
    return joined.withColumns(
        {
            "value": F.when(F.col("commodity") == base, amount).otherwise(F.coalesce(amount * F.col("rate"), amount)),
            "value_commodity": F.when(F.col("rate").isNotNull(), F.lit(base)).otherwise(F.col("commodity")),
        }
    ).drop("rate")


def valued_sheet(
    ledger: Ledger, base: str, q: Query = Query(), as_of: dt.date | None = None
) -> DataFrame:
    """Balance sheet with each figure natively and at market value.

    Long form: one row per (kind, section, account, measure, commodity).  Values are
    rounded to cents once, after their last sum."""
    rows = sheet_rows(ledger, q)
    rates = price_paths(latest_prices(ledger.prices, as_of), base)
    both = valued(rows, rates, base).select(
        "section",
        "account",
        F.inline(
            F.array(
                F.struct(
                    F.lit("native").alias("measure"),
                    F.col("commodity").alias("commodity"),
                    F.col("amount").cast("double").alias("amount"),
                    F.col("amount").alias("exact"),
                ),
                F.struct(
                    F.lit("value").alias("measure"),
                    F.col("value_commodity").alias("commodity"),
                    F.col("value").alias("amount"),
                    F.lit(None).cast(TOTAL).alias("exact"),
                ),
            )
        ),
    )

    def summed(frame, *keys):
        # Native figures stay exact; only priced ones go through doubles.
        return frame.groupBy(*keys, "measure", "commodity").agg(
            F.coalesce(F.sum("exact").cast("decimal(28,2)"), F.sum("amount").cast("decimal(28,2)")).alias("amount")
        )

    accounts = summed(both, "section", "account").withColumn("kind", F.lit("account"))
    totals = summed(both, "section").withColumns({"kind": F.lit("total"), "account": F.lit("")})
    minus = F.col("section") == "Liabilities"
    flipped = both.withColumns(
        {c: F.when(minus, -F.col(c)).otherwise(F.col(c)) for c in ("amount", "exact")}
    )
    net = summed(flipped).withColumns({"kind": F.lit("net"), "section": F.lit("Net"), "account": F.lit("")})
    columns = ["kind", "section", "account", "measure", "commodity", "amount"]
    return accounts.select(columns).unionByName(totals.select(columns)).unionByName(net.select(columns))


def net_worth_trend(
    ledger: Ledger, base: str, q: Query, last: dt.date
) -> DataFrame:
    """Net worth at each period end, at the prices of that period end."""
    held = historical_balances(
        ledger.having(
            postings=ledger.postings.where(F.col("account").rlike(r"(?i)^(assets?|liabilit(y|ies))(:|$)")).withColumn(
                "account", F.lit("net")
            )
        ),
        q,
        last,
    )
    prices = period_prices(ledger.prices, q.period, last)
    worth = valued(held, price_paths(prices, base, by=["period"]), base, by=["period"])
    return worth.groupBy("period", F.col("value_commodity").alias("commodity")).agg(
        F.sum("value").cast("decimal(28,2)").alias("net_worth")
    )
