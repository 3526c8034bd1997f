"""Stored balances at period ends, so that a report of the past reads one of them and the postings after it.

A checkpoint holds the balance of every (account, commodity) over all postings before its day
``end``.  It grows with the chart of accounts, not with the books.  Checkpoints are written in
batches: one job folds the postings since the checkpoint before and gives the balances at all
period ends it passes.  A batch counts once Spark has marked it complete; where two hold the same
day the later one does, so postings that arrive late are met by folding again from their day.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.functions.dates import PERIOD_STEPS, in_window, period_start
from tallyframe.model import TOTAL, Ledger
from tallyframe.operators import reports
from tallyframe.operators.query import Query, matches, select_postings
from tallyframe.sources.storage import file_system

BALANCES = f"account string, commodity string, amount {TOTAL}"


def stored(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """Folder of the checkpoint of each day; one entry per period end, whatever the books hold."""
    system, place = file_system(spark, path)
    if not system.exists(place):
        return {}
    found = {}
    for folder in sorted(status.getPath().getName() for status in system.listStatus(place)):
        batch = f"{path.rstrip('/')}/{folder}"
        _, inner = file_system(spark, batch)
        names = [status.getPath().getName() for status in system.listStatus(inner)]
        if "_SUCCESS" in names:
            found |= {dt.date.fromisoformat(n[4:]): f"{batch}/{n}" for n in names if n.startswith("end=")}
    return found


def opening(spark: SparkSession, path: str, day: dt.date) -> tuple[dt.date | None, DataFrame]:
    """The last checkpoint at or before ``day`` and its balances; None and no rows where there is none."""
    found = stored(spark, path)
    end = max((e for e in found if e <= day), default=None)
    if end is None:
        return None, spark.createDataFrame([], BALANCES)
    return end, spark.read.schema(BALANCES).parquet(found[end])


def fold(ledger: Ledger, path: str, last: dt.date, period: str = "monthly", since: dt.date | None = None) -> int:
    """Store the balances at every end of a ``period`` up to ``last``; how many there are.

    Only postings from the newest checkpoint on are read, or from the newest one at or before
    ``since``: the day from which postings were added or changed.  Balances of zero are kept, so
    that a day on which nothing is left is known as such; postings without a date are in none."""
    spark = ledger.postings.sparkSession
    found = stored(spark, path)
    base = max((e for e in found if since is None or e <= since), default=None)
    before = spark.createDataFrame([], BALANCES) if base is None else spark.read.schema(BALANCES).parquet(found[base])
    step = F.expr(f"interval {PERIOD_STEPS[period]}")
    ends = lambda day: (period_start(day, period) + step).cast("date")
    steps = (
        ledger.postings.where(in_window(F.col("date"), base, last) & F.col("date").isNotNull())
        .groupBy("account", "commodity", ends(F.col("date")).alias("end"))
        .agg(F.sum("quantity").cast(TOTAL).alias("amount"))
    )
    if base is not None:
        steps = steps.unionByName(before.withColumn("end", ends(F.lit(base))))
        steps = steps.groupBy("account", "commodity", "end").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    # Spans the periods of one account and commodity, never postings.
    by = Window.partitionBy("account", "commodity").orderBy("end")
    final = period_start(F.lit(last), period)
    held = steps.select(
        "account", "commodity", "end",
        F.sum("amount").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast(TOTAL).alias("amount"),
        F.coalesce((F.lead("end").over(by) - step).cast("date"), final).alias("until"),
    ).where(F.col("end") <= F.least("until", final))
    rows = held.select("account", "commodity", "amount", F.explode(F.sequence("end", F.least("until", final), step)).alias("end"))
    batches = len({folder.rsplit("/", 2)[-2] for folder in found.values()})
    folder = f"{path.rstrip('/')}/{batches + 1:08d}-{uuid.uuid4().hex}"
    rows.hint("rebalance", "end").write.partitionBy("end").parquet(folder)
    return sum(place.startswith(folder) for place in stored(spark, path).values())


def _plain(q: Query) -> None:
    if any((q.description, q.payee, q.amount, q.tag, q.status)):
        raise ValueError("checkpoints hold whole balances: only accounts, depth and dates can be asked for")


def _chosen(balances: DataFrame, q: Query) -> DataFrame:
    rows = balances if q.account is None else balances.where(matches(F.col("account"), q.account))
    return reports.named(rows, q)


def balance(ledger: Ledger, path: str, q: Query) -> DataFrame:
    """``reports.balance`` of everything before ``q.stop``, from a checkpoint and the postings after it."""
    _plain(q)
    if q.stop is None or q.begin is not None:
        raise ValueError("a balance from a checkpoint needs an end and no beginning")
    end, before = opening(ledger.postings.sparkSession, path, q.stop)
    tail = reports.named(select_postings(ledger, replace(q, begin=end)), q)
    parts = _chosen(before, q).unionByName(
        tail.select("account", "commodity", F.col("quantity").cast(TOTAL).alias("amount"))
    )
    sums = parts.groupBy("account", "commodity").agg(F.sum("amount").cast(TOTAL).alias("amount"))
    return sums.where("amount <> 0").withColumn("amount", -F.col("amount") if q.invert else F.col("amount"))


def historical_balances(ledger: Ledger, path: str, q: Query, last: dt.date) -> DataFrame:
    """``reports.historical_balances`` from ``q.begin`` on; older postings are not read."""
    _plain(q)
    if q.begin is None:
        raise ValueError("balances from a checkpoint need a beginning")
    # a checkpoint inside the first period would come after part of it
    spark = ledger.postings.sparkSession
    first = spark.range(1).select(period_start(F.lit(q.begin), q.period)).first()[0]
    end, before = opening(spark, path, first)
    held = None
    if end is not None:
        period = period_start(F.lit(end - dt.timedelta(days=1)), q.period)
        held = _chosen(before, q).groupBy("account", "commodity").agg(F.sum("amount").cast(TOTAL).alias("amount"))
        held = held.withColumn("period", period)
    return reports.historical_balances(ledger, q, last, since=end, held=held)


def account_register(ledger: Ledger, path: str, root: str, q: Query) -> DataFrame:
    """``reports.account_register`` from ``q.begin`` on, its running balance carried from a checkpoint."""
    _plain(q)
    if q.begin is None:
        raise ValueError("a register from a checkpoint needs a beginning")
    end, before = opening(ledger.postings.sparkSession, path, q.begin)
    return reports.account_register(ledger, root, q, since=end, held=before if end is not None else None)
