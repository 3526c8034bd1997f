"""Guarded bulk corrections.

An edit rewrites frames lazily and returns a new ledger.  Nothing is stored until the
rewritten ledger has been validated as a whole; then it goes to a new snapshot path,
so a refused or interrupted edit leaves the old books as they were.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyframe.model import Ledger, keys_of
from tallyframe.operators.query import STATUS_NAMES, check_terms, matching_transactions
from tallyframe.operators.totals import spread
from tallyframe.operators.validate import validate
from tallyframe.scratch import materialize

#: Folder of a snapshot that is written last and names its frames.
COMPLETE = "complete"
ACTIONS = ("change_account", "change_payee", "set_status")


@dataclass(frozen=True)
class Edit:
    """``to`` replaces ``old`` (``from`` is a Python keyword) in what ``terms`` match."""

    terms: tuple[str, ...]
    action: str
    to: str
    old: str | None = None

    def check(self) -> None:
        """Refuse bad arguments before any job starts."""
        check_terms(list(self.terms))
        if self.action not in ACTIONS:
            raise ValueError(f"unsupported action {self.action!r}; expected one of {', '.join(ACTIONS)}")
        if not self.to or not self.to.strip():
            raise ValueError("to must not be empty")
        if self.to != self.to.strip():
            raise ValueError("to must not begin or end with white space")
        if self.action != "set_status" and not (self.old or "").strip():
            raise ValueError(f"from is required for {self.action}")
        if self.action == "change_account" and re.search(r"\t| {2}", self.to):
            raise ValueError("an account must not hold a tab or two blanks in a row")
        if self.action == "change_payee" and re.search(r"[|;]", self.to):
            raise ValueError("a payee must not hold '|' or ';'")
        if self.action == "set_status" and self.to not in STATUS_NAMES:
            raise ValueError(f"to must be one of {', '.join(STATUS_NAMES)}")


def edit_targets(ledger: Ledger, edit: Edit) -> DataFrame:
    """Keys of the transactions an edit may touch: those the query matches, and for an
    account change only those with a posting that equals ``old``."""
    edit.check()
    heads = matching_transactions(ledger, list(edit.terms))
    if edit.action == "change_account":
        holding = ledger.postings.where(F.col("account") == edit.old)
        heads = heads.join(keys_of(holding), "tindex", "left_semi")
    return heads.select("tindex")


def rewrite(ledger: Ledger, edit: Edit, targets: DataFrame | None = None) -> Ledger:
    """The ledger after the edit.  Only rows that hold the old value meet the targets in
    a join; all others pass through unshuffled.  ``targets`` may be given where the ledger
    is only a part of the books they were found in."""
    targets = (edit_targets(ledger, edit) if targets is None else targets).withColumn("_hit", F.lit(True))

    def replaced(frame: DataFrame, column: str, old_rows, new) -> DataFrame:
        candidates = frame.where(F.coalesce(old_rows, F.lit(False))).join(targets, "tindex", "left")
        changed = candidates.withColumn(column, F.when(F.col("_hit"), F.lit(new)).otherwise(F.col(column)))
        return frame.where(~F.coalesce(old_rows, F.lit(False))).unionByName(changed.select(*frame.columns))

    if edit.action == "change_account":
        return ledger.having(postings=replaced(ledger.postings, "account", F.col("account") == edit.old, edit.to))
    if edit.action == "change_payee":
        return ledger.having(transactions=replaced(ledger.transactions, "payee", F.col("payee") == edit.old, edit.to))
    status = STATUS_NAMES[edit.to]
    return ledger.having(
        transactions=replaced(ledger.transactions, "status", ~F.col("status").eqNullSafe(F.lit(status)), status)
    )


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows only one snapshot holds, with a ``side`` and the number of ``copies``.

    Compared as multisets in one shuffle, so rows need no key and duplicates count.  Rows meet
    before they are counted: hardly any are equal within one task's share of the input, where a
    table of all of them would grow with that share."""
    columns = before.columns
    sides = before.withColumn("_n", F.lit(1)).unionByName(after.select(*columns).withColumn("_n", F.lit(-1)))
    sums = spread(sides, *columns).groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return sums.select(
        F.when(F.col("_n") > 0, F.lit("before")).otherwise(F.lit("after")).alias("side"),
        *columns,
        F.abs("_n").cast("bigint").alias("copies"),
    )


def edit_summary(before: Ledger, after: Ledger, edit: Edit) -> DataFrame:
    """One row: what changed and how it reads."""
    if edit.action == "change_account":
        old, new = before.postings, after.postings
    else:
        old, new = before.transactions, after.transactions
    gone = diff(old, new).where("side = 'before'")
    counts = gone.groupBy("tindex").agg(F.sum("copies").alias("rows")).agg(
        F.count("*").alias("transactions"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")
    )
    postings = F.col("rows") if edit.action == "change_account" else F.lit(0).cast("bigint")
    text = {
        "change_account": F.format_string(
            f"%d posting(s) across %d transaction(s) -> {edit.to}", F.col("rows"), F.col("transactions")
        ),
        "change_payee": F.format_string(f'%d payee(s) renamed to "{edit.to}"', F.col("transactions")),
        "set_status": F.format_string(f"%d transaction(s) marked {edit.to}", F.col("transactions")),
    }[edit.action]
    return counts.select("transactions", postings.alias("postings"), text.alias("summary"))


@dataclass(frozen=True)
class EditResult:
    changes: DataFrame
    violations: DataFrame
    valid: bool
    path: str | None


def store_snapshot(ledger: Ledger, path: str) -> None:
    """All frames the ledger has, then a list of their names; a snapshot without that list is unfinished."""
    frames = {name: getattr(ledger, name) for name in Ledger.FRAMES}
    frames = {name: frame for name, frame in frames.items() if frame is not None}
    for name, frame in frames.items():
        frame.write.parquet(f"{path}/{name}")
    spark = ledger.transactions.sparkSession
    spark.createDataFrame([(name,) for name in frames], "frame string").coalesce(1).write.parquet(f"{path}/{COMPLETE}")


def read_snapshot(spark: SparkSession, path: str) -> Ledger:
    """A stored snapshot; one whose storing was interrupted is refused."""
    try:
        names = [row.frame for row in spark.read.parquet(f"{path}/{COMPLETE}").collect()]
    except AnalysisException as missing:
        raise ValueError(f"no complete snapshot in {path}") from missing
    return Ledger(**{name: spark.read.parquet(f"{path}/{name}") for name in names})


def apply_edit(ledger: Ledger, edit: Edit, path: str, dry_run: bool = False) -> EditResult:
    """Rewrite, validate, then store as a new snapshot below ``path``.

    A dry run reports the same and stores nothing.  An edit that would leave the ledger
    invalid is refused as a whole."""
    after = rewrite(ledger, edit)
    if edit.action == "change_account":
        changes = diff(ledger.postings, after.postings)
    else:
        changes = diff(ledger.transactions, after.transactions)
    violations = validate(after)
    valid = violations.isEmpty()
    if dry_run:
        return EditResult(changes, violations, valid, None)
    if not valid:
        raise ValueError("edit refused: the ledger would have errors")
    changes = materialize(changes, "changes")
    store_snapshot(after, path)
    return EditResult(changes, violations, True, path)
