"""Account paths: ``:``-separated segments, typed by the first one."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Top segments of the five account types.
TYPE_PATTERNS = {
    "Assets": r"(?i)^assets?(:|$)",
    "Liabilities": r"(?i)^liabilit(y|ies)(:|$)",
    "Equity": r"(?i)^equity(:|$)",
    "Revenues": r"(?i)^(income|revenues?)(:|$)",
    "Expenses": r"(?i)^expenses?(:|$)",
}


def account_type(account: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in TYPE_PATTERNS.items():
        out = F.when(account.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_type(account: Column, *types: str) -> Column:
    """One regular expression for all ``types``, so a row is matched once."""
    heads = "|".join(TYPE_PATTERNS[t].removeprefix("(?i)") for t in types)
    return account.rlike(f"(?i){heads}")


def is_balance_sheet(account: Column) -> Column:
    return is_type(account, "Assets", "Liabilities")


def depth_clip(account: Column, depth: int) -> Column:
    """The first ``depth`` segments; 0 folds everything into one line."""
    if depth < 0:
        raise ValueError("depth must not be negative")
    if depth == 0:
        return F.lit("...")
    return F.substring_index(account, ":", depth)


def depth_of(account: Column) -> Column:
    return F.size(F.split(account, ":"))


def in_subtree(account: Column, root: str) -> Column:
    """``root`` itself or any subaccount of it."""
    return (account == root) | account.startswith(root + ":")
