"""Calendar helpers: period buckets, register presets, ISO date check."""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, functions as F

# Report periods and the truncation unit of each.
PERIOD_UNITS = {
    "daily": "day",
    "weekly": "week",
    "monthly": "month",
    "quarterly": "quarter",
    "yearly": "year",
}

# Length of one period as an interval.
PERIOD_STEPS = {
    "daily": "1 day",
    "weekly": "7 days",
    "monthly": "1 month",
    "quarterly": "3 months",
    "yearly": "1 year",
}

# The register's date presets.
PRESETS = ("last-7-days", "last-30-days", "this-month", "last-month", "this-year", "last-year")


def period_start(date: Column, period: str) -> Column:
    """First day of the period; weeks start on Monday."""
    if period not in PERIOD_UNITS:
        raise ValueError(f"unknown period {period!r}")
    return F.date_trunc(PERIOD_UNITS[period], date.cast("timestamp_ntz")).cast("date")


def is_iso_date(text: Column) -> Column:
    """``YYYY-MM-DD`` and a day that exists; never raises under ANSI mode."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.coalesce(shape & F.try_to_date(text, "yyyy-MM-dd").isNotNull(), F.lit(False))


def iso_date(text: Column) -> Column:
    return F.when(is_iso_date(text), F.try_to_date(text, "yyyy-MM-dd"))


def preset_range(preset: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """Inclusive bounds of a preset.  Plain arithmetic on one date, so the bounds are
    literals in the plan and reach the scan."""
    first = today.replace(day=1)
    if preset == "last-7-days":
        return today - dt.timedelta(days=6), today
    if preset == "last-30-days":
        return today - dt.timedelta(days=29), today
    if preset == "this-month":
        return first, today.replace(day=calendar.monthrange(today.year, today.month)[1])
    if preset == "last-month":
        end = first - dt.timedelta(days=1)
        return end.replace(day=1), end
    if preset in ("this-year", "last-year"):
        year = today.year - (preset == "last-year")
        return dt.date(year, 1, 1), dt.date(year, 12, 31)
    raise ValueError(f"unknown preset {preset!r}")


def prefix_range(prefix: str) -> tuple[dt.date, dt.date]:
    """Half-open bounds of a ``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` prefix."""
    parts = [int(p) for p in prefix.split("-")]
    if len(parts) == 1:
        return dt.date(parts[0], 1, 1), dt.date(parts[0] + 1, 1, 1)
    if len(parts) == 2:
        start = dt.date(parts[0], parts[1], 1)
        return start, (start + dt.timedelta(days=31)).replace(day=1)
    if len(parts) == 3:
        start = dt.date(*parts)
        return start, start + dt.timedelta(days=1)
    raise ValueError(f"not a date prefix: {prefix!r}")


def in_window(date: Column, begin=None, end=None) -> Column:
    """Report convention: begin inclusive, end exclusive."""
    out = F.lit(True)
    if begin is not None:
        out = out & (date >= F.lit(begin).cast("date"))
    if end is not None:
        out = out & (date < F.lit(end).cast("date"))
    return out


def in_range(date: Column, first=None, last=None) -> Column:
    """Register convention: both ends inclusive, ``None`` is open."""
    out = F.lit(True)
    if first is not None:
        out = out & (date >= F.lit(first).cast("date"))
    if last is not None:
        out = out & (date <= F.lit(last).cast("date"))
    return out
