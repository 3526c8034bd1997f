"""Reports and tables on storage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tallyframe.functions.text import trim_all
from tallyframe.scratch import scratch_path
from tallyframe.sources.storage import month_routed

# Sizes, in characters, that decide how much of a report is shown.
INLINE_CHARS = 50 * 1024
PREVIEW_CHARS = 2_000

# Output formats of a report.
FORMATS = ("txt", "csv", "json", "tsv")


def append_months(df: DataFrame, path: str, violations: DataFrame | None = None) -> None:
    """Append rows to their month's folder, after the batch was found valid.

    The rebalance hint sizes the output by bytes: a crowded month is split, thin ones
    share a task."""
    if violations is not None and not violations.isEmpty():
        raise ValueError("append refused: the batch has errors")
    routed = month_routed(df).hint("rebalance", "year", "month")
    routed.write.mode("append").partitionBy("year", "month").parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown output format {fmt!r}")
    if fmt == "json":
        df.write.json(path)
    elif fmt == "txt":
        df.select(F.concat_ws("  ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value")).write.text(path)
    else:
        df.write.csv(path, header=True, sep="\t" if fmt == "tsv" else ",", escape='"', emptyValue="")


def csv_field(text: Column) -> Column:
    """RFC 4180: quoted when it holds a comma, quote or line break, quotes doubled."""
    doubled = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike(r'[",\r\n]'), doubled).otherwise(text)


def export_csv(df: DataFrame, path: str) -> None:
    """Trimmed cells, CRLF rows, one header: the part files in name order are the table.

    Written as text, because the CSV writer would turn a line break inside a cell into
    the row separator."""
    cells = [csv_field(F.coalesce(trim_all(F.col(c).cast("string")), F.lit(""))) for c in df.columns]
    header = df.sparkSession.range(1).select(
        F.concat_ws(",", *[csv_field(F.lit(c)) for c in df.columns]).alias("value")
    )
    lines = header.unionByName(df.select(F.concat_ws(",", *cells).alias("value")))
    lines.write.text(path, lineSep="\r\n")


@dataclass(frozen=True)
class Preview:
    text: str
    path: str | None


def _head(lines: DataFrame, budget: int) -> str:
    """At most ``budget`` characters, ending at a line break.  Every line costs at least
    its break, so ``budget`` cut lines are enough and bound what the driver receives."""
    rows = lines.select(F.substring("line", 1, budget + 1).alias("line")).limit(budget).collect()
    out, used = [], 0
    for row in rows:
        if used + len(row.line) > budget:
            break
        out.append(row.line)
        used += len(row.line) + 1
    if not out and rows:
        return rows[0].line[:budget]
    return "\n".join(out)


def preview(
    df: DataFrame, inline_chars: int = INLINE_CHARS, preview_chars: int = PREVIEW_CHARS
) -> Preview:
    """A report as text: whole when small, else its head and where all of it is stored.

    The full result is only ever written, by all tasks; its size is measured there.  When
    storage fails the head is still shown."""
    header = ",".join(df.columns)
    # Partition and row number keep the order of a sorted report.
    lines = df.select(
        F.to_csv(F.struct(*df.columns), {"escape": '"', "emptyValue": ""}).alias("line"),
        F.monotonically_increasing_id().alias("n"),
    )
    path = scratch_path(df.sparkSession, "report")
    try:
        lines.write.parquet(path)
    except Exception as error:  # storage is a convenience, the head is not
        head = _head(lines, preview_chars)
        return Preview(f"{header}\n{head}\n[preview only; full output not stored: {type(error).__name__}]", None)
    saved = df.sparkSession.read.schema(lines.schema).parquet(path)
    count, chars = saved.agg(F.count("*"), F.sum(F.length("line") + 1)).first()
    if not count:
        return Preview("(no results)", None)
    ordered = saved.orderBy("n")
    if chars <= inline_chars:
        return Preview("\n".join([header, *[r.line for r in ordered.collect()]]), None)
    head = _head(ordered, preview_chars)
    return Preview(f"{header}\n{head}\n[preview only; all {count} rows in {path}]", path)
