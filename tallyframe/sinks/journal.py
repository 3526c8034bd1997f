"""Ledger tables as journal text.

Lines stay rows with their sort key; nothing concatenates a transaction, so its length
does not matter.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, functions as F

from tallyframe.functions.journal import assertion_text, bracketed, header_text, posting_text, price_text, tag_line
from tallyframe.functions.text import name_key
from tallyframe.model import Ledger
from tallyframe.operators.validate import batch_errors, undeclared
from tallyframe.scratch import shuffles_dropped
from tallyframe.sources.storage import MANIFESTS, batches, file_system, month_routed

LINE_ORDER = ["date", "tindex", "part", "side", "leg", "pos", "line"]


def render_journal(ledger: Ledger, two_decimals: bool = False, blank_lines: bool = False) -> DataFrame:
    """(date, tindex, part, side, leg, pos, line): header, tags by name, negative legs,
    then the others in leg order."""
    zero = F.lit(0)

    def rows(frame, part, side, leg, pos, line):
        return frame.select(
            "date", "tindex", F.lit(part).alias("part"), side.alias("side"), leg.alias("leg"), pos.alias("pos"),
            line.alias("line"),
        )

    heads = ledger.transactions
    header = header_text(F.col("date"), F.col("payee"), F.col("note"), F.col("status"))
    out = rows(heads, 0, zero, zero, zero, header)
    ordered = F.array_sort(
        F.transform("tags", lambda t, i: F.struct(name_key(t["name"]).alias("k"), i.alias("i"), t.alias("t")))
    )
    tagged = heads.select("date", "tindex", F.posexplode(ordered).alias("n", "tag"))
    out = out.unionByName(rows(tagged, 1, zero, F.col("n"), zero, tag_line(F.col("tag.t"))))
    digits = None if two_decimals else F.col("precision")
    text = posting_text(bracketed(F.col("account"), F.col("kind")), F.col("quantity"), F.col("commodity"), digits)
    side = F.when(F.col("quantity") < 0, 0).otherwise(1)
    out = out.unionByName(
        rows(ledger.postings.where("quantity is not null"), 2, side, F.col("leg"), F.col("pos"), text)
    )
    if blank_lines:
        out = out.unionByName(rows(heads, 3, zero, zero, zero, F.lit("")))
    return out


def write_journal(lines: DataFrame, path: str, *folders: str, codec: str | None = None) -> None:
    """Month folders of text in journal order, and further folder columns below them.

    Range partitioning on the whole line order lets a big month, or a big transaction,
    continue in the next part file; part files of a folder read in name order.  ``codec``
    compresses them; each is then read by one task."""
    routed = month_routed(lines)
    # Folders lead the order: the writer would else sort by them and lose the rest.
    order = ["year", "month", *folders, *LINE_ORDER]
    with shuffles_dropped(lines.sparkSession):
        (
            routed.repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .select("line", "year", "month", *folders)
            .write.mode("append")
            .partitionBy("year", "month", *folders)
            .text(path, compression=codec)
        )


def append_journal(ledger: Ledger, path: str, batch: str, codec: str | None = None) -> bool:
    """Append entries to their months as one batch; False where that batch is there already.

    The batch is checked first and refused whole.  Its lines go to a folder of its own
    below each month, numbered so that batches read one after the other however many part
    files each has.  Readers see it once its manifest is there, which is written last and
    never over another one: what a lost writer leaves is passed over, the same batch again
    changes nothing, and of two writers of one number the later one fails and may retry."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError(f"bad batch name {batch!r}")
    spark = ledger.transactions.sparkSession
    known = batches(spark, path)
    last = 0
    if known is not None:
        last, same = known.agg(F.coalesce(F.max("number"), F.lit(0)), F.count(F.when(F.col("batch") == batch, 1))).first()
        if same:
            return False
    with shuffles_dropped(spark):
        wrong = batch_errors(ledger).limit(5).collect()
    if wrong:
        raise ValueError("append refused: " + "; ".join(f"{r.rule} of {r.tindex} {r.detail}".strip() for r in wrong))
    folder = f"{last + 1:06d}-{batch}-{uuid.uuid4().hex[:8]}"
    lines = render_journal(ledger, blank_lines=True).withColumn("batch", F.lit(folder))
    write_journal(lines, path, "batch", codec=codec)
    system, place = file_system(spark, f"{path.rstrip('/')}/{MANIFESTS}/{last + 1:06d}.json")
    stream = system.create(place, False)  # fails where another writer took the number
    stream.write(bytearray(json.dumps({"number": last + 1, "batch": batch, "folder": folder}).encode()))
    stream.close()
    return True


def render_assertions(assertions: DataFrame, two_decimals: bool = False) -> DataFrame:
    digits = None if two_decimals else F.col("precision")
    text = assertion_text(F.col("date"), F.col("account"), F.col("quantity"), F.col("commodity"), digits)
    return assertions.select("date", "tindex", text.alias("entry"))


def render_prices(prices: DataFrame) -> DataFrame:
    line = price_text(F.col("date"), F.col("commodity"), F.col("price"), F.col("target"))
    return prices.select("date", "seq", line.alias("line"))


def missing_declarations(ledger: Ledger) -> DataFrame:
    """Declaration lines for commodities in use that have none; symbols compare whole."""
    names = undeclared(ledger).where("kind = 'commodity' and name <> ''")
    return names.select(F.concat(F.lit("commodity "), "name").alias("line"))
