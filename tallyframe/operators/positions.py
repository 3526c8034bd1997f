"""Where a row stands in a sorted report, as a column.

A sorted frame is one only until it is joined, filtered or stored; a position outlives that,
serves pages of a report by a range, and can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyframe.operators.totals import brought_in
from tallyframe.scratch import materialize

#: Fixed value: bits of ``monotonically_increasing_id`` that count rows within a partition.
ROW_BITS = 33


def with_position(ordered: DataFrame, name: str = "position") -> DataFrame:
    """Number the rows of a sorted frame from 1, in its order.

    A sort leaves ranges in partitions of rising number, each in order.  Rows take their place
    within the partition as they are stored, once; the rows of earlier partitions are added from
    a table with one row per partition.  Nothing is sorted a second time, no window spans rows,
    and one key or day of any size spreads as the sort spreads it.  Rows that the order does not
    tell apart are numbered as they were stored.  A column ``name`` of the frame is replaced; an
    empty frame stays empty."""
    rows = materialize(
        ordered.drop(name)
        .withColumn("_run", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1) + 1),
        "positions",
    )
    per_run = rows.groupBy("_run").agg(F.count("*").alias("_rows"))
    runs = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    before = brought_in(per_run, [], ["_rows"], runs)
    place = F.col("_at") + F.coalesce("_rows_in", F.lit(0))
    return rows.join(before, "_run", "left").withColumn(name, place).drop("_run", "_at", "_rows_in")


def page(positioned: DataFrame, number: int, size: int, name: str = "position") -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, in order.

    A range of positions, so no row before the page is sorted or skipped over."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    return positioned.where(F.col(name).between((number - 1) * size + 1, number * size)).orderBy(name)
