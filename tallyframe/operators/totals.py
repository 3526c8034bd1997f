"""Running totals that no single key can overload.

A window over a hot account or commodity would put its whole history into one task.
Here the rows are range-partitioned on (keys, order): a key of any size spreads over
as many runs as it needs, and there are as many as the bytes read ask for.  Each run sums on its own, and the balance a key brings into
a run is added from a table with at most one row per run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DecimalType

from tallyframe.scratch import materialize

#: Input bytes, as stored, that one run of a large table stands for.
RUN_BYTES = 256 << 20
#: Input bytes, as stored, whose joined and grouped rows one task holds at a time.
TASK_BYTES = 16 << 20
#: Runs that one window may carry over; more are carried in two levels.
ONE_LEVEL = 4096
#: Sizes from here on mean that Spark does not know one.
UNKNOWN_BYTES = 1 << 60


def bytes_read(df: DataFrame) -> int:
    """Stored bytes of what ``df`` reads.

    Leaves of the plan are added up, as estimates above joins multiply."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def spread(df: DataFrame, *keys: str, beside: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``df`` by hash of ``keys`` over as many tasks as the bytes read ask for, small input as it is;
    what it is to be joined with may be named to count as well.

    Adaptive execution merges partitions by their compressed size, and rows that compress well then
    fill the memory of one task with sorts and hash tables; a given number is left alone.  A join or
    grouping by ``keys`` that follows needs no further shuffle of these rows."""
    tasks = sum(map(bytes_read, (df, *beside))) // TASK_BYTES
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(tasks, least), *keys) if tasks > 1 else df


def run_count(df: DataFrame) -> int | None:
    """Runs that suit the size of what ``df`` reads; None where the configured number of shuffle
    partitions, which adaptive execution may lower, is enough."""
    runs = bytes_read(df) // RUN_BYTES
    return runs if runs > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def brought_in(per_run: DataFrame, keys: list[str], parts: list[str], runs: int) -> DataFrame:
    """(_run, keys, part_in): what earlier runs of a key sum to, where there are any.

    Runs are contiguous in key order, so only the first key of a run can have begun in an
    earlier one: at most one row per run comes of it.  Many runs are summed by blocks of
    neighbours, blocks are carried over first and runs within their block: no window then
    holds more than about the square root of all runs."""
    before = lambda by, order: (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    if runs <= ONE_LEVEL:
        carried = per_run.select(
            "_run", *keys,
            F.count("*").over(before(keys, "_run")).alias("_earlier"),
            *[F.sum(p).over(before(keys, "_run")).alias(f"{p}_in") for p in parts],
        )
        return carried.where("_earlier > 0").drop("_earlier")
    blocked = per_run.withColumn("_block", F.floor(F.col("_run") / math.isqrt(runs)))
    block = [*keys, "_block"]
    per_block = blocked.groupBy(*block).agg(*[F.sum(p).alias(p) for p in parts])
    of_blocks = per_block.select(
        *[F.col(c).alias(f"_of_{c}") for c in block],
        F.count("*").over(before(keys, "_block")).alias("_blocks"),
        *[F.sum(p).over(before(keys, "_block")).alias(f"{p}_far") for p in parts],
    ).where("_blocks > 0")
    same = F.lit(True)
    for c in block:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    near = blocked.select(
        "_run", *block,
        F.count("*").over(before(block, "_run")).alias("_earlier"),
        *[F.sum(p).over(before(block, "_run")).alias(f"{p}_near") for p in parts],
    )
    joined = near.join(of_blocks, same, "left").where("_earlier > 0 or _blocks > 0")
    plus = lambda p: F.when(F.col(f"{p}_near").isNull(), F.col(f"{p}_far")).when(
        F.col(f"{p}_far").isNull(), F.col(f"{p}_near")
    ).otherwise(F.col(f"{p}_near") + F.col(f"{p}_far"))
    return joined.select("_run", *keys, *[plus(p).alias(f"{p}_in") for p in parts])


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    totals: dict[str, Column],
    runs: int | None = None,
) -> DataFrame:
    """Add the inclusive running sum of each of ``totals`` per ``keys`` in ``order``.

    Unless ``runs`` is given it follows from the bytes read (``run_count``); for less than the
    shuffle partitions hold, adaptive execution merges neighbouring ranges to a sensible size.
    Ranges stay in order, which is all that counts."""
    runs = runs or run_count(df)
    parts = {f"_part_{name}": value for name, value in totals.items()}
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = (
        df.withColumns(parts)
        .repartitionByRange(*([runs] if runs else []), *[F.col(k) for k in keys], *order)
        .withColumn("_run", F.spark_partition_id())
    )
    # Written once: the run of a row depends on sampled bounds and must not be
    # evaluated a second time.
    placed = materialize(placed, "runs")

    per_run = placed.groupBy("_run", *keys).agg(*[F.sum(p).alias(p) for p in parts])
    carried = brought_in(per_run, keys, list(parts), runs or 0)
    # Sums of decimals get the widest type; narrowed first, they add without losing scale.
    kinds = {p: placed.schema[p].dataType for p in parts}
    room = {p: f"decimal(34,{k.scale})" if isinstance(k, DecimalType) else "bigint" for p, k in kinds.items()}
    within = (
        Window.partitionBy("_run", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = placed.join(carried, ["_run", *keys], "left")
    sums = {
        name: F.sum(f"_part_{name}").over(within).cast(room[f"_part_{name}"])
        + F.coalesce(F.col(f"_part_{name}_in"), F.lit(0)).cast(room[f"_part_{name}"])
        for name in totals
    }
    return joined.withColumns(sums).drop("_run", *parts, *[f"{p}_in" for p in parts])


def split_totals(df: DataFrame, totals: dict[str, Column], per_file: bool = False) -> DataFrame:
    """Add the inclusive running sum of each of ``totals`` (whole numbers) over rows of text, in file order.

    ``df`` holds (file, block, seq): the rows of one split, told by where it begins in its
    file, stand in one task's share of the input and never outgrow it.  They are summed
    there; what earlier splits bring in is a table with one row per split, scanned by
    ``running_totals``.  No row is sampled and none leaves its split.  With ``per_file``
    sums start anew with each file."""
    parts = {f"_part_{name}": value.cast("bigint") for name, value in totals.items()}
    placed = df.withColumns(parts)
    split = ["file", "block"]
    per_split = placed.groupBy(*split).agg(*[F.sum(p).alias(p) for p in parts])
    reached = running_totals(
        per_split, ["file"] if per_file else [], ["block"] if per_file else split, {f"{p}_in": F.col(p) for p in parts}
    )
    carried = reached.select(*split, *[(F.col(f"{p}_in") - F.col(p)).alias(f"{p}_in") for p in parts])
    within = Window.partitionBy(*split).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {name: F.sum(f"_part_{name}").over(within) + F.col(f"_part_{name}_in") for name in totals}
    return placed.join(carried, split).withColumns(sums).drop(*parts, *[f"{p}_in" for p in parts])
