"""Journal text as tables.

Journals are read line by line, so one huge file splits over many tasks.  What a line
belongs to follows from running counts of header, posting and break lines in file
order.  Tasks count along as they read; what splits bring into the ones after them is a
table with a row per split, so no line is shuffled and no file or transaction has to fit
into one task.
"""

from __future__ import annotations

import datetime as dt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tallyframe.functions.dates import iso_date
from tallyframe.functions.journal import (
    HEADER,
    PRICE_LINE,
    evaluated,
    header_date,
    if_has,
    kind_of,
    parse_amount,
    parsed_amounts,
    parse_tags,
    posting_fields,
    state_of_mark,
    symbol_of,
)
from tallyframe.functions.text import split_description
from tallyframe.model import ASSERTIONS, COSTED, POSTINGS, PRICE, PRICES, QUANTITY, RATE, TOTAL, TRANSACTIONS, Ledger, conform
from tallyframe.operators.totals import running_totals
from tallyframe.scratch import materialize
from tallyframe.sources.storage import batches, has_months


def journal_lines(
    spark: SparkSession, path: str, begin: dt.date | None = None, end: dt.date | None = None
) -> DataFrame:
    """Lines of text files with their position: (file, block, seq, line).

    ``block`` is where the split begins in the file and ``seq`` grows inside a split,
    so the three order the lines of a folder whatever the split size.  Where the sinks
    wrote the folder, bounds prune it to the months that overlap [begin, end) before files
    are listed, and only batches with a manifest are read; other folders are read whole."""
    place = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        F.col("value").alias("line"),
    ]
    if not has_months(spark, path):
        return spark.read.text(path, recursiveFileLookup=True).select(*place)
    committed = batches(spark, path)
    folders = "year int, month string" + ("" if committed is None else ", batch string")
    text = spark.read.schema(f"value string, {folders}").text(path)
    month = F.col("year") * 12 + F.col("month").cast("int")
    if begin is not None:
        text = text.where(month >= begin.year * 12 + begin.month)
    if end is not None:
        last = end - dt.timedelta(days=1)
        text = text.where(month <= last.year * 12 + last.month)
    if committed is None:
        return text.select(*place)
    known = F.broadcast(committed.select(F.col("folder").alias("batch")))  # so lines stay in file order
    return text.select(*place, "batch").join(known, "batch", "left_semi").drop("batch")


def price_directives(lines: DataFrame) -> DataFrame:
    """``P`` lines; a line without date, commodity, number and target is no price.

    Prices keep 18 places; a finer one is an error, not a rounded price."""
    too_fine = F.col("a.precision") > 18
    part = lambda i: F.regexp_extract("line", PRICE_LINE, i)
    split = evaluated(
        lines.where(F.col("line").rlike(PRICE_LINE)), day=part(1), name=part(2), amount=F.trim(part(3))
    )
    rows = evaluated(split, date=iso_date(F.col("day")), a=parse_amount(F.col("amount"), RATE)).select(
        "date",
        F.regexp_replace("name", '^"|"$', "").alias("commodity"),
        F.when(too_fine, F.raise_error(F.lit("a price has more than 18 places"))).otherwise(F.col("a.quantity")).alias("price"),
        F.col("a.commodity").alias("target"),
        F.lit("declared").alias("source"),
        *([F.col("seq")] if "seq" in lines.columns else []),
    )
    return conform(rows.where("date is not null and price is not null and target <> ''"), PRICES)


def account_declarations(lines: DataFrame) -> DataFrame:
    """``account NAME  ; comment``."""
    pattern = r"^account\s+(.+?)(?:(?: {2,}|\t+)\s*;\s*(.*)|\s*)$"
    return lines.where(F.col("line").rlike(r"^account\s+\S")).select(
        F.regexp_extract("line", pattern, 1).alias("account"), F.regexp_extract("line", pattern, 2).alias("comment")
    )


def commodity_declarations(lines: DataFrame) -> DataFrame:
    """``commodity SYM`` or ``commodity 1,000.00 SYM``."""
    text = F.regexp_replace(F.regexp_extract("line", r"^commodity\s+(.*)$", 1), r"\s*;.*$", "")
    return lines.where(F.col("line").rlike(r"^commodity\s+\S")).select(symbol_of(text).alias("commodity"))


#: Kinds of lines; from ``_BREAK`` on they end the transaction before them.
_COMMENT, _POSTING, _BREAK, _HEADER, _SPLIT_END = range(5)
_NO_DAY = -(1 << 31)
_PLACED = "file string, block long, line string, kind int, number long, heads long, leg long, day int, opened boolean"


def _in_file_order(lines: DataFrame) -> DataFrame:
    """``lines`` with each split in one task and its lines in order.

    What tasks read from text files and only filter is so; all else is shuffled and sorted."""
    node = lines._jdf.queryExecution().sparkPlan()
    while (name := node.nodeName().strip()) in ("Project", "Filter", "BroadcastHashJoin"):
        if name == "BroadcastHashJoin" and node.joinType().toString() != "LeftSemi":
            break
        node = node.children().apply(0)
    if name.startswith("Scan text"):
        return lines
    return lines.repartition("file", "block").sortWithinPartitions("file", "block", "seq")


def _counted(batches):
    """Lines (file, block, seq, line, kind, day) in file order with counts from the beginning of their split on:
    ``number`` of lines (none of postings), ``heads``, the postings (``leg``) of the transaction so far and the ``day``
    of its header, where it has one that is a date; ``opened`` where a line that ends transactions came before in the
    split.  A split ends with a row that holds what it came to."""
    names = [c.split()[0] for c in _PLACED.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
    place, came_to = None, None

    def ended(splits):
        columns = zip(*[(f, b, None, _SPLIT_END, n, h, legs - base, None if d == _NO_DAY else d, o) for (f, b), (n, h, legs, base, d, o, _) in splits])
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = batch.column("file").cast(pa.string()), batch.column("block").to_numpy()
        seq, kind, day = (batch.column(c).to_numpy() for c in ("seq", "kind", "day"))
        codes = file.dictionary_encode().indices.to_numpy()
        cuts = (np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1).tolist()
        found, over = [], []
        for first, end in zip([0, *cuts], [*cuts, batch.num_rows]):
            here = (file[first].as_py(), int(block[first]))
            if here != place:
                if place is not None:
                    over.append((place, came_to))
                place, came_to = here, (0, 0, 0, 0, _NO_DAY, False, -1)
            lines, heads, legs, base, begun, opened, before = came_to
            if seq[first] <= before or (np.diff(seq[first:end]) <= 0).any():
                raise ValueError(f"lines of {here[0]} are not in order")
            k = kind[first:end]
            number = np.arange(lines + 1, lines + 1 + len(k))
            heads = np.cumsum(k == _HEADER) + heads
            legs = np.cumsum(k == _POSTING) + legs
            at = np.maximum.accumulate(np.where(k >= _BREAK, np.arange(len(k)), -1))
            bases = np.where(at >= 0, legs[at], base)
            days = np.where(at >= 0, day[first:end][at], begun)
            opens = (at >= 0) | opened
            found.append((number, heads, legs - bases, days, opens))
            came_to = (int(number[-1]), int(heads[-1]), int(legs[-1]), int(bases[-1]), int(days[-1]), bool(opens[-1]), int(seq[end - 1]))
        number, heads, leg, days, opens = (np.concatenate(c) for c in zip(*found))
        yield pa.RecordBatch.from_arrays(
            [
                file, pa.array(block), batch.column("line").cast(pa.string()), pa.array(kind),
                pa.array(number, pa.int64(), mask=kind == _POSTING), pa.array(heads, pa.int64()), pa.array(leg, pa.int64()),
                pa.array(days, pa.int32(), mask=days == _NO_DAY), pa.array(opens),
            ],
            names=names,
        )
        if over:
            yield ended(over)
    if place is not None:
        yield ended([(place, came_to)])


def _brought(ends: DataFrame) -> DataFrame:
    """What earlier splits bring into each: lines, lines of its file, headers, and what a transaction begun in one has
    come to.  ``ends`` has a row per split."""
    own = {"number": "lines_in", "heads": "heads_in", "leg": "legs_in", "chain": "chain_in"}
    ends = ends.withColumn("chain", F.col("opened").cast("bigint"))
    reached = running_totals(ends, [], ["file", "block"], {f"_{c}": F.col(c) for c in own})
    reached = materialize(reached.withColumns({name: F.col(f"_{c}") - F.col(c) for c, name in own.items()}), "splits")
    begun = reached.where("opened").select(F.col("_chain").alias("chain_in"), F.col("day").alias("open_day"), F.col("legs_in").alias("base"))
    files = reached.groupBy("file").agg(F.min("lines_in").alias("before_file"))
    rows = reached.select("file", "block", *own.values()).join(begun, "chain_in", "left").join(files, "file")
    return materialize(
        rows.select(
            "file", "block", "lines_in", "heads_in", (F.col("lines_in") - F.col("before_file")).alias("of_file_in"),
            "open_day", (F.col("legs_in") - F.col("base")).alias("open_legs"),
        ),
        "split-starts",
    )


def read_journal(lines: DataFrame) -> Ledger:
    """Parse ``lines(file, block, seq, line)``.

    A blank or unindented line ends a transaction; indented comment lines before the
    first posting hold its tags.  ``tindex`` counts headers over all files, in order."""
    line = F.col("line")
    clean = _in_file_order(lines).withColumn("line", if_has(line, "\r", F.regexp_replace("line", "\r$", ""), line))
    kind = (
        F.when(line.rlike(HEADER), _HEADER)
        .when(~F.coalesce(line.rlike(r"^\s+\S"), F.lit(False)), _BREAK)
        .when(line.rlike(r"^\s*;"), _COMMENT)
        .otherwise(_POSTING)
    )
    flagged = evaluated(clean, kind=kind)
    day = F.when(F.col("kind") == _HEADER, F.unix_date(header_date(F.substring(line, 1, 10))))
    flagged = flagged.select("file", "block", "seq", "line", "kind", F.coalesce(day, F.lit(_NO_DAY)).alias("day"))
    # Heads, legs, tags and directives all read the counted lines: counted once.
    stored = materialize(flagged.mapInArrow(_counted, _PLACED), "lines", "zstd")
    starts = _brought(stored.where(F.col("kind") == _SPLIT_END).select("file", "block", "number", "heads", "leg", "day", "opened"))
    begun = lambda here, earlier: F.when(F.col("opened"), F.col(here)).otherwise(F.col(earlier))
    counted = lambda kind: stored.where(F.col("kind") == kind).join(starts, ["file", "block"]).select(
        "file", "line", (F.col("number") + F.col("lines_in")).alias("number"), (F.col("number") + F.col("of_file_in")).alias("source_line"),
        (F.col("heads") + F.col("heads_in")).alias("tindex"),
        (F.col("leg") + F.when(F.col("opened"), 0).otherwise(F.col("open_legs"))).cast("int").alias("leg"),
        F.date_from_unix_date(begun("day", "open_day")).alias("date"),
    )
    inside = lambda kind: counted(kind).where("date is not null")

    part = lambda i: F.regexp_extract("line", HEADER, i)
    split = evaluated(inside(_HEADER), mark=part(3), text=part(5))
    about = if_has(F.col("text"), ";", F.regexp_replace("text", r"\s*;.*$", ""), F.col("text"))
    named = evaluated(split, names=split_description(F.trim(about)))
    heads = named.select(
        "file",
        "source_line",
        "tindex",
        "date",
        "names.payee",
        "names.note",
        state_of_mark(F.col("mark"), "Unmarked").alias("status"),
        parse_tags(F.regexp_extract("text", r";(.*)$", 1)).alias("own_tags"),
    )

    # Tags are part of the transaction row, as few as its tag lines.
    tags = (
        inside(_COMMENT).where("leg = 0")
        .select("tindex", "number", parse_tags(F.regexp_extract("line", r";(.*)$", 1)).alias("t"))
        .groupBy("tindex")
        .agg(F.array_sort(F.collect_list(F.struct("number", "t"))).alias("lines"))
        .select("tindex", F.flatten(F.transform("lines", lambda l: l["t"])).alias("line_tags"))
    )
    transactions = heads.join(tags, "tindex", "left").select(
        "tindex",
        "date",
        "payee",
        "note",
        "status",
        F.coalesce(F.concat("own_tags", F.coalesce("line_tags", F.array())), F.col("own_tags")).alias("tags"),
        F.col("file").alias("source_file"),
        "source_line",
    )

    field = F.col("fields")
    split = evaluated(
        evaluated(inside(_POSTING), fields=posting_fields(line)),
        mark=field["mark"],
        name=F.trim(field["name"]),
        rest=F.trim(if_has(field["rest"], ";", F.regexp_replace(field["rest"], r"\s*;.*$", ""), field["rest"])),
    ).drop("fields")
    rest, name, none = F.col("rest"), F.col("name"), F.lit("")
    texts = evaluated(
        split,
        kind=kind_of(name),
        amount_text=F.trim(F.when(rest.contains("@") | rest.contains("="), F.regexp_extract(rest, r"^([^@=]*)", 1)).otherwise(rest)),
        at=if_has(rest, "@", F.regexp_extract(rest, r"(@@?)", 1), none),
        cost_text=if_has(rest, "@", F.trim(F.regexp_extract(rest, r"@@?\s*([^=]*)", 1)), none),
        asserted_text=if_has(rest, "=", F.trim(F.regexp_extract(rest, r"=+\*?\s*([^@]*)", 1)), none),
    )
    bracketed = F.col("kind") != "real"
    legs = parsed_amounts(texts, a=F.col("amount_text"), c=F.col("cost_text")).select(
        "tindex",
        "leg",
        "date",
        F.when(bracketed, F.substring(name, F.lit(2), F.length(name) - 2)).otherwise(name).alias("account"),
        "kind",
        state_of_mark(F.col("mark"), None).alias("status"),
        "amount_text",
        "at",
        "asserted_text",
        "a",
        "c",
    )
    unit = F.when(
        F.col("at") == "@@", F.try_divide(F.col("c.quantity"), F.abs("a.quantity")).cast(QUANTITY)
    ).otherwise(F.col("c.quantity"))
    legs = legs.select(
        "tindex", "leg", "date", "account", "kind", "status", "amount_text", "asserted_text",
        "a.quantity", "a.commodity", "a.precision",
        unit.alias("cost_quantity"), F.col("c.commodity").alias("cost_commodity"),
    )
    legs = materialize(legs, "legs", "zstd")  # parsed once, read by amounts, sums and assertions
    written = legs.where("quantity is not null")
    blank = materialize(
        legs.where("amount_text = ''").select("tindex", "leg", "date", "account", "kind", "status", "asserted_text"), "blanks"
    )
    # An amount left out is minus the sum of the others of its kind, per commodity, at cost.
    costed = F.col("cost_quantity").isNotNull()
    sums = (
        written.where("kind <> 'virtual'").join(blank, "tindex", "left_semi")
        .groupBy("tindex", F.col("kind").alias("side"), F.when(costed, F.col("cost_commodity")).otherwise(F.col("commodity")).alias("commodity"))
        .agg(
            F.sum(
                F.when(costed, (F.col("quantity").cast(COSTED) * F.col("cost_quantity").cast(PRICE)).cast(TOTAL)).otherwise(
                    F.col("quantity").cast(TOTAL)
                )
            ).alias("sum"),
            F.max("precision").alias("precision"),
        )
        .where("sum <> 0")
    )
    place = Window.partitionBy("tindex", "leg").orderBy("commodity")  # as long as there are commodities
    # A balanced virtual posting that has none of its kind to balance takes up the real ones.
    others = written.where("kind = 'balanced'").join(blank, "tindex", "left_semi").select("tindex").distinct().withColumn("others", F.lit(True))
    sided = (
        blank.where("kind = 'balanced'")
        .join(others, "tindex", "left")
        .withColumn("side", F.when(F.col("others"), F.lit("balanced")).otherwise(F.lit("real")))
        .drop("others")
    ).unionByName(blank.where("kind <> 'balanced'").withColumn("side", F.col("kind")))
    elided = (
        sided.join(sums, ["tindex", "side"], "left")
        .select(
            "tindex", "leg", (F.row_number().over(place) - 1).alias("pos"), "date", "account", "status", "commodity",
            (-F.col("sum")).cast(QUANTITY).alias("quantity"), "precision",
            (F.col("asserted_text") != "").alias("is_assertion"), "kind",
        )
    )
    postings = written.withColumns(
        {"pos": F.lit(0), "is_assertion": F.col("asserted_text") != ""}
    ).drop("amount_text", "asserted_text")
    postings = conform(postings, POSTINGS).unionByName(conform(elided, POSTINGS))

    said = parse_amount(F.col("asserted_text"))
    assertions = legs.where("asserted_text <> ''").withColumn("s", said).select(
        "tindex", "leg", "date", "account", "s.quantity", "s.commodity", "s.precision"
    )
    directives = counted(_BREAK).select("line", F.col("number").alias("seq"))
    return Ledger(
        conform(transactions, TRANSACTIONS),
        postings,
        price_directives(directives),
        conform(assertions, ASSERTIONS),
        account_declarations(directives).select("account").distinct(),
        commodity_declarations(directives).distinct(),
    )
