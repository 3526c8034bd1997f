"""Substring dedup by hashing normalised units of lines and paragraphs.

A text is cut into units at line ends, at punctuation, and after every word whose hash is the least
of some WINDOW words in a row, so that units are short whatever the text; a passage copied into the
middle of another line still starts and ends its inner units at the same places. From every unit a
block runs to the first unit end after ``min_words`` words. Blocks are normalised (words only, lower
case), digested to 128 bits and grouped over all documents; the first by (doc_id, place) is kept.
Blocks that occur elsewhere first are merged into runs along the first text, runs are extended word
by word to both sides, and what they cover in stretches of at least ``min_run`` words is the result.
A passage of ``3 * WINDOW + min_words`` words and more always holds a whole block.

Digests are made twice rather than stored: first to tell which occur more than once, in a table of bits,
then for the blocks that may. Text of one word, or of a few in turn, equals one first block at every place;
words next to that block are stored once and sent to all its places.

Beside the blocks, whole lines are digested, whatever their length: a line that an earlier line equals
goes, and so does a paragraph of such lines. ``min_run`` is for what starts or ends inside a line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, in_table, materialize, mix, signed, slices
from tallyframe.llm.line_dedup import bit_filter, may_hold
from tallyframe.scratch import discard, shuffles_dropped

_BREAK = np.zeros(256, np.int64)
_BREAK[list(b"\n\r.,;:!?|")] = 1
_FEED = np.zeros(256, np.int64)
_FEED[list(b"\n\r")] = 1
#: Words in a row of which one ends a unit.
WINDOW = 12
#: Words that a run is extended by at most to each side; a unit and a block are shorter.
REACH = 64
#: The table of digests that may repeat: bits in all (powers of two), and of each group that makes a part of it.
TABLE_BITS, PART_BITS = 26, 16
#: Digests that a task sorts before it hands them on.
AT_ONCE = 1 << 20
SIDES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
_FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)  # odd, so that powers can be divided by


def content_cuts(words: Words) -> np.ndarray:
    """Which words end a unit by their hash: the least, and last of equal ones, of WINDOW words in a row of one text."""
    cut, n = np.zeros(len(words.start), bool), len(words.start) - WINDOW + 1
    if n > 0:
        views = np.lib.stride_tricks.sliding_window_view(words.hash[::-1], WINDOW)[::-1]
        least = np.arange(n) + WINDOW - 1 - views.argmin(1)
        text = np.searchsorted(words.at, np.arange(len(words.start)), "right")
        cut[least[text[:n] == text[WINDOW - 1 :]]] = True
    return cut


def blocks(column: pa.Array, min_words: int, table: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Blocks and whole lines of some texts: h1 of all, or, of those that ``table`` has, row, h1, h2, whether a
    line, first word and word after, first code point and the one after."""
    words = Words(column, "alnum")
    n = len(words.start)
    if not n:
        return {k: np.zeros(0, np.int64) for k in ("row", "h1", "h2", "whole", "w0", "w1", "c0", "c1")}
    marks = np.concatenate(([0], np.cumsum(_BREAK[words.data])))
    opens = np.ones(n, bool)
    opens[1:] = marks[words.start[1:]] > marks[words.end[:-1]]
    opens[1:] |= content_cuts(words)[:-1]
    opens[words.at[:-1][words.at[:-1] < n]] = True
    starts = np.flatnonzero(opens)
    row = np.searchsorted(words.at, starts, "right") - 1
    limits = np.concatenate((starts[1:], [n]))  # where units end
    ends = limits[np.minimum(np.searchsorted(limits, starts + min_words), len(limits) - 1)]
    good = (ends - starts >= min_words) & (ends <= words.at[row + 1])
    starts, ends, row = starts[good], ends[good], row[good]
    feeds = np.concatenate(([0], np.cumsum(_FEED[words.data])))
    opens = np.ones(n, bool)
    opens[1:] = feeds[words.start[1:]] > feeds[words.end[:-1]]
    opens[words.at[:-1][words.at[:-1] < n]] = True
    lines = np.flatnonzero(opens)
    whole = np.repeat([0, 1], [len(starts), len(lines)])
    starts, ends = np.concatenate((starts, lines)), np.concatenate((ends, lines[1:], [n]))
    row = np.concatenate((row, np.searchsorted(words.at, lines, "right") - 1))

    def digester(factor, h):
        up, down = np.ones(n, np.uint64), np.ones(n + 1, np.uint64)
        up[1:], down[1:] = np.uint64(factor), np.uint64(pow(factor, -1, 1 << 64))
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
        return lambda a, b, more: mix((total[b] - total[a]) * down[a] + (b - a + more).astype(np.uint64))

    h1 = signed(digester(_FACTORS[0], words.hash)(starts, ends, whole << 40))
    if table is None:
        return {"h1": h1}
    some = np.flatnonzero(in_table(table, h1))
    starts, ends, row, whole, h1 = starts[some], ends[some], row[some], whole[some], h1[some]
    h2 = signed(digester(_FACTORS[1], mix(words.hash ^ np.uint64(0x5DEECE66D)))(starts, ends, whole << 40))
    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
    base = points[words.offsets[row]]
    return {
        "row": row, "h1": h1, "h2": h2, "whole": whole, "w0": starts - words.at[row], "w1": ends - words.at[row],
        "c0": points[words.start[starts]] - base, "c1": points[words.end[ends - 1]] - base,
    }


def repeated(docs: DataFrame, min_words: int) -> np.ndarray:
    """A table of bits (see ``in_table``) in which those of all h1 that occur more than once are set.

    Tasks hand on their digests sorted into parts of the table, 32 more bits of each, none more than twice.
    """
    parts = 1 << (TABLE_BITS - PART_BITS)

    def dealt(held):
        h = np.concatenate(held).view(np.uint64)
        low = h & np.uint64((1 << PART_BITS) - 1)
        part = (h >> np.uint64(PART_BITS)) & np.uint64(parts - 1)
        rest = (h >> np.uint64(TABLE_BITS)) & np.uint64((1 << (32 - PART_BITS)) - 1)
        found, n = np.unique(part << np.uint64(32) | rest << np.uint64(PART_BITS) | low, return_counts=True)
        found = np.repeat(found, np.minimum(n, 2))
        at = np.searchsorted(found >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64)).astype("<i4") * 4
        data = pa.BinaryArray.from_buffers(pa.binary(), parts, [None, pa.py_buffer(at), pa.py_buffer(found.astype("<u4"))])
        return pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), data], names=["part", "digests"])

    def deal(batches):
        held = []
        for part in slices(batches, limit=1 << 20):
            held.append(blocks(part.column("text"), min_words)["h1"])
            if sum(map(len, held)) >= AT_ONCE:
                yield dealt(held)
                held = []
        if held:
            yield dealt(held)

    def again(rows: pa.Table) -> pa.Table:
        found = np.sort(np.frombuffer(b"".join(rows.column("digests").to_pylist()), "<u4"))
        bits = np.zeros(1 << PART_BITS, bool)
        bits[found[1:][found[1:] == found[:-1]] & ((1 << PART_BITS) - 1)] = True
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()])})

    with shuffles_dropped(docs.sparkSession):
        found = docs.select("text").mapInArrow(deal, "part int, digests binary").where("length(digests) > 0").groupBy("part").applyInArrow(
            again, "part int, bits binary"
        ).toArrow()
    table = np.zeros((parts, 1 << (PART_BITS - 6)), np.uint64)
    for part, bits in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        table[part] = np.frombuffer(bits, "<u8")
    return table.reshape(-1)


def repeated_spans(docs: DataFrame, min_words: int = 8, min_run: int = 25) -> DataFrame:
    """Spans to remove: doc_id, start, end (code points, end exclusive), n_words, kept_doc_id, kept_start, text_key.

    ``kept_doc_id`` and ``kept_start`` tell where the span's first run occurs first. Occurrences
    rank by doc_id (null last), then a hash of the text, then place; a text that repeats its own
    words loses the later ones. Rows equal in doc_id and text are one occurrence and get the same
    spans. Null and empty texts have no words and no spans. No rows give no rows; other columns are not
    read. ``text_key`` (xxhash64 of the text) finds the rows of a span where doc_id does not.
    """

    table = repeated(docs, min_words)
    ints = ("whole", "w0", "w1", "c0", "c1")

    def cut(batches):
        for part in slices(batches, limit=1 << 20):
            b = blocks(part.column("text"), min_words, table)
            at = pa.array(b["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(b["h1"]), pa.array(b["h2"]), part.column("doc_id").cast(pa.int64()).take(at), part.column("text_key").take(at)]
                + [pa.array(b[k].astype(np.int32)) for k in ints],
                names=["h1", "h2", "doc_id", "text_key", *ints],
            )

    units = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        cut, ", ".join(["h1 long, h2 long, doc_id long, text_key long", *(f"`{k}` int" for k in ints)])
    )
    units = materialize(units, "units")
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "w0", "c0")
    first = units.select("h1", "h2", rank.alias("rank")).groupBy("h1", "h2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = units.join(first, ["h1", "h2"]).where(~rank.eqNullSafe(F.col("first"))).select(
        "doc_id", "text_key", "whole", "w0", "w1", "c0", "c1",
        F.col("first.doc_id").alias("kept"), F.col("first.text_key").alias("kept_key"), F.col("first.w0").alias("kept_w0"), F.col("first.c0").alias("kept_c0"),
    )
    later = materialize(later, "later")  # a place may be there twice, as a row of ``docs`` may
    discard(units)
    lines = later.where("whole = 1").select("doc_id", "text_key", "w0", "w1", "c0", "c1", "kept", "kept_c0")
    runs = merged(later.where("whole = 0").withColumn("ahead", F.col("w0") - F.col("kept_w0")), ["doc_id", "text_key", "kept", "kept_key", "ahead"])
    columns = ["c0", "c1", "kept", "kept_c0"]
    found = merged(extended(docs, materialize(runs, "runs")), ["doc_id", "text_key"], *columns)
    found = found.where(F.col("w1") - F.col("w0") >= min_run)
    found = merged(found.unionByName(lines), ["doc_id", "text_key"], *columns)
    return found.select(
        "doc_id", F.col("c0").cast("long").alias("start"), F.col("c1").cast("long").alias("end"), (F.col("w1") - F.col("w0")).cast("long").alias("n_words"),
        F.col("kept").alias("kept_doc_id"), F.col("kept_c0").cast("long").alias("kept_start"), "text_key",
    )


def merged(spans: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """``spans`` (w0, w1) of the same ``keys`` that overlap or touch as one; c1 grows, other columns are of the first."""
    own = Window.partitionBy(*keys).orderBy("w0", "w1", *more)
    reach = F.max("w1").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", (F.coalesce(reach, F.lit(-1)) < F.col("w0")).cast("int"))
    spans = spans.withColumn("span", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    least = F.min(F.struct("w0", *more))
    out = spans.groupBy(*keys, "span").agg(least.alias("f"), F.max("w1").alias("w1"), *[F.max(c).alias(c) for c in more if c == "c1"])
    return out.select(*keys, "f.w0", "w1", *[F.col(c) if c == "c1" else F.col(f"f.{c}").alias(c) for c in more])


def extended(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with all equal words before and after them: doc_id, text_key, w0, w1, c0, c1, kept, kept_c0.

    Words next to the first occurrences are stored, once for all runs that share one, and sent to the texts of the runs.
    """
    runs = runs.withColumns({"kept_w0": F.col("w0") - F.col("ahead"), "kept_w1": F.col("w1") - F.col("ahead")})
    asked = runs.groupBy("kept", "kept_key").agg(F.collect_set(F.struct(F.col("kept_w0").alias("w0"), F.col("kept_w1").alias("w1"))).alias("asked"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    there = texts.where(may_hold(bit_filter(asked.select(F.col("kept_key").alias("key"))), F.col("text_key")))  # spares other texts the shuffle
    there = there.join(asked, F.col("doc_id").eqNullSafe(F.col("kept")) & (F.col("text_key") == F.col("kept_key"))).select("doc_id", "text_key", "text", "asked")

    def look(batches):
        for part in slices(batches, limit=1 << 20):
            words = Words(part.column("text"), "alnum")
            points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
            rows = []
            for i, (doc, key, places) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "text_key", "asked")))):
                at, end = words.at[i], words.at[i + 1]
                base = points[words.offsets[i]]
                for place in places:
                    w0, w1 = place["w0"], place["w1"]
                    low, high = max(at, at + w0 - REACH), min(end, at + w1 + REACH)
                    # words outwards from the run; first code points up to it
                    rows.append((
                        doc, key, w0, w1, words.hash[low : at + w0][::-1].tobytes(), words.hash[at + w1 : high].tobytes(),
                        (points[words.start[low : at + w0 + 1]] - base)[::-1].tolist(),
                    ))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(x), t) for x, t in zip(zip(*rows) if rows else [[]] * len(SIDES), SIDES)], names=["doc_id", "text_key", "w0", "w1", "before", "after", "starts"]
            )

    sides = materialize(
        there.mapInArrow(look, "doc_id long, text_key long, w0 int, w1 int, before binary, after binary, starts array<int>")
        .dropDuplicates(["doc_id", "text_key", "w0", "w1"]), "sides",
    )
    first = ["kept", "kept_key", "kept_w0", "kept_w1"]
    wanted = runs.groupBy("doc_id", "text_key", *first).agg(F.collect_list("w0").alias("places"))
    r, b = wanted.alias("r"), sides.alias("b")
    met = r.join(b, F.expr("r.kept <=> b.doc_id and r.kept_key = b.text_key and r.kept_w0 = b.w0 and r.kept_w1 = b.w1")).selectExpr(
        "r.doc_id", "r.text_key", "cast(null as string) as text", "r.places", "r.kept_w1 - r.kept_w0 as n", "r.kept", "b.before", "b.after", "b.starts",
    )
    here = texts.where(may_hold(bit_filter(runs.select(F.col("text_key").alias("key")).distinct()), F.col("text_key")))
    # a text, then its runs
    both = here.unionByName(met, allowMissingColumns=True).repartition("doc_id", "text_key").sortWithinPartitions("doc_id", "text_key", F.col("text").isNull())

    def common(p: np.ndarray, q: np.ndarray) -> int:
        m = min(len(p), len(q))
        differ = np.flatnonzero(p[:m] != q[:m])
        return int(differ[0]) if len(differ) else m

    def grow(batches):
        words = points = None
        for batch in slices(batches, limit=1 << 20):
            rows = []
            for x in batch.to_pylist():
                if x["text"] is not None:
                    words = Words(pa.array([x["text"]], pa.large_string()), "alnum")
                    points = np.concatenate(([0], np.cumsum((words.data & 0xC0) != 0x80)))
                    continue
                before, after = np.frombuffer(x["before"], np.uint64), np.frombuffer(x["after"], np.uint64)
                for w0 in x["places"]:
                    w1 = w0 + x["n"]
                    left = common(words.hash[max(0, w0 - REACH) : w0][::-1], before)
                    right = common(words.hash[w1 : w1 + REACH], after)
                    rows.append((
                        x["doc_id"], x["text_key"], w0 - left, w1 + right, points[words.start[w0 - left]], points[words.end[w1 + right - 1]], x["kept"], x["starts"][left],
                    ))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(columns, types)], names=["doc_id", "text_key", "w0", "w1", "c0", "c1", "kept", "kept_c0"])

    found = materialize(both.mapInArrow(grow, "doc_id long, text_key long, w0 int, w1 int, c0 int, c1 int, kept long, kept_c0 int"), "extended")
    discard(sides)
    return found


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the ``spans`` cut out of ``text`` and listed in ``removed`` (start, end of the old text)."""
    lists = spans.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("removed"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed")
    joined = docs.drop("removed").join(lists, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda s: s["end"]))
    stops = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length("text").cast("long")))
    kept = F.array_join(
        F.transform(F.arrays_zip(edges.alias("a"), stops.alias("b")), lambda z: F.col("text").substr(z["a"].cast("int") + 1, (z["b"] - z["a"]).cast("int"))), ""
    )
    return joined.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)).drop("_id", "_key")
