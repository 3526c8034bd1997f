"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words. Words are ordered by rarity: a fixed table counts the corpus' words
by hash bucket, and one 64-bit number per word carries its bucket's rank and the rest of its hash, so
that sorting numbers sorts by rarity and equal numbers are equal words. Two lines of Jaccard
similarity ``percent`` and more share one of their first few words in this order (prefix filter), at
places and with lengths that leave room for the overlap (positional and length filters), and differ
in few bits of two parity words. Up to the smaller of their last prefix words both prefixes are whole, so
what they share there bounds the overlap as well. What passes is verified on the full sets.

Lines of equal sets are one class, named by its first line. To decide that a line goes, one earlier
match is enough: first each class is compared with the earliest classes of its words, as far as sets of one
size may first meet there. A match with the earliest class of one of its three rarest words settles it; else
it is joined in full, but with classes before its best match only. So groups of near copies do not meet
pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.scratch import discard, materialize

#: Earliest classes of a word that its other classes are compared with first.
LEADERS = 8
RARITY_BITS = 18
FILTER_BITS = 22
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t\x0B\f\r]+"


def dense(numbers: DataFrame, size: int) -> Column:
    """``numbers`` (cell, value) as one array of ``size`` values, 0 where a cell is absent."""
    cells = numbers.sparkSession.range(size).join(numbers, F.col("id") == F.col("cell"), "left")
    one = cells.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("value", F.lit(0)).alias("value")))).alias("all"))
    return one.select(F.transform("all", lambda x: x["value"])).scalar()


def lowered(text: Column) -> Column:
    """A-Z in lower case. ``lower`` does the same, much faster, to texts without other capitals."""
    plain = F.length(text) == F.octet_length(text)
    other = F.rlike(text, F.lit(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"))
    return F.when(plain, F.lower(text)).when(other, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(line: Column) -> Column:
    """Words of a line; where blanks are its only white space they are cut one by one, and some words may be empty."""
    odd = F.rlike(line, F.lit(r"[\t\x0B\f\r]"))
    return F.when(odd, F.split(F.btrim(lowered(line), F.lit(" \t\x0b\f\r")), _SPACE)).otherwise(F.split(lowered(line), " "))


def rarity(docs: DataFrame) -> Column:
    """Rank of each hash bucket by its number of words in all texts, as an array column of numbers' high bits."""
    words = docs.select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).select(F.explode(words_of(F.col("text"))).alias("w"))
    size = 1 << RARITY_BITS
    counts = words.where("w <> ''").select(F.xxhash64("w").bitwiseAND(size - 1).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(size).join(counts, F.col("id") == F.col("bucket"), "left")
    ranks = every.select(F.col("id").alias("cell"), F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "id")).alias("value"))
    high = F.shiftleft((F.col("value") - 1 - size // 2).cast("long"), 64 - RARITY_BITS)
    return dense(materialize(ranks.select("cell", high.alias("value")), "rarity"), size)


def bit_filter(keys: DataFrame) -> Column:
    """An array column of 2**FILTER_BITS bits in which those of all ``keys`` (key: long) are set."""
    cells = keys.select(
        F.shiftrightunsigned(F.col("key").bitwiseAND((1 << FILTER_BITS) - 1), 6).alias("cell"),
        F.expr("shiftleft(1L, cast(key & 63 as int))").alias("value"),
    ).groupBy("cell").agg(F.bit_or("value").alias("value"))
    return dense(materialize(cells, "bits"), 1 << (FILTER_BITS - 6))


def may_hold(bits: Column, key: Column) -> Column:
    cell = F.get(bits, F.shiftrightunsigned(key.bitwiseAND((1 << FILTER_BITS) - 1), 6).cast("int"))
    return F.call_function("getbit", cell, key.bitwiseAND(63).cast("int")) == 1


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line (from 0) and its text; null text has none."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line", "words"))


def ordered_sets(lines: DataFrame, ranks: Column, min_words: int) -> DataFrame:
    """``lines`` with ``items``: the line's distinct words as numbers, rarest first."""
    low = (1 << RARITY_BITS) - 1
    hashes = F.transform(words_of(F.col("words")), lambda w: F.xxhash64(w))
    hashes = F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))
    number = lambda h: F.get("ranks", h.bitwiseAND(low).cast("int")).bitwiseOR(F.shiftrightunsigned(h, RARITY_BITS))
    # behind a generator, so that the length filter does not build the words twice
    long_enough = F.explode(F.filter(F.array(hashes), lambda h: F.size(h) >= min_words))
    found = lines.select("doc_id", "text_key", "line", long_enough.alias("hashes"))
    found = found.withColumn("ranks", ranks)  # the optimizer puts the subquery's value where the column is used
    return found.select("doc_id", "text_key", "line", F.sort_array(F.transform("hashes", number)).alias("items"))


def prefix_rows(classes: DataFrame) -> DataFrame:
    """One row per class and prefix word: key (the word), at (its place), set, n, even, odd and the other columns."""
    return classes.select(*[c for c in classes.columns if c != "keys"], F.posexplode("keys").alias("at", "key"))


def fits(percent: int) -> str:
    """SQL: classes a and b may reach the threshold if this is the first word they share."""
    need = f"{percent}L * (a.n + b.n)"
    return (
        f"a.key = b.key and a.set <> b.set and least(a.n, b.n) * 100L >= {percent}L * greatest(a.n, b.n) "
        f"and least(a.n - a.at, b.n - b.at) * {100 + percent}L >= {need} "
        f"and (bit_count(a.even ^ b.even) + bit_count(a.odd ^ b.odd)) * {100 + percent}L <= {100 - percent}L * (a.n + b.n)"
    )


def room(percent: int) -> str:
    """SQL: what the prefixes of a and b share leaves them within reach of the threshold."""
    known = lambda x: f"size(filter({x}_keys, k -> k <= least(element_at(a_keys, -1), element_at(b_keys, -1))))"
    most = f"size(array_intersect(a_keys, b_keys)) + least(a_n - {known('a')}, b_n - {known('b')})"
    return f"({most}) * {100 + percent}L >= {percent}L * (a_n + b_n)"


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, ranks: Column, percent: int, min_words: int) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b: sets, settles) that reach the threshold and whose line a is the earlier one.

    a, b, settles, a_first, similarity.
    """
    bits = bit_filter(pairs.select(F.explode(F.array("a", "b")).alias("key")))
    ends = classes.where(may_hold(bits, F.col("set"))).select("set", "first", "n", "keys")
    ends = materialize(ends, "line-ends")
    both = pairs.join(ends.toDF("a", "a_first", "a_n", "a_keys"), "a").join(ends.toDF("b", "b_first", "b_n", "b_keys"), "b")
    both = both.where(f"a_first < b_first and {room(percent)}").select("a", "b", "settles", "a_first", "b_first")
    both = materialize(both, "line-pairs")
    discard(ends)
    places = both.select(F.col("a_first").alias("f")).union(both.select(F.col("b_first").alias("f"))).select("f.*")
    keys = F.explode(F.array("text_key", line_key(F.col("doc_id"), F.col("text_key"), F.col("line")))).alias("key")
    bits = bit_filter(places.select(keys).distinct())
    # the words of candidate lines only are built again; the filter just spares the other texts and lines
    some = lines_of(docs.where(may_hold(bits, F.xxhash64("text"))))
    some = some.where(may_hold(bits, line_key(F.col("doc_id"), F.col("text_key"), F.col("line"))))
    items = ordered_sets(some, ranks, min_words).select(F.xxhash64("items").alias("set"), "items")
    items = materialize(items.groupBy("set").agg(F.first("items").alias("items")), "line-words")
    met = both.join(items.toDF("a", "a_items"), "a").join(items.toDF("b", "b_items"), "b")
    common = F.size(F.array_intersect("a_items", "b_items"))
    met = met.select("a", "b", "settles", "a_first", common.alias("common"), (F.size("a_items") + F.size("b_items") - common).alias("all"))
    met = met.where(f"common * 100L >= {percent}L * all")
    met = materialize(met.select("a", "b", "settles", "a_first", (F.col("common") / F.col("all")).alias("similarity")), "line-matches")
    discard(both)
    discard(items)
    return met


def line_key(doc_id: Column, text_key: Column, line: Column) -> Column:
    return F.xxhash64(doc_id, text_key, line)


def duplicate_lines(docs: DataFrame, percent: int = 80, min_words: int = 5) -> DataFrame:
    """Lines to remove: doc_id, line, kept_doc_id, kept_line, similarity, text_key.

    A line (text between line feeds, numbered from 0) goes if an earlier one - by doc_id (null last),
    then a hash of the text, then line - has a word set with 100 * common >= ``percent`` * union. One
    such earlier line is named: the first of those with an equal set if there is one. Lines of fewer
    than ``min_words`` distinct words (1: none but blank lines), and null or empty texts, are left alone. Rows equal in doc_id
    and text are one document. No rows give no rows; other columns are not read. Words are 64-bit
    hashes: two different words share one with odds of (number of words)**2 / 2**65. ``text_key``
    (xxhash64 of the text) tells rows of one doc_id apart.
    """
    docs = docs.select("doc_id", "text")
    ranks = rarity(docs)
    sets = ordered_sets(lines_of(docs), ranks, min_words)
    kept = F.floor((F.lit(percent) * F.size("items") + 99) / 100)
    # which of 128 buckets hold an odd number of the set's words; a bucket is even or odd by the bit above the lowest six
    parity = lambda side: F.aggregate("items", F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(
        F.call_function("shiftleft", F.shiftright(x, 6).bitwiseAND(1).bitwiseXOR(1 - side), x.bitwiseAND(63).cast("int"))
    ))
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key", "line")
    sets = materialize(
        sets.select(
            place.alias("place"), F.xxhash64("items").alias("set"), F.size("items").alias("n"), parity(0).alias("even"), parity(1).alias("odd"),
            F.slice("items", F.lit(1), (F.size("items") - kept + 1).cast("int")).alias("keys"),
        ), "line-sets",
    )
    classes = materialize(
        sets.groupBy("set").agg(F.min("place").alias("first"), *[F.first(c).alias(c) for c in ("n", "even", "odd", "keys")]),
        "line-classes",
    )
    places = materialize(sets.select("place", "set"), "line-places")
    discard(sets)
    # each class against the earliest ones of its words at places where a set of its size may meet it first
    few = prefix_rows(classes.select("set", "first", "n", "even", "odd", "keys").where(
        "first is not null and set is not null and n is not null and even is not null and odd is not null"  # none is; so both sides are one shuffle
    )).where(f"at < 3 or at * {100 + percent} <= {100 - percent} * n").withColumn("rare", F.expr("cast(at < 3 as int)"))
    order = Window.partitionBy("key").orderBy("first")
    rarest = F.sum("rare").over(order.rowsBetween(Window.unboundedPreceding, 0))
    lead = few.withColumns({"turn": F.row_number().over(order), "leads": (F.col("rare") == 1) & (rarest == 1)})
    lead = lead.where((F.col("turn") <= LEADERS) | F.col("leads"))
    pairs = lead.alias("a").join(few.alias("b"), F.expr(f"a.first < b.first and {fits(percent)}"))
    pairs = pairs.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.expr("cast(a.leads and b.rare = 1 as int)").alias("settles"))
    pairs = materialize(pairs.groupBy("a", "b").agg(F.max("settles").alias("settles")), "line-leaders")
    best = verified(pairs, classes, docs, ranks, percent, min_words).groupBy("b").agg(
        F.min(F.struct((1 - F.col("settles")).alias("open"), "a_first", "similarity")).alias("m")
    )
    best = materialize(best.select("b", "m.*"), "line-best")
    discard(pairs)
    # what is not settled against all before its best match (upto <= doc); both sides read the same columns, so one shuffle serves them
    last = F.lit((1 << 63) - 1)  # null doc_ids come last
    doc = F.coalesce(F.col("first.doc_id"), last)
    upto = F.when(F.col("open") == 0, F.lit(-1 << 63)).when(F.col("open") == 1, F.coalesce(F.col("a_first.doc_id"), last)).otherwise(doc)
    met = may_hold(bit_filter(best.select(F.col("b").alias("key"))), F.col("set"))  # the others are spared the join
    columns = ["set", "first", "n", "even", "odd", "keys"]
    rows = classes.where(met).select(columns).join(best.withColumnRenamed("b", "set"), "set", "left").select(
        *columns, F.coalesce(upto, doc).alias("upto")
    ).union(classes.where(~met).select(*columns, doc.alias("upto")))
    rows = prefix_rows(rows.select("set", "n", "even", "odd", doc.alias("doc"), "upto", "keys"))
    pairs = rows.alias("a").join(rows.alias("b"), F.expr(f"greatest(a.doc, a.upto) <= least(b.doc, b.upto) and {fits(percent)}"))
    pairs = pairs.select(F.col("a.set").alias("a"), F.col("b.set").alias("b"), F.lit(0).alias("settles")).distinct()
    pairs = materialize(pairs, "line-candidates")  # its shuffles go before the next ones begin
    found = verified(pairs, classes, docs, ranks, percent, min_words).select("b", "a_first", "similarity")
    found = best.select("b", "a_first", "similarity").union(found)
    found = found.groupBy("b").agg(F.min(F.struct("a_first", "similarity")).alias("m"))
    lines = places.join(classes.select("set", "first").join(found, classes["set"] == found["b"], "left"), "set")
    again = F.col("place") != F.col("first")
    return lines.where(again | F.col("m").isNotNull()).select(
        "place.doc_id", F.col("place.line").alias("line"),
        F.when(again, F.col("first.doc_id")).otherwise(F.col("m.a_first.doc_id")).alias("kept_doc_id"),
        F.when(again, F.col("first.line")).otherwise(F.col("m.a_first.line")).alias("kept_line"),
        F.when(again, F.lit(1.0)).otherwise(F.col("m.similarity")).alias("similarity"), "place.text_key",
    ).distinct()


def without_duplicate_lines(docs: DataFrame, percent: int = 80, min_words: int = 5) -> DataFrame:
    """``docs`` with duplicate lines cut out of ``text`` and ``n_chars`` (if there is one) counted anew.

    Every row stays; a document of which nothing is left has an empty text.
    """
    gone = duplicate_lines(docs, percent, min_words).groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        F.collect_set("line").alias("_gone")
    )
    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(docs.columns)
