"""Phrases whose words belong together: best-first branch-and-bound growth from rare first words.

The score of a phrase is the least, over its cuts into two parts with counts l and r, of floor(1000 * a * n
/ (l * r)). As the phrase is no more frequent than either part, a cut after the first word bounds it by
floor(1000 * n / f(first word)), whatever follows: the count of a prefix bounds all that grows from it, and
no longer prefix bounds it better. The same holds for the last word. So the frontier of a language is its
words by bound, best first. It is opened in bands, down to a bound T: all phrases that start or end with an
open word are counted in one pass (which counts every prefix and suffix of those that do both), and what
stays closed scores less than T. Once the ``top``-th surviving score of a language reaches its T, ties
included, the language is settled; if there are enough scores but T is higher, T falls to the ``top``-th
score and the next band settles it; else the next band is wider, and the last opens all words.

What cannot be frequent is not counted: all words of a phrase, and all neighbouring pairs, are frequent
themselves. Both are looked up in bit tables of fixed size, which may let too much pass, never too little.
Occurrences are added up in every task by 64-bit hashes of their words (see ``common`` for the odds), then
over all tasks by the words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, bit_table, in_table, materialize, mix, rolling, signed, slices, small_batches
from tallyframe.scratch import discard

LONGEST = 5
#: Share of a language's words that each band opens at most; one more opens the rest.
SHARES = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
#: Bytes of text whose occurrences are added up at a time.
SLICE = 4 << 20
_ENDS = np.zeros(256, np.int64)
_ENDS[list(b".,;:!?\n\r\x0b\x0c")] = 1


class Pieces:
    """Words of a batch: ``key`` (hash of word and language), ``piece`` (same within a piece), ``lang`` (code of each word)."""

    def __init__(self, part: pa.RecordBatch):
        self.words = words = Words(part.column("text"), "phrase")
        self.langs, codes = np.unique(["und" if v is None else v for v in part.column("lang").to_pylist()], return_inverse=True)
        row = np.repeat(np.arange(len(words)), np.diff(words.at))
        self.lang = codes[row]
        salts = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in self.langs], np.uint64)
        self.salt = salts[self.lang] if len(row) else np.zeros(0, np.uint64)
        self.key = mix(words.hash ^ self.salt)
        marks = np.concatenate(([0], np.cumsum(_ENDS[words.data])))
        self.piece = marks[words.start] + row

    def grams(self, k: int) -> np.ndarray:
        """A hash of every k words in a row and their language."""
        return mix(rolling(self.words.hash, k) ^ self.salt[: max(0, len(self.salt) - k + 1)] ^ np.uint64(k))

    def together(self, k: int) -> np.ndarray:
        """Whether the k words from each place on stand in one piece."""
        return self.piece[: max(0, len(self.piece) - k + 1)] == self.piece[k - 1 :]

    def phrases(self, places: np.ndarray, k: int) -> list[bytes]:
        low = self.words.data.copy()
        low[(low >= 65) & (low <= 90)] += 32
        text = low.tobytes()
        return [b" ".join(text[a:b].split()) for a, b in zip(self.words.start[places].tolist(), self.words.end[places + k - 1].tolist())]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys together, and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase (a word, or null for all words of a language), h, a: partial counts."""

    def count(batches):
        for part in slices(batches, limit=SLICE):
            p = Pieces(part)
            order, at = _distinct(p.key)
            first = order[at]
            n = np.diff(np.append(at, len(order)))
            totals = np.bincount(p.lang, minlength=len(p.langs))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((p.langs[p.lang[first]], p.langs)).tolist(), pa.string()),
                 pa.array(p.phrases(first, 1) + [None] * len(totals), pa.binary()).cast(pa.string()),
                 pa.array(np.concatenate((signed(p.key[first]), np.zeros(len(totals), np.int64)))), pa.array(np.concatenate((n, totals)))],
                names=["lang", "phrase", "h", "a"],
            )

    found = docs.select("lang", "text").mapInArrow(count, "lang string, phrase string, h long, a long")
    return found.groupBy("lang", "phrase", "h").agg(F.sum("a").alias("a"))


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """h, a of every pair of neighbouring frequent words."""

    def count(batches):
        for part in slices(batches, limit=SLICE):
            p = Pieces(part)
            known = in_table(frequent, p.key)
            grams = p.grams(2)[known[:-1] & known[1:] & p.together(2)]
            order, at = _distinct(grams)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(grams[order[at]])), pa.array(np.diff(np.append(at, len(order))))], names=["h", "a"]
            )

    return docs.select("lang", "text").mapInArrow(count, "h long, a long").groupBy("h").agg(F.sum("a").alias("a"))


def grown(docs: DataFrame, pairs: np.ndarray, bands: list[np.ndarray], min_count: int) -> DataFrame:
    """Phrases that start or end with a word of the last of ``bands``, and neither with one of an earlier band.

    lang, phrase, size, a, and whether one word stands before (after) every occurrence: ``led``, ``followed``.
    """

    def count(batches):
        for part in slices(batches, limit=SLICE):
            p = Pieces(part)
            hash_, n = p.words.hash, len(p.key)
            paired = in_table(pairs, p.grams(2)) & p.together(2)
            now, before = in_table(bands[-1], p.key), np.zeros(n, bool)
            for band in bands[:-1]:
                before |= in_table(band, p.key)
            langs, phrases, sizes, counts, sides = [], [], [], [], [[], [], [], []]
            good = np.ones(max(0, n - 1), bool)
            for k in range(2, LONGEST + 1):
                m = n - k + 1
                if m <= 0:
                    break
                good = good[:m] & paired[k - 2 :]
                places = np.flatnonzero(good & (now[:m] | now[k - 1 :]) & ~(before[:m] | before[k - 1 :]))
                if not len(places):
                    continue
                # neighbours within the piece; 0 is none
                left, right = np.zeros(len(places), np.uint64), np.zeros(len(places), np.uint64)
                inner = (places > 0) & (p.piece[places] == p.piece[np.maximum(places - 1, 0)])
                left[inner] = hash_[places[inner] - 1] | np.uint64(1)
                inner = (places + k < n) & (p.piece[places] == p.piece[np.minimum(places + k, n - 1)])
                right[inner] = hash_[places[inner] + k] | np.uint64(1)
                order, at = _distinct(p.grams(k)[places])
                first = places[order[at]]
                langs += p.langs[p.lang[first]].tolist()
                phrases += p.phrases(first, k)
                sizes.append(np.full(len(at), k, np.int32))
                counts.append(np.diff(np.append(at, len(order))))
                for column, (values, reduce) in zip(sides, [(left, np.minimum), (left, np.maximum), (right, np.minimum), (right, np.maximum)]):
                    column.append(signed(reduce.reduceat(values[order], at)))
            if phrases:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(np.concatenate(sizes)),
                     pa.array(np.concatenate(counts))] + [pa.array(np.concatenate(c)) for c in sides],
                    names=["lang", "phrase", "size", "a", "l0", "l1", "r0", "r1"],
                )

    found = docs.select("lang", "text").mapInArrow(
        count, "lang string, phrase string, size int, a long, l0 long, l1 long, r0 long, r1 long"
    )
    # partial least and greatest neighbours stay equal only if all are; signed order is as good as any
    sides = [F.least(F.min("l0"), F.min("l1")), F.greatest(F.max("l0"), F.max("l1")), F.least(F.min("r0"), F.min("r1")), F.greatest(F.max("r0"), F.max("r1"))]
    found = found.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a"), *[s.alias(f"s{i}") for i, s in enumerate(sides)])
    same = [(F.col(f"s{i}") == F.col(f"s{i + 1}")) & (F.col(f"s{i}") != 0) for i in (0, 2)]
    return found.where(F.col("a") >= min_count).select("lang", "phrase", "size", "a", same[0].alias("led"), same[1].alias("followed"))


def scored(phrases: DataFrame, words: DataFrame, totals: DataFrame) -> DataFrame:
    """Surviving phrases all of whose parts have been counted: lang, phrase, a, l, r, n, score of the lowest cut."""
    counts = words.select("lang", "phrase", "a").unionByName(phrases.select("lang", "phrase", "a"))
    split = F.split("phrase", " ")
    cuts = phrases.where(~((F.col("led") | F.col("followed")) & (F.col("size") < LONGEST))).select(
        "lang", "phrase", "a", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    ).withColumn("left", F.array_join(F.slice(split, F.lit(1), F.col("k")), " ")).withColumn(
        "right", F.array_join(F.slice(split, F.col("k") + 1, F.col("size") - F.col("k")), " ")
    )
    for side in ("left", "right"):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(side[0])), ["lang", side])
    wide = "decimal(38,0)"
    cuts = cuts.join(totals, "lang").withColumn(
        "score", F.expr(f"(cast(1000 as {wide}) * cast(a as {wide}) * cast(n as {wide})) div (cast(l as {wide}) * cast(r as {wide}))")
    )
    lowest = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"), F.count("*").alias("cuts"))
    return lowest.where("cuts = size - 1").select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")


def best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank, ranked in buckets first so that no language is sorted by one task."""
    buckets = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = found.withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(buckets)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    return found.drop("bucket").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def bounds(words: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, n, and the bounds down to which the bands of SHARES open words: t0, t1 and so on."""
    steps = words.groupBy("lang", F.floor(F.log2(F.col("a").cast("double")) * 2).alias("step")).agg(F.sum("a").alias("mass"), F.max("a").alias("most"))
    upto = F.sum("mass").over(Window.partitionBy("lang").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    steps = steps.withColumn("upto", upto).join(totals, "lang")
    first = F.min("most")
    tops = [F.coalesce(F.max(F.when(F.col("upto") <= F.col("n") * share, F.col("most"))), first) for share in SHARES]
    return steps.groupBy("lang", "n").agg(*[t.alias(f"m{i}") for i, t in enumerate(tops)]).select(
        "lang", "n", *[F.expr(f"(1000 * n) div m{i}").alias(f"t{i}") for i in range(len(SHARES))]
    )


def mine(docs: DataFrame, min_count: int = 100, top: int = 2_000) -> DataFrame:
    """The ``top`` phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    A-Z is lower-cased; texts are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
    ``[^\\x20\\x09]+``. ``n`` counts the words of a language, ``a`` the occurrences of a phrase of 2 to 5
    words within pieces, overlaps included. Phrases with ``min_count`` occurrences are candidates; those
    that every time stand in one longer candidate are dropped. Ties of score go by ``a``, descending, then
    by the bytes of the phrase. Null texts are empty, null languages ``und``; repeated rows count one by
    one; other columns are not read; no rows give no rows.
    """
    spark = docs.sparkSession
    counted = materialize(word_counts(docs).where(F.col("phrase").isNull() | (F.col("a") >= min_count)), "words")
    totals = counted.where("phrase is null and a > 0").select("lang", F.col("a").alias("n"))
    words = counted.where("phrase is not null")
    state = materialize(bounds(words, totals).withColumn("t", F.col("t0")), "bounds")
    with small_batches(spark):
        pairs = bit_table(pair_counts(docs, bit_table(words, "h")).where(F.col("a") >= min_count), "h")
    bands, phrases, found = [], None, None
    for turn in range(len(SHARES) + 1):
        bound = F.expr("(1000 * n) div a")
        opened = words.join(state.select("lang", "n", "t"), "lang").where(bound >= F.col("t"))
        bands.append(bit_table(opened, "h"))
        more = materialize(grown(docs, pairs, bands, min_count), "phrases")
        phrases = more if phrases is None else phrases.unionByName(more)
        found = materialize(best(scored(phrases, words, totals), top), "best")
        last = found.where(F.col("rank") == top).select("lang", F.col("score").alias("kth"))
        wider = F.col(f"t{turn + 1}") if turn + 1 < len(SHARES) else F.lit(0)
        reached = F.coalesce(F.col("kth") >= F.col("t"), F.col("t") <= 0)
        state = materialize(
            state.join(last, "lang", "left").withColumn("settled", reached)
            .withColumn("t", F.when(reached, F.col("t")).otherwise(F.least(F.col("t"), F.coalesce("kth", wider)))).drop("kth"), "bounds",
        )
        if not state.where("not settled").limit(1).count():
            break
        state = state.drop("settled")
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
