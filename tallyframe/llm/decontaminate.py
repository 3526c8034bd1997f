"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Every test item's n-grams are counted over the corpus; those that are not common by the measure of
their own item are its seeds, so that copies, however many, do not rule each other out.
Texts are searched for seeds, the words around them are cut out as windows, seeds join windows to
items, and each (window, item) is aligned. Copies with words changed, put in or left out keep most
of their alignment score; a chance n-gram does not.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import Words, bit_table, in_table, materialize, rolling, signed, slices

MATCH, MISMATCH, GAP = 2, -1, -1
#: An n-gram is a seed unless it occurs more than this many times as often as its item's median n-gram.
COMMON = 8
#: Words of an item, less what their edits cost, that are a match whatever share of the item they are.
RUN_WORDS = 30


def align(text: np.ndarray, item: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the last word of ``text`` in it."""
    n = len(text)
    slope = np.arange(n + 1) * -GAP
    row = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = row[:-1] + np.where(text == w, MATCH, MISMATCH)
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], diagonal)
        new = np.maximum.accumulate(new + slope) - slope  # gaps within the text
        row = new
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top - 1
    return best, end


def item_table(benchmark: DataFrame, n: int) -> DataFrame:
    """Word sequences of the test items of ``n`` words and more: item_id, size, words (packed hashes), item (their id)."""

    def work(batches):
        for part in slices(batches):
            words = Words(part.column("text"), "alnum")
            size = np.diff(words.at)
            yield pa.RecordBatch.from_arrays(
                [part.column("item_id").cast(pa.int64()), pa.array(size, pa.int64()),
                 pa.array([words.hash[a:b].tobytes() for a, b in zip(words.at[:-1], words.at[1:])], pa.binary())],
                names=["item_id", "size", "words"],
            )

    found = benchmark.select("item_id", "text").mapInArrow(work, "item_id long, size long, words binary")
    return materialize(found.where(F.col("size") >= n).withColumn("item", F.xxhash64("words")), "items")


def seeds_of(items: DataFrame, n: int) -> DataFrame:
    """seed, item: every distinct n-gram of every item."""

    def work(batches):
        for batch in batches:
            grams, owner = [], []
            for item, raw in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                own = np.unique(rolling(np.frombuffer(raw, np.uint64), n))
                grams.append(signed(own))
                owner.append(np.full(len(own), item, np.int64))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(owner))], names=["seed", "item"])

    return items.select("item", "words").distinct().mapInArrow(work, "seed long, item long")


def contaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.5, min_words: int = 8
) -> DataFrame:
    """Matches of test items in ``docs``: doc_id, item_id, score (0 to 1), first_word, last_word, text_key.

    Words are runs of a-z, 0-9 and anything beyond ASCII in lower case. ``score`` is the alignment
    score over that of the whole item; matches of ``threshold`` and more are returned, the best of each
    document and item, ties at the earliest place. So are matches that score as ``RUN_WORDS`` equal
    words do, whatever share of a long item that is. Items of fewer than ``min_words`` words match only
    where they stand word by word (score 1); those of fewer than ``n`` words have no n-gram, identify no
    passage and are not searched for. Null and empty texts match nothing. Equal items are each
    reported. Rows equal in doc_id and text are one document; a null doc_id stays null, and
    ``text_key`` (xxhash64 of the text) tells its rows apart. Other columns are not read.
    """
    items = item_table(benchmark, n)
    seeds = materialize(seeds_of(items, n), "all-seeds")
    widest = items.agg(F.max("size")).first()[0] or 0
    table = bit_table(seeds, "seed")

    def count(batches):
        met: Counter = Counter()
        for part in slices(batches):
            grams = rolling(Words(part.column("text"), "alnum").hash, n)
            found, times = np.unique(grams[in_table(table, grams)], return_counts=True)
            met.update(dict(zip(signed(found).tolist(), times.tolist())))
            if len(met) > 500_000:
                yield counted(met)
                met = Counter()
        yield counted(met)

    def counted(met):
        return pa.RecordBatch.from_arrays([pa.array(list(met), pa.int64()), pa.array(list(met.values()), pa.int64())], names=["seed", "times"])

    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    times = texts.select("text").mapInArrow(count, "seed long, times long").groupBy("seed").agg(F.sum("times").alias("times"))
    counted_seeds = seeds.join(times, "seed")
    usual = counted_seeds.groupBy("item").agg(F.median("times").alias("usual"))
    rare = counted_seeds.join(usual, "item").where(F.col("times") <= COMMON * F.col("usual"))
    rare = materialize(rare.select("seed", "item"), "seeds")
    narrow = bit_table(rare, "seed")

    def search(batches):
        task, number = TaskContext.get().partitionId(), 0
        for part in slices(batches):
            words = Words(part.column("text"), "alnum")
            grams = rolling(words.hash, n)
            hits = np.flatnonzero(in_table(narrow, grams))
            row = np.searchsorted(words.at, hits, "right") - 1
            inside = hits + n <= words.at[row + 1]
            hits, row = hits[inside], row[inside]
            if not len(hits):
                continue
            cuts = np.flatnonzero((np.diff(row) > 0) | (np.diff(hits) > 2 * widest)) + 1
            out = [[], [], [], [], []]
            for group, r in zip(np.split(hits, cuts), row[np.concatenate(([0], cuts))].tolist()):
                a, b = int(words.at[r]), int(words.at[r + 1])
                first, last = max(a, int(group[0]) - widest), min(b, int(group[-1]) + n + widest)
                for column, value in zip(out, (r, task << 33 | number, first - a, words.hash[first:last].tobytes(), np.unique(signed(grams[group])).tolist())):
                    column.append(value)
                number += 1
            at = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()).take(at), part.column("text_key").take(at), pa.array(out[1], pa.int64()),
                 pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "window", "at", "around", "met"],
            )

    windows = materialize(
        texts.mapInArrow(search, "doc_id long, text_key long, window long, at long, around binary, met array<long>"), "windows"
    )
    pairs = windows.select("window", F.explode("met").alias("seed")).join(rare, "seed").select("window", "item").distinct()
    todo = pairs.join(windows.drop("met"), "window").join(items.select("item", "words", "size").distinct(), "item")

    def score(batches):
        for batch in batches:
            out = {k: [] for k in ("doc_id", "text_key", "item", "score", "first_word", "last_word")}
            for doc, key, item, at, around, words, size in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "item", "at", "around", "words", "size"))):
                text, own = np.frombuffer(around, np.uint64), np.frombuffer(words, np.uint64)
                best, end = align(text, own)
                if best < MATCH * (size if size < min_words else min(threshold * size, RUN_WORDS)):
                    continue
                _, back = align(text[: end + 1][::-1], own[::-1])
                for column, value in zip(out.values(), (doc, key, item, best / (MATCH * size), at + end - back, at + end)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.float64() if k == "score" else pa.int64()) for k, v in out.items()], names=list(out))

    found = todo.select("doc_id", "text_key", "item", "at", "around", "words", "size").mapInArrow(
        score, "doc_id long, text_key long, item long, score double, first_word long, last_word long"
    )
    best = found.groupBy("doc_id", "text_key", "item").agg(
        F.max(F.struct("score", (-F.col("first_word")).alias("early"), "first_word", "last_word")).alias("m")
    )
    return best.join(items.select("item", "item_id").distinct(), "item").select(
        "doc_id", "item_id", "m.score", "m.first_word", "m.last_word", "text_key"
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` in which no test item was found, unchanged."""
    found = materialize(contaminated(docs, benchmark, **options), "leaks").select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")
    ).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key")), "left_anti")
