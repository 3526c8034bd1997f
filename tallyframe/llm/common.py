"""Shared helpers: Arrow text buffers, vectorised word hashes, shingles, bounded bit tables.

Word hashes are 64-bit: bytes of a word weighted by position, summed modulo 2**64 and mixed.
Two different words of one corpus share a hash with odds of about (number of words)**2 / 2**65.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import scratch

#: Bytes of text that a task turns into numpy arrays at a time.
SLICE_BYTES = 1 << 20

#: Rows of an Arrow batch while an operator writes its intermediate tables; rows may hold long texts.
BATCH_ROWS = 1_000

_SEED = np.random.default_rng(20240229)
_BYTE = _SEED.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def small_batches(spark: SparkSession):
    """Jobs started within hand at most BATCH_ROWS rows to Python at a time; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    with small_batches(df.sparkSession):
        return scratch.materialize(df, label)


def _table(word: str) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes belong to a word, and the byte with A-Z in lower case."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    inside = np.ones(256, bool)
    if word == "space":  # [^\x20\x09-\x0D]+
        inside[[32, *range(9, 14)]] = False
    elif word == "phrase":  # words of pieces: neither space nor tab, nor what ends a piece
        inside[[32, *range(9, 14), *b".,;:!?"]] = False
    else:  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing
        inside[: 0x30] = inside[0x3A:0x61] = inside[0x7B:0x80] = False
        inside = inside[low]
    return inside, low


_TABLES = {kind: _table(kind) for kind in ("space", "phrase", "alnum")}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, one after the other, and where each begins; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches, column: str = "text", limit: int = SLICE_BYTES):
    """Record batches cut into runs of rows with about ``limit`` bytes of text."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


class Words:
    """Words of some texts: ``start``/``end`` in bytes, ``hash``, and ``at`` (the first word of each text)."""

    def __init__(self, column: pa.Array, kind: str = "space", seed: int = 0):
        self.data, self.offsets = utf8(column)
        inside, low = _TABLES[kind]
        is_in = inside[self.data]
        before = np.zeros(len(is_in) + 1, bool)
        before[1:] = is_in
        edges = self.offsets[self.offsets < len(is_in)]
        cut = np.zeros(len(is_in) + 1, bool)
        cut[self.offsets] = True
        opens = is_in & (~before[:-1] | cut[:-1]) if len(edges) else is_in
        after = np.zeros(len(is_in), bool)
        after[:-1] = is_in[1:]
        self.start = np.flatnonzero(opens)
        self.end = np.flatnonzero(is_in & (~after | cut[1:])) + 1
        self.at = np.searchsorted(self.start, self.offsets)
        size = self.end - self.start
        if len(size):
            first = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            power = np.ones(int(size.max()), np.uint64)
            power[1:] = _STEP
            power = np.cumprod(power, dtype=np.uint64)
            value = _BYTE[seed][low[self.data[is_in]]] * power[place]
            self.hash = mix(np.add.reduceat(value, first) ^ size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.at) - 1


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words, by the place of its first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * _STEP + hashes[j : j + n]
    return mix(acc)


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; a shorter text is one shingle, an empty one none."""
    every = rolling(words.hash, k)
    out = []
    for a, b in zip(words.at[:-1].tolist(), words.at[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif b > a:
            out.append(rolling(words.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bit_table(keys: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A table of 2**bits bits in which the low bits of every key are set.

    Its size is fixed, so it may go to the driver and to every task. It only spares rows a
    shuffle: what passes it is still joined exactly, and a full table lets everything pass.
    """
    key = F.col(column).cast("long")
    cell = F.expr(f"shiftrightunsigned(`{column}` & {(1 << bits) - 1}L, 6)")
    bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63L as int))")
    with scratch.shuffles_dropped(keys.sparkSession):
        found = (
            keys.where(key.isNotNull()).select(cell.alias("cell"), bit.alias("bit"))
            .groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
        )
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[found["cell"].to_numpy()] = found["bit"].to_numpy().view(np.uint64)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be among those of ``bit_table``."""
    low = keys.view(np.uint64) & np.uint64(len(table) * 64 - 1)
    return ((table[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)
